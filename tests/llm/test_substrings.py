"""Substring dedup against comparing all windows."""

import hashlib
import random
import re
from collections import Counter

from rolegrain.llm import substrings
from rolegrain.llm.substrings import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in docs for k in range(len(w) - width + 1))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def compare(spark, tmp_path, rows, width=35):
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, block int").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    got = sorted((tuple(r) for r in substrings.remove_repeats(spark.read.parquet(str(tmp_path / "docs")), width, with_text=True).collect()), key=key)
    assert got == sorted(brute(rows, width), key=key)


def test_planted_passages(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["ünï", "x\x00y"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage, hot = text(80), text(50)
    docs = [text(rng.randrange(0, 300)) for _ in range(60)]
    for i in (3, 9, 17):
        docs[i][10:10] = passage[: 60 + i]
    for i in range(20, 50):
        docs[i][5:5] = hot
    docs += [docs[4], text(34), ["der"] * 200, ["a", "b"] * 40, ["der"] * 35, ["q"] * 36, text(20_000)]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (4, " ".join(docs[4])), (None, " ".join(text(40)))]
    compare(spark, tmp_path, rows)
    compare(spark, tmp_path, rows[:30], 16)


def test_hot_anchors(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    hot = [rng.choice(words) for _ in range(70)]
    rows = [(i, " ".join([rng.choice(words) for _ in range(30)] + hot[: rng.randrange(30, 70)] + [rng.choice(words) for _ in range(30)])) for i in range(80)]
    monkeypatch.setattr(substrings, "HOT_PLACES", 3)
    compare(spark, tmp_path, rows)


def test_corpus_and_empty(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, tmp_path, rows)
    assert substrings.remove_repeats(spark.read.parquet(str(tmp_path / "docs")).limit(0)).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(4)]
        sam = SuffixAutomaton()
        for t in texts:
            sam.add(t, 1)
        sam.count_places()
        occurs = lambda s: sum(t[i : i + len(s)] == s for t in texts for i in range(len(t)))
        for t in texts:
            want = [max(n for n in range(e + 2) if not n or occurs(t[e + 1 - n : e + 1]) >= 2) for e in range(len(t))]
            assert sam.matched(t) == want


def test_frames_that_are_no_files(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text + " a"), (2, "b " + text), (3, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.remove_repeats(rows).collect()) == [(1, 40), (2, 40), (3, 0)]
