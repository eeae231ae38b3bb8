"""The n-gram Jaccard join against all pairs."""

import random
import re

from rolegrain.llm import jaccard
from rolegrain.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), (low.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def compare(spark, rows, k=4, percent=85):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, node int, label string").repartition(3)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted((tuple(r) for r in jaccard.linked_groups(docs, k, percent).collect()), key=key)
    assert got == sorted(brute(rows, k, percent), key=key)


def test_edited_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)] + ["É", "x\x00"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs = []
    for size in (8, 30, 60, 150, 147, 400):
        base = text(size)
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(words)], text(2)])
            docs.append(copy)
    docs += [text(rng.randrange(0, 6)) for _ in range(40)] + [docs[0], docs[30], text(8000)]
    rng.shuffle(docs)
    rows = [(i + 5, rng.choice([" ", "\n "]).join(d)) for i, d in enumerate(docs)] + [(900, None), (901, ""), (3, " ".join(docs[7]).upper()), (3, " ".join(docs[7])), (None, " ".join(docs[7])), (None, "alone of all four words"), (950, "A b"), (951, "a B"), (952, "a b c")]
    compare(spark, rows)
    compare(spark, rows[:120], 5, 80)


def test_corpus_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    compare(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert jaccard.linked_groups(docs.limit(0)).count() == 0


def test_keep_one(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, a), (2, a + " end"), (3, b), (4, None), (5, ""), (6, "one"), (7, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [1, 3, 4, 5, 6]


def test_components_of_paths(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 102), (102, 101), (200, 200), (-5, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == got[102] == got[100] == 100 and got[300] == -5 and 200 not in got


def test_wanted_matches():
    import numpy as np

    assert jaccard.matches_wanted(np.zeros(20), 100, 16, 5) == 1
    assert jaccard.matches_wanted(np.full(20, 50.0), 400, 16, 5) == 5
    assert jaccard.matches_wanted(np.r_[np.full(16, 1.0), np.full(4, 1e6)], 100, 16, 5) == 1


def test_keep_one_with_clashing_names_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (2, text), (9, text + " more"), (7, None), (8, ""), (None, text), (1, "other words of another text here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").withColumnsRenamed({"component_id": "n_shingles"})
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 2, 7, 8]
    assert jaccard.keep_one(docs.limit(0)).count() == 0
