"""LM scoring against counting in plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rolegrain.llm import lmscore

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, weight=0.4):
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, [*WORD.findall(lower(t)), None]) for i, t in rows]
    uni, bi = Counter(), Counter()
    for _, held, tokens in docs:
        if not held:
            uni.update(tokens)
            bi.update(zip([None, *tokens[:-1]], tokens, strict=True))
    levels = lmscore.level_of(np.array([*bi.values(), 1]), 1.5)
    bi = Counter(dict(zip(bi, lmscore.level_counts(int(levels.max()), 1.5)[levels], strict=False)))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, held, tokens in docs:
        alone = [(uni[t] + 1) / (n + v + 1) for t in tokens]
        p = [(1 - weight) * a + weight * min(bi[h, t], uni[h], uni[t]) / uni[h] if uni[h] else a for h, t, a in zip([None, *tokens[:-1]], tokens, alone, strict=True)]
        out.append((i, held, len(tokens), sum(uni[t] > 0 for t in tokens), n, sum(map(math.log10, alone)), sum(map(math.log10, p))))
    return out


def compare(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, block int").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got = sorted((tuple(r) for r in lmscore.score(spark.read.parquet(str(tmp_path / "docs")), bits_per_entry=40, hashes=6).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-12)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=1e-9)


def test_small_rows(spark, tmp_path):
    rows = [(0, "A b a b"), (1, None), (2, ""), (3, "a b\x0bc\x00d é É"), (4, "zz yy"), (5, "b a"), (5, "b a"), (None, "a a a"), (16, "a b unseen"), (18, "a b a c")]
    compare(spark, tmp_path, rows)


def test_corpus_texts(spark, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    compare(spark, tmp_path, rows)


def test_no_training_rows_and_empty(spark, tmp_path):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    compare(spark, tmp_path, [(i, "some words") for i in held])
    assert lmscore.score(spark.read.parquet(str(tmp_path / "docs")).limit(0)).count() == 0


def test_filter_larger_than_a_broadcast(spark, tmp_path):
    """With the query's parameters, scores are the same and near those of counting when the filter may not be sent."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    sent, kept = (sorted(map(tuple, lmscore.score(docs, **most).collect()), key=lambda r: r[0]) for most in ({}, {"max_filter_bytes": 1000}))
    assert sent == kept
    want = {r[0]: r for r in brute(rows)}
    assert np.mean([abs(r[6] - want[r[0]][6]) / r[2] for r in kept]) < 0.02


def test_levels():
    counts = np.arange(1, 2000)
    levels = lmscore.level_of(counts, 1.5)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert (np.abs(lmscore.level_counts(int(levels.max()), 1.5)[levels] / counts - 1) < 0.35).all()
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 48, 1000).astype(np.uint64))
    for k in (keys, keys[:1], keys[:0], np.arange(5, dtype=np.uint64)):
        assert (lmscore.unpack_keys(lmscore.pack_keys(k)) == k).all()


def test_false_positives_stay_with_more_data(spark):
    """With the query's bits and hashes, twice or eight times the entries leave the share of wrong answers alone."""
    wrong = []
    for n in (2_000, 4_000, 16_000):
        rng = np.random.default_rng(n)
        keys = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        packed = spark.createDataFrame([(0, "b", bytearray(lmscore.pack_keys(keys)), bytearray(lmscore.pack_counts(np.ones(len(keys), np.int64))))], lmscore.PACKED)
        model = lmscore.gathered(lmscore.filter_parts(packed, 8, 3, 1.5), 1, 3, 1.5)
        assert (lmscore.probed_levels(model, keys) == 1).all()
        wrong.append((lmscore.probed_levels(model, rng.integers(0, 1 << 48, 40_000).astype(np.uint64)) > 0).mean())
    assert max(wrong) < 0.04 and max(wrong) - min(wrong) < 0.01, wrong
