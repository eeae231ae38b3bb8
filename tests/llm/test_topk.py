"""Exact top-k against scoring every pair."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from rolegrain.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for other, (j, v) in enumerate(ok) if other != at)
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def compare(spark, rows, k=10):
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    assert sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect()) == brute(rows, k)


def test_random_ties_and_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(13)]) for i in range(450)]
    rows += [(i, [0.5] * 13) for i in range(450, 700)] + [(700, None), (701, [1.0, None]), (800, [float("nan")] * 13), (702, [float("inf")] * 13), (900, []), (703, [9.0]), (None, [1.0] * 13), (300, rows[3][1]), (705, rows[5][1]), (705, rows[5][1]), (1000, [-5.0] * 13)]
    compare(spark, rows)
    rows.append((300, rows[300][1]))  # the same row again
    monkeypatch.setattr(topk, "QUERY_BYTES", 300)
    monkeypatch.setattr(topk, "AT_ONCE", 7)
    compare(spark, rows, 3)


def test_few_rows_and_large_values(spark):
    compare(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0]), (100, [-1.0, 0.5])])
    compare(spark, [(0, [2e5, 3e5]), (1, [3e6, -1e6]), (2, [3e6, -1e6 + 0.01]), (100, [-1e6, 5e6])], 2)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_cutoffs_spare_products():
    """All three phases take fewer multiplications than every pair has, and find what every pair finds."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (40, 64))
    rows = np.floor(1024 * (centres[rng.integers(0, 40, 1500)] + rng.normal(0, 0.3, (1500, 64))))
    queries = rows[:40]
    first = topk.Tile(queries, rows)
    q, v, score = first.heads(11)
    assert (score == (queries[q] * rows[v]).sum(axis=1)).all()
    found = topk.best(q, v, score, 11)
    cutoff = np.array([found[2][found[0] == i].min() for i in range(len(queries))])
    then = topk.Tile(queries, rows)
    q, v, score = then.sufficient(cutoff)
    whole = queries @ rows.T
    assert set(zip(q.tolist(), v.tolist(), score.tolist(), strict=True)) == {(i, j, whole[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero(whole >= cutoff[:, None])), strict=True)}
    assert first.products + then.products < 0.9 * len(queries) * len(rows) * 64, (first.products, then.products)
