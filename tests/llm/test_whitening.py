"""Whitening against exact whole numbers and numpy."""

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from rolegrain.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors):
    """(n, deviations, whitened up to sign, explained) with exact centring."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(width)]
    numerators = [[n * r[j] - sums[j] for j in range(width)] for r in x]
    centred = np.array([[float(Fraction(a, n)) for a in r] for r in numerators])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, [sum(a * a for a in r) for r in numerators], centred @ axes / np.sqrt(np.where(values > 1e-9, values, np.nan)), values / values.sum()


def held(rows, ids, vectors, components):
    n, deviation, whitened, explained = brute(vectors)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == len(ids) * components
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    for k in range(1, components + 1):
        mine = np.array([got[i, k].whitened for i in ids])
        assert min(np.abs(mine - whitened[:, k - 1]).max(), np.abs(mine + whitened[:, k - 1]).max()) < 1e-7
        assert abs(got[ids[0], k].explained / explained[k - 1] - 1) < 1e-9
    assert [got[i, 1].deviation for i in ids] == deviation


def test_query_matches_brute_force(spark):
    rows = queries.op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    held(rows, [r.vec_id for r in table], [r.embedding for r in table], 32)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(40, 4)).tolist()
    rows = [(i, v, i) for i, v in enumerate(good)]
    rows += [(100, None, 0), (101, [1.0, None, 2.0, 3.0], 0), (102, [1.0, float("nan"), 0.0, 0.0], 0), (103, [float("inf"), 0.0, 0.0, 0.0], 0), (104, [], 0), (105, [1.0, 2.0], 0), (106, [float("-inf")] * 4, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int").withColumn("n", F.lit("x"))
    got = whitening.whiten(table)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held(got.collect(), list(range(40)), good, 4)
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(table.filter("vec_id >= 100 and vec_id < 105")).count() == 0


def test_repeats_nulls_and_flat_dimensions(spark):
    rng = np.random.default_rng(6)
    flat = [[float(a), 0.5, float(b), float(a)] for a, b in rng.normal(size=(30, 2))]
    rows = [(None if i == 0 else 7, v) for i, v in enumerate(flat)] + [(7, flat[3])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 31 * 4 and sum(r.vec_id is None for r in got) == 4
    assert {r.component: r.whitened is None for r in got} == {1: False, 2: False, 3: True, 4: True}
    assert got[0].identity_error < 1e-9
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(0, None, None, None)] * 4


def test_deviations_beyond_doubles_are_exact():
    big = np.array([[3_037_000_499, 1], [2**30 + 1, 2**31 - 1]], dtype=np.int64)
    assert whitening.deviations(big).tolist() == [3_037_000_499**2 + 1, (2**30 + 1) ** 2 + (2**31 - 1) ** 2]
