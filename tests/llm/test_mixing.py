"""Mixing: held-out accuracy of the classifier, and rates against a dense solution."""

import random

import numpy as np
import pytest

from rolegrain.llm import mixing


def tables(spark, n=600):
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["clean"] * 6 + ["low"] * 2 + ["toxic"])
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if kind == "toxic":
            words[::5] = [rng.choice(["bad", "worse", "worst"]) for _ in words[::5]]
        if kind == "low":
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    rows += [(n, None, "x"), (n + 1, "", "x"), (None, "w1 w2", "x"), (5, rows[5][1], rows[5][2])]
    labels += [(None, 1, 0), (9, None, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, p string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_and_rates(spark):
    rows, docs, labels = tables(spark)
    target = {"clean": 0.5, "low": 0.4, "toxic": 0.1}
    got = mixing.document_rates(docs, labels, target).collect()
    assert len(got) == len(rows)
    kind = {r[0]: r[2] for r in rows}
    unseen = [r for r in got if r.doc_id is not None and r.doc_id % 2 == 0 and kind[r.doc_id] != "x"]
    assert sum(max(mixing.DOMAINS, key=lambda d: r[f"p_{d}"]) == kind[r.doc_id] for r in unseen) >= 0.9 * len(unseen)
    n, p, rate = np.array([r.n_tokens for r in got]), np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got]), np.array([r.rate for r in got])
    assert (rate >= 0).all() and ((n * rate) @ p / n.sum()).tolist() == pytest.approx([0.5, 0.4, 0.1], abs=1e-5)
    assert abs(np.array([r.copies for r in got]) @ n / (rate @ n) - 1) < 0.1


def test_rates_stop_at_zero(spark):
    rows, docs, labels = tables(spark)
    got = mixing.document_rates(docs, labels, {"clean": 1, "low": 0, "toxic": 0}).collect()
    n, p, rate = np.array([r.n_tokens for r in got]), np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in got]), np.array([r.rate for r in got])
    totals = (n * rate) @ p / n.sum()
    assert (rate >= 0).all() and totals[0] > 0.9 and totals[1] < 0.08
    # no nonnegative direction lessens the distance: compare with a dense projected gradient
    a, b, r = (n[:, None] * p).T / n.sum(), np.array([1.0, 0, 0]), np.ones(len(n))
    step = 1 / np.linalg.eigvalsh(a @ a.T)[-1]
    for _ in range(20_000):
        r = np.maximum(0, r - step * a.T @ (a @ r - b))
    assert np.abs(totals - b).sum() <= np.abs(a @ r - b).sum() + 0.02


def test_mixed_keeps_clean_documents_and_columns(spark):
    rows, docs, labels = tables(spark)
    out = mixing.mixed(docs, labels, {"clean": 0.9, "low": 0.08, "toxic": 0.02})
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    kept = lambda k: sum(r[0] in set(ids) for r in rows if r[2] == k) / sum(r[2] == k for r in rows)
    assert kept("clean") >= 0.98 and kept("toxic") < 0.6
    assert mixing.document_rates(docs.limit(0), labels, {"clean": 1, "low": 1, "toxic": 1}).count() == 0
    assert mixing.document_rates(docs, labels.limit(0), {"clean": 1, "low": 1, "toxic": 1}).count() == len(rows)


def test_mixed_has_the_target_shares(spark):
    """Expected domain tokens of what is passed on, with documents kept that are likely clean."""
    rows, docs, labels = tables(spark)
    target = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    found, members = mixing.mixture(docs, labels, target, 1.05)
    at = members.withColumn("rate", mixing.rate(found.steps, True)).collect()
    n, p, rate = np.array([r["_n_tokens"] for r in at]), np.array([r["_p"] for r in at]), np.array([r.rate for r in at])
    assert (rate[p[:, 0] >= 0.5] >= 1).all() and (rate >= 0).all()
    totals = (n * rate) @ p
    # dense projected gradient onto the same bounds
    least, a = np.where(p[:, 0] >= 0.5, 1.0, 0.0), (n[:, None] * p).T / n.sum()
    b = np.array(found.targets) / n.sum()
    r, step = np.ones(len(n)), 1 / np.linalg.eigvalsh(a @ a.T)[-1]
    for _ in range(20_000):
        r = np.maximum(least, r - step * a.T @ (a @ r - b))
    assert np.abs(totals / n.sum() - b).sum() <= np.abs(a @ r - b).sum() + 0.02


def test_clashing_names_and_odd_rows(spark):
    rows, docs, labels = tables(spark, 60)
    odd = docs.withColumnRenamed("p", "_p").withColumns({"_n_tokens": docs.doc_id, "copies": docs.doc_id, "row": docs.doc_id})
    out = mixing.mixed(odd, labels, {"clean": 0.9, "low": 0.08, "toxic": 0.02})
    assert out.columns == odd.columns and all(r["row"] == r.doc_id for r in out.collect())
    assert mixing.mixed(odd.limit(0), labels, {"clean": 0.9, "low": 0.08, "toxic": 0.02}).count() == 0


def test_long_rows_are_packed_by_bits():
    for n in (0, 1, 2047, 2048, 9000):
        index = np.sort(np.random.default_rng(n).choice(mixing.FEATURES, n, replace=False))
        packed = mixing.packed_row(index)
        assert len(packed) <= 4096 and (mixing.unpacked_row(packed) == index).all()
