"""Mixing to target weights with soft domain membership."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize, text_batches
from rolegrain.llm.textvec import COMBINE, LOWER, mix, text_chunks, word_hashes, words_of

#: Domains of the labels table.
DOMAINS = ("clean", "low", "toxic")
FEATURES = 1 << 15
#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of doc_id. With their
#: features in 4 KB a row, the driver gathers 32 MB at most.
SAMPLE_ROWS = 8192
EPOCHS, BATCH, RATE, DECAY = 40, 512, 0.5, 1e-6


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).when(quality == 0, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct features of all rows, first of each row and their number, words of each row): buckets of the
    lower-cased words, less an end mark, and of their last three bytes."""
    words = words_of(LOWER[data], offsets)
    n_words = np.diff(words.bounds)
    row = np.repeat(np.arange(len(n_words)), n_words)
    low = LOWER[data].astype(np.uint64)
    tail = np.zeros(len(row), np.uint64)
    for j in range(1, 4):
        at = words.ends - j
        tail = tail * np.uint64(257) + np.where(at >= words.starts, low[np.maximum(at, 0)] + np.uint64(1), np.uint64(0))
    bare = words.ends - (np.isin(data[words.ends - 1], np.frombuffer(b".,;:!?", np.uint8)) & (words.ends - words.starts > 1))
    bucket = np.concatenate([word_hashes(words._replace(ends=bare)), mix(tail * COMBINE[40])]) % np.uint64(FEATURES)
    pairs = np.unique(np.concatenate([row, row]) * FEATURES + bucket.astype(np.int64))
    return pairs % FEATURES, np.searchsorted(pairs, np.arange(len(n_words) + 1) * FEATURES), n_words


def packed_row(index: np.ndarray) -> bytes:
    """A row's distinct features in 4 KB at most: two bytes each, or a bit for each feature there is."""
    if 2 * len(index) < FEATURES // 8:
        return index.astype("<u2").tobytes()
    field = np.zeros(FEATURES, bool)
    field[index] = True
    return np.packbits(field).tobytes()


def unpacked_row(packed: bytes) -> np.ndarray:
    if len(packed) < FEATURES // 8:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))


def posteriors(weights: np.ndarray, index: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class probabilities of rows of unit length with equal entries at their features; the last weight is the
    bias."""
    n = np.diff(bounds)
    scores = np.tile(weights[-1], (len(n), 1))
    some = n > 0
    if some.any():
        scores[some] += np.add.reduceat(weights[index], bounds[:-1][some]) / np.sqrt(n[some])[:, None]
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fitted(rows: list[bytes], labels: np.ndarray, classes: int) -> np.ndarray:
    """Multinomial logistic regression by Adagrad over small batches in a fixed order."""
    weights, squares = np.zeros((FEATURES + 1, classes)), np.full((FEATURES + 1, classes), 1e-6)
    order = np.random.default_rng(0).permutation(len(rows))
    for _ in range(EPOCHS):
        for lo in range(0, len(order), BATCH):
            own = order[lo : lo + BATCH]
            each = [unpacked_row(rows[i]) for i in own]
            index, n = np.concatenate(each), np.array([len(x) for x in each])
            bounds = np.r_[0, np.cumsum(n)]
            error = posteriors(weights, index, bounds)
            error[np.arange(len(own)), labels[own]] -= 1
            error /= len(own)
            each = np.repeat(error / np.sqrt(np.maximum(n, 1))[:, None], n, axis=0)
            slope = np.vstack([np.stack([np.bincount(index, each[:, k], FEATURES) for k in range(classes)], axis=1), error.sum(axis=0)])
            slope += DECAY * weights
            squares += slope**2
            weights -= RATE * slope / np.sqrt(squares)
    return weights


def classifier(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights of the domain classifier, from SAMPLE_ROWS labelled documents at most. Of a doc_id with several
    labels the worst counts, of several texts each. Without labelled documents all domains are alike."""
    spark = docs.sparkSession
    text_batches(spark)
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("doc_id is not null and domain is not null")
    sample = label.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    known = spark.sparkContext.broadcast(dict(sample.toArrow().to_pandas().itertuples(index=False, name=None)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            at = [i for i, x in enumerate(ids) if x in known.value]
            texts = batch.column("text").take(pa.array(at, pa.int64()))
            out = []
            for _, _, data, offsets in text_chunks(texts):
                index, bounds, _ = features(data, offsets)
                out += [packed_row(index[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.int64()), pa.array([known.value[ids[i]] for i in at], pa.int32()), pa.array(out, pa.binary())], ["doc_id", "domain", "features"])

    found = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, domain int, features binary").orderBy(F.xxhash64("doc_id"), "features").limit(SAMPLE_ROWS).toArrow()
    if not found.num_rows:
        return np.zeros((FEATURES + 1, len(DOMAINS)))
    return fitted(found.column("features").to_pylist(), found.column("domain").to_numpy(), len(DOMAINS))


class Mixture(NamedTuple):
    weights: np.ndarray  # of the classifier
    steps: list[list[float]]  # gradient steps, from which a document's rate follows
    totals: list[float]  # expected domain tokens at those rates
    targets: list[float]


def with_posterior(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs without text, with _n_tokens (its words) and _p, the domains' probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [c for c in docs.columns if c != "text"]
    types = dict(docs.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, p = [np.zeros(0, np.int64)], [np.zeros((0, len(DOMAINS)))]
            for _, _, data, offsets in text_chunks(batch.column("text")):
                index, bounds, n = features(data, offsets)
                n_tokens.append(n)
                p.append(posteriors(shared.value, index, bounds))
            each = np.concatenate(p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * len(DOMAINS)), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(np.concatenate(n_tokens)), lists], [*names, "_n_tokens", "_p"])

    return docs.mapInArrow(rows, ", ".join(f"`{n}` {types[n]}" for n in names) + ", _n_tokens long, _p array<double>")


def least_rate(keep_first: bool) -> Column:
    """The rate below which a document's may not go: 0, or with keep_first 1 where the first domain is the likelier."""
    return F.when(F.col("_p")[0] >= 0.5, 1.0).otherwise(0.0) if keep_first else F.lit(0.0)


def rate(steps: list[list[float]], keep_first: bool = False) -> Column:
    """A document's rate: from 1 on, each step takes the gradient's share and stops at the least rate."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.array(*map(F.lit, c)) for c in steps])
    moved = lambda c: sum((F.col("_p")[k] * c[k] for k in range(1, len(DOMAINS))), F.col("_p")[0] * c[0])
    return F.aggregate(table, F.lit(1.0), lambda r, c: F.greatest(least_rate(keep_first), r - moved(c)))


def solve(members: DataFrame, weights: np.ndarray, target: dict[str, float], scale: float | None, rounds: int = 40, tolerance: float = 1e-7) -> Mixture:
    """Projected gradient descent on the squared distance of the expected domain totals from the targets, in
    the metric of the documents' second moments, where a step of 1 always lessens it; a bolder step, scaled by
    the moments of the documents that are not at 0, is taken where it gains more. Each round is one aggregate
    of a few numbers over all documents. With scale, documents likelier of the first domain than not keep a rate of
    1 at least: the projection is onto these bounds.

    The targets share out the tokens there are, or, with scale, scale times the tokens that the first domain
    needs to keep its own at a rate of 1."""
    size = len(DOMAINS)
    share = np.array([target[d] for d in DOMAINS], float)
    share /= share.sum()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    p, n = (lambda k: F.col("_p")[k]), F.col("_n_tokens")

    def measured(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        at = members.withColumn("_rate", rate(steps, scale is not None))
        active = F.when(F.col("_rate") > 0, n).otherwise(0)
        row = at.agg(*[F.sum(n * p(k) * F.col("_rate")) for k in range(size)], *[F.sum(active * p(i) * p(j)) for i, j in pairs]).first()
        numbers = np.array([float(x or 0) for x in row])
        moments = np.zeros((size, size))
        for (i, j), x in zip(pairs, numbers[size:], strict=True):
            moments[i, j] = moments[j, i] = x
        return numbers[:size], moments

    totals, moments = measured([])
    budget = totals.sum() if scale is None else scale * totals[0] / share[0]
    targets = share * budget
    metric = np.linalg.pinv(moments, rcond=1e-10)
    steps: list[list[float]] = []
    distance = (totals - targets) @ metric @ (totals - targets)
    least = tolerance**2 * max(budget, 1.0)
    bold = True
    for _ in range(rounds):
        if distance <= least:
            break
        step = (np.linalg.pinv(moments, rcond=1e-10) if bold else metric) @ (totals - targets)
        new_totals, new_moments = measured([*steps, step.tolist()])
        new_distance = (new_totals - targets) @ metric @ (new_totals - targets)
        if new_distance >= distance * (0.98 if bold else 0.9999):
            if not bold:
                break
            bold = False
            continue
        steps.append(step.tolist())
        totals, moments, distance, bold = new_totals, new_moments, new_distance, True
    return Mixture(weights, steps, totals.tolist(), targets.tolist())


def mixture(docs: DataFrame, labels: DataFrame, target: dict[str, float], scale: float | None = None) -> tuple[Mixture, DataFrame]:
    weights = classifier(docs, labels)
    members = materialize(with_posterior(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), weights), "members")
    return solve(members, weights, target, scale), members


def copies(share: Column, key: Column) -> Column:
    """The rate as a whole number, rounded up for that part of the documents that its fraction is."""
    return F.floor(share + F.pmod(key, F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("long")


def document_rates(docs: DataFrame, labels: DataFrame, target: dict[str, float]) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, p_clean, p_low, p_toxic, rate, copies.

    A classifier fitted on the labels table (see classifier for its bounded sample) gives each document
    probabilities of the domains; rates >= 0 are such that the expected tokens of each domain, the sum of
    rate * n_tokens * p, are in the shares of target and in total the tokens there are. Tokens are words.

    Null text is empty: no tokens, and the probabilities of the bias alone. Null labels don't count. Repeated
    rows weigh as often as they come. Targets that no rates reach are approached in least squares. An empty
    table gives no rows. Other columns are ignored.
    """
    found, members = mixture(docs, labels, target)
    out = members.withColumn("rate", rate(found.steps))
    return out.select("doc_id", F.col("_n_tokens").alias("n_tokens"), *[F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies(F.col("rate"), F.xxhash64("doc_id")).alias("copies"))


def mixed(docs: DataFrame, labels: DataFrame, target: dict[str, float], scale: float = 1.05) -> DataFrame:
    """docs, each as often as its rate says (see copies), with rates fitted so that one likelier of the first domain
    than not has 1 at least. The total is scale times what keeps that domain whole. Nothing is shuffled.

    Null text is empty; null doc_ids share one hash for the rounding of their rates. Repeated rows come as often each.
    An empty table gives no rows. Columns of docs keep their names and values, whatever they are called."""
    names = docs.columns
    found, _ = mixture(docs, labels, target, scale)
    n = copies(rate(found.steps, True), F.xxhash64(F.col("row.doc_id").cast("long")))
    weighed = with_posterior(docs.select(F.struct("*").alias("row"), "text"), found.weights).withColumn("copies", n.cast("int")).filter("copies > 0")
    return weighed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[n].alias(n) for n in names])
