"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize

LISTS = 4
#: Bytes of a block of queries as doubles, which the driver gathers and every task gets.
QUERY_BYTES = 32 << 20
AT_ONCE = 1024
#: Once so few of the pairs of a tile are left, their rest is resolved pair by pair.
FEW = 1 / 16
FOUND = "query int, vec_id long, score long"
FOUND_SCHEMA = pa.schema([("query", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """floor(1024 * x) of each row's components, as whole doubles; shorter rows end in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.floor(1024 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(column), max([width, *lengths.tolist()])))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores of each query, ties to the smaller vec_id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


class Tile:
    """A block of queries against some rows, their components in LISTS stretches: a pair's local scores are its inner
    products over a stretch, its score is their sum. All are whole numbers that doubles hold exactly. products counts
    the multiplications of components."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray):
        width = max(queries.shape[1], rows.shape[1], 1)
        self.q, self.x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, rows))
        step = -(-width // LISTS)
        self.stretches = [slice(a, min(width, a + step)) for a in range(0, width, step)]
        norms = [tuple(np.sqrt((m[:, s] ** 2).sum(axis=1)) for m in (self.q, self.x)) for s in self.stretches]
        order = sorted(range(len(norms)), key=lambda i: -norms[i][0].sum() * norms[i][1].sum())
        self.stretches, self.norms = [self.stretches[i] for i in order], [norms[i] for i in order]
        self.products = 0

    def local(self, i: int) -> np.ndarray:
        s = self.stretches[i]
        self.products += len(self.q) * len(self.x) * (s.stop - s.start)
        return self.q[:, s] @ self.x[:, s].T

    def most(self, i: int) -> np.ndarray:
        """What no local score of a stretch is above."""
        return np.outer(*self.norms[i]) * (1 + 1e-9) + 1

    def exact(self, q: np.ndarray, v: np.ndarray, begin: int = 0) -> np.ndarray:
        """The sums of pairs' local scores from list `begin` on."""
        out = np.zeros(len(q))
        for s in self.stretches[begin:]:
            self.products += len(q) * (s.stop - s.start)
            for lo in range(0, len(q), 1 << 16):
                a, b = q[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]
                out[lo : lo + (1 << 16)] += np.einsum("ij,ij->i", self.q[a, s], self.x[b, s])
        return out

    def heads(self, k: int) -> tuple[np.ndarray, ...]:
        """Phase one: the k highest entries for each list there is, all from the one with the largest norms, and their
        scores."""
        scores = self.local(0)
        n = min(k * len(self.stretches), scores.shape[1])
        v = np.argpartition(-scores, n - 1, axis=1)[:, :n].ravel()
        q = np.repeat(np.arange(len(self.q)), n)
        return q, v, scores[q, v] + self.exact(q, v, 1)

    def sufficient(self, cutoff: np.ndarray) -> tuple[np.ndarray, ...]:
        """Phases two and three: list by list, pairs go that reach the uniform threshold cutoff / lists in no list and
        can't in those to come, or whose sum can't reach the cutoff; the rest of the others' scores is resolved."""
        lists = len(self.stretches)
        cutoff = cutoff[:, None]
        total, reached = np.zeros((len(self.q), len(self.x))), np.zeros((len(self.q), len(self.x)), bool)
        for i in range(lists):
            scores = self.local(i)
            total += scores
            reached |= scores * lists >= cutoff
            rest, alive = np.zeros_like(total), reached.copy()
            for j in range(i + 1, lists):
                most = self.most(j)
                rest += most
                alive |= most * lists >= cutoff
            alive &= total + rest >= cutoff
            if alive.mean() <= FEW or i == lists - 1:
                q, v = np.nonzero(alive)
                score = total[q, v] + self.exact(q, v, i + 1)
                keep = score >= cutoff[q, 0]
                return q[keep], v[keep], score[keep]
        raise AssertionError("no lists")


def whole_numbers(queries: np.ndarray, rows: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every pair's score in Python's integers, cut off at 64 bits: for components too large for doubles' sums."""
    width = max(queries.shape[1], rows.shape[1])
    q, x = (np.array([[int(v) for v in row] + [0] * (width - len(row)) for row in m], object).reshape(len(m), width) for m in (queries, rows))
    i, j = np.indices((len(q), len(x))).reshape(2, -1)
    score = np.array([max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in (q @ x.T).ravel()], np.int64)
    keep = score >= cutoff[i]
    return i[keep], j[keep], score[keep]


def searched(vectors: DataFrame, queries: np.ndarray, k: int, cutoff: np.ndarray | None) -> DataFrame:
    """One pass of a block of queries over all vectors; each task sends k entries a query at most. Without a cutoff
    these are the best heads of local lists, with one the best of all that reach it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(lo, AT_ONCE)
                vec, rows = part.column(0).to_numpy(), matrix(part.column(1), queries.shape[1])
                for a in range(0, len(queries), AT_ONCE):
                    some = queries[a : a + AT_ONCE]
                    least = np.full(len(some), -np.inf) if cutoff is None else cutoff[a : a + AT_ONCE]
                    if np.abs(some).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1] >= 2.0**52:
                        q, v, score = whole_numbers(some, rows, least)
                    else:
                        tile = Tile(some, rows)
                        q, v, score = tile.heads(k) if cutoff is None else tile.sufficient(least)
                    held = best(*(np.concatenate(x) for x in zip(held, (q + a, vec[v], score.astype(np.int64)), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(held[0].astype(np.int32)), *[pa.array(x) for x in held[1:]]], schema=FOUND_SCHEMA)

    return vectors.mapInArrow(search, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that the condition is_query takes, the k rows with the
    highest inner products of floor(1024 * x), ties to the smaller vec_id; a query's own row is no candidate.

    Queries go in blocks of QUERY_BYTES, each broadcast with its cutoffs. Phase one gathers heads of local score lists
    over all vectors and scores them; the last of the best k + 1 is the safe cutoff, below which no answer lies.
    Phases two and three go over all vectors again, but leave a pair as soon as its local scores so far and
    the norms of the rest rule it out. A block's result is a table, so plans don't grow with the blocks.

    Vectors that are null or hold null or non-finite components take no part, nor does a null vec_id; one
    shorter than another ends in zeros. Of rows that repeat a vec_id each is a query of its own, with the others among
    its candidates. An empty table gives no rows. Scores beyond 64 bits are cut off there. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    queries = materialize(usable.filter(is_query), "queries")
    components = queries.agg(F.coalesce(F.sum(F.size("embedding") + F.lit(1)), F.lit(0))).first()[0]
    blocks = math.ceil(8 * components / QUERY_BYTES)
    out = None
    for i in range(blocks):
        table = queries.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == i).toArrow()
        if not table.num_rows:
            continue
        ids, q = table.column(0).to_numpy(), matrix(table.column(1).combine_chunks(), 1)
        cut = ranked(searched(usable, q, k + 1, None), k + 1).filter(F.col("place") == k + 1).select("query", "score").toArrow()
        cutoff = np.full(len(ids), -np.inf)
        cutoff[cut.column("query").to_numpy()] = cut.column("score").to_numpy()
        cutoff = np.where(np.abs(cutoff) >= 2.0**53, np.nextafter(cutoff, -np.inf), cutoff)
        own = np.array([max(-(1 << 63), min((1 << 63) - 1, sum(int(v) ** 2 for v in row))) for row in q], np.int64)
        names = spark.createDataFrame(pa.table({"query": np.arange(len(ids), dtype=np.int32), "query_id": ids, "own": own}))
        found = materialize(ranked(searched(usable, q, k + 1, cutoff), k + 1).join(names, "query"), f"found{i}")
        found = found.withColumn("query", F.struct(F.lit(i).alias("block"), "query"))
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    first = F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("query"))
    others = out.withColumn("_own", first).filter(F.col("_own").isNull() | (F.col("place") != F.col("_own")))
    return ranked(others.drop("place"), k).select("query_id", F.col("place").alias("rank"), "vec_id", "score")
