"""Exact nearest vectors, pooling and the state of stored vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(vector: Column, width: int) -> Column:
    """Of the given width, all finite, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == width) & ~bad & (norm(vector) > 0), F.lit(False))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (norm(a) * norm(b))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors at the smallest cosine distances, over all of them, ties by key. k is 1..1500."""
    if not 1 <= k <= 1500:
        raise ValueError("k is out of 1..1500")
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.filter(usable(F.col(vector), len(query))).select(key, cosine_distance(F.col(vector), q).alias("distance")).orderBy("distance", key).limit(k)


def pooled(windows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each group, at length 1, as rows (group, pos, value)."""
    each = windows.select(group, F.posexplode(vector)).groupBy(group, "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    length = each.groupBy(group).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return each.join(length, group).select(group, "pos", (F.col("mean") / F.col("length")).alias("value"))


def token_windows(rows: DataFrame, tokens: str, size: int = 480, overlap: int = 32) -> DataFrame:
    """rows with one line per window of an array column: window (from 0) and window_tokens; the last may be
    short, and each starts overlap before the end of the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - overlap - 1), F.lit(step))
    return rows.select("*", F.posexplode(starts).alias("window", "_start")).withColumn("window_tokens", F.slice(F.col(tokens), F.col("_start") + 1, F.lit(size))).drop("_start")


def vector_state(jobs: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """(id, state): current, stale (another hash or version, or unusable), missing, or withdrawn (a vector for a
    job without a body). jobs: id, hash, has_body; vectors: id, hash, version, valid."""
    v = vectors.select("id", F.col("hash").alias("_hash"), F.col("version").alias("_version"), F.col("valid").alias("_valid"))
    joined = jobs.join(v, "id", "left")
    state = (
        F.when(~F.col("has_body") & F.col("_version").isNotNull(), "withdrawn").when(F.col("_version").isNull(), "missing")
        .when((F.col("_hash") == F.col("hash")) & (F.col("_version") == version) & F.col("_valid"), "current").otherwise("stale")
    )
    return joined.select("id", state.alias("state"))


def encoded_once(documents: DataFrame, encode: Column, width: int = 384) -> DataFrame:
    """(id, hash, embedding) of documents (id, text): each different text is encoded once, by the expression encode over
    text; a vector that is unusable is an error. Null texts have none."""
    texts = documents.filter("text is not null").select(F.sha2("text", 256).alias("hash"), "text").dropDuplicates(["hash"])
    vectors = texts.select("hash", encode.alias("embedding"))
    checked = vectors.withColumn("embedding", F.when(usable(F.col("embedding"), width), F.col("embedding")).otherwise(F.raise_error(F.lit("unusable vector")).cast(vectors.schema["embedding"].dataType)))
    return documents.select("id", F.sha2("text", 256).alias("hash")).join(checked, "hash").select("id", "hash", "embedding")
