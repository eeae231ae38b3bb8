"""Stored responses: bodies by their checksum, metadata by theirs, limits of age, number and bytes, and their replay."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from rolegrain.functions.addresses import without_secrets
from rolegrain.operators.tables import with_running

# Limits of the store, and the version that a replay must have.
MOST_DAYS, MOST_FILES, MOST_BYTES, MOST_BODY = 30, 10_000, 5 << 30, 16 << 20
PARSER_VERSION = "vacancy-parser:v1"
PACKED = b"gzip:"
METADATA = ("url", "status", "content_type", "body_hash", "body_bytes", "parser_version")


@F.pandas_udf(BinaryType())
def packed(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A body compressed after a mark if that makes it smaller, else as it is. The same bytes for the same body."""
    for part in bodies:
        yield part.map(lambda b: min((PACKED + gzip.compress(bytes(b), 6, mtime=0), bytes(b)), key=len), na_action="ignore")


@F.pandas_udf(BinaryType())
def unpacked(stored: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The body that was packed; no more than one byte beyond the limit is unpacked."""

    def one(b: bytes) -> bytes:
        if not b.startswith(PACKED):
            return bytes(b)
        import io

        with gzip.GzipFile(fileobj=io.BytesIO(b[len(PACKED) :])) as stream:
            return stream.read(MOST_BODY + 1)

    for part in stored:
        yield part.map(one, na_action="ignore")


def metadata(responses: DataFrame) -> Column:
    """The JSON by whose checksum a response is known: its fields in the order of their names, without secrets in the address."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(METADATA)]))


def saved(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies: digest, stored, raw_bytes, stored_bytes, at; entries: key, metadata, digest, stored_bytes, at) of responses
    (url, status, content_type, body, at). A body that several responses have is stored once, with the newest time.
    A body beyond 16 MiB is an error."""
    size = F.octet_length("body")
    body = F.when(size <= MOST_BODY, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("a body is too large: "), "url")).cast("binary"))
    rows = responses.select(without_secrets(F.col("url")).alias("url"), "status", "content_type", body.alias("body"), "at").withColumns({"body_hash": F.sha2("body", 256), "body_bytes": F.octet_length("body"), "parser_version": F.lit(PARSER_VERSION)})
    entries = rows.withColumn("metadata", metadata(rows)).groupBy(F.sha2("metadata", 256).alias("key"), "metadata", F.col("body_hash").alias("digest")).agg(F.max("at").alias("at"))
    bodies = rows.groupBy(F.col("body_hash").alias("digest")).agg(F.max("at").alias("at"), F.first("body").alias("body"))
    bodies = bodies.withColumn("stored", packed("body")).select("digest", "stored", F.octet_length("body").alias("raw_bytes"), F.octet_length("stored").alias("stored_bytes"), "at")
    return bodies, entries.withColumn("stored_bytes", F.octet_length("metadata")).select("key", "metadata", "digest", "stored_bytes", "at")


def within_limits(files: DataFrame, now: Column, days: int = MOST_DAYS, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (key, stored_bytes, at) that a store keeps: none older than days, then the newest ones as long as there are no
    more than most_files and most_bytes of them. Of files of one time the smaller key counts as newer. Both limits are
    running totals over the whole store, so older files make room for newer ones."""
    young = files.filter(F.col("at") >= now - F.make_dt_interval(F.lit(days)))
    run = with_running(young, [F.desc("at"), F.asc("key")], {"_files": F.lit(1).cast("long"), "_bytes": F.col("stored_bytes").cast("long")})
    return run.filter((F.col("_files") <= most_files) & (F.col("_bytes") <= most_bytes)).select(*files.columns)


def replayed(entries: DataFrame, bodies: DataFrame, version: str = PARSER_VERSION) -> DataFrame:
    """(key, url, status, content_type, body) of entries, ready to be parsed without the network. Metadata that is not what
    its key says, of another parser's version or without its body, and a body that is not what its checksum or
    size says, are errors."""
    schema = "url string, status int, content_type string, body_hash string, body_bytes long, parser_version string"
    m = F.from_json("metadata", schema)
    both = entries.select("key", "metadata", m.alias("m")).join(bodies.select("digest", unpacked("stored").alias("body")), F.col("m.body_hash") == F.col("digest"), "left")
    fault = (
        F.when(F.sha2("metadata", 256) != F.col("key"), "metadata changed: ").when(~F.col("m.parser_version").eqNullSafe(F.lit(version)), "unsupported parser version: ").when(F.col("body").isNull(), "no body: ")
        .when((F.sha2("body", 256) != F.col("m.body_hash")) | (F.octet_length("body") != F.col("m.body_bytes")), "body changed: ")
    )
    key = F.when(fault.isNull(), F.col("key")).otherwise(F.raise_error(F.concat(fault, "key")).cast("string"))
    return both.select(key.alias("key"), "m.url", "m.status", "m.content_type", "body")
