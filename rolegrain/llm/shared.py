"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new one that then stands there: on one machine a
    temporary one, on a cluster one under the warehouse if that is in a store that machines share. A cluster with neither is
    an error, as each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        home = str(spark.conf.get("spark.sql.warehouse.dir", None) or "").rstrip("/")
        if re.fullmatch(r"local(\[.*\])?", str(spark.conf.get("spark.master", "") or "")):
            base = tempfile.mkdtemp(prefix="rolegrain-shared-")
        elif re.match(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:", home):
            base = f"{home}/rolegrain-shared"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and a
    lost executor costs no more than a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rolegrain-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stretches(docs: DataFrame) -> int:
    """How many ranges of hashes to deal packed rows to: two for each shuffle partition, or one for each stretch of the
    input if that is more, so that a range doesn't grow with the input."""
    return max(2 * parts(docs.sparkSession), docs.rdd.getNumPartitions())


def broadcast_bytes(spark: SparkSession) -> int:
    """What the session lets a broadcast have: spark.sql.autoBroadcastJoinThreshold."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)i?b?", str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold")).strip().lower()).groups()
    return int(number) << 10 * " kmgt".index(unit or " ")


def text_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Send rows to Python in batches of so many bytes, unless the session asks for a size of its own: at Spark's 64 MB
    a batch of texts takes that much in the JVM and several times as much in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64MB") in ("64MB", "67108864b"):
        spark.conf.set(key, f"{megabytes}m")


def blocks(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(docs, block): the stretch of an input file from which a row comes, the same in every pass. A frame that
    is no plain read of files is written first."""
    block = F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start")
    try:
        docs.select(block)
    except AnalysisException:
        docs = materialize(docs, "documents")
    return docs, block
