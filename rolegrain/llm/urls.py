"""URL filter: rules, then the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize

ORDER = 5
BINS = 2001
#: Parts of a difference of log-likelihoods that are summed up as whole numbers, so that no order of rows matters.
UNIT = 1e-9
START, END = b"\x02" * ORDER, b"\x03"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substring(after, F.length(raw) + 1, F.length(url))
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...], value: str) -> Column:
    """A field of the longest rule that fits; of equally long ones, the first."""
    out = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def windows(urls: DataFrame, *keep: str) -> DataFrame:
    """(keep, w, n): for each row, the different runs of ORDER + 1 bytes that end in one of its characters or in its
    end mark, each as a whole number, and how often they come."""
    types = dict(urls.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [START + (x.as_py() or "").encode() + END for x in batch.column("url")]
            data = np.frombuffer(b"".join(each), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])
            w = sum((data[j : len(data) - ORDER + j] << 8 * (ORDER - j) for j in range(ORDER + 1)), np.zeros(max(len(data) - ORDER, 0), np.int64))
            inside = row[: len(w)] == row[ORDER:]
            w, row = w[inside], row[: len(w)][inside]
            order = np.lexsort((w, row))
            w, row = w[order], row[order]
            first = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (row[1:] != row[:-1])]) if len(w) else row
            at = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in keep], pa.array(w[first]), pa.array(np.diff(np.r_[first, len(w)]))], [*keep, "w", "n"])

    return urls.select("url", *keep).mapInArrow(rows, "".join(f"{k} {types[k]}, " for k in keep) + "w long, n long")


def trained(labelled: DataFrame) -> DataFrame:
    """(w, n0, n1): how often rejected and accepted URLs have each run. All counts of the two models are sums of these."""
    n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    return windows(labelled, "label").groupBy("w").agg(n(0).alias("n0"), n(1).alias("n1"))


def log_ratios(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """(w, ratio): for each run of runs, the accepted model's log-probability of its last byte after the bytes before it,
    less the rejected one's, in UNITs. Witten-Bell smoothing goes from no context up to ORDER bytes; a context that a
    model has not seen leaves what the shorter one gave. Each order is a join by its gram and one by its context."""
    out = runs.select("w").distinct().select("w", *[F.lit(1 / 257).alias(f"p{k}") for k in (0, 1)])
    for order in range(ORDER + 1):
        grams = counts.groupBy(F.col("w").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("gram")).agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1)])
        contexts = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(*[F.sum(f"n{k}").alias(f"all{k}") for k in (0, 1)], *[F.count_if(F.col(f"n{k}") > 0).alias(f"kinds{k}") for k in (0, 1)])
        out = out.withColumns({"gram": F.col("w").bitwiseAND((1 << 8 * (order + 1)) - 1), "context": F.shiftright("w", 8).bitwiseAND((1 << 8 * order) - 1)})
        met = out.join(grams, "gram", "left").join(contexts, "context", "left")
        p = lambda k: F.when(F.col(f"all{k}") > 0, (F.coalesce(f"n{k}", F.lit(0)) + F.col(f"kinds{k}") * F.col(f"p{k}")) / (F.col(f"all{k}") + F.col(f"kinds{k}"))).otherwise(F.col(f"p{k}"))
        out = met.select("w", *[p(k).alias(f"p{k}") for k in (0, 1)])
    return out.select("w", F.round((F.log("p1") - F.log("p0")) / UNIT).cast("long").alias("ratio"))


def with_score(urls: DataFrame, ratios: DataFrame | None) -> DataFrame:
    """urls with score: the mean of their runs' ratios; 0 without models. Equal URLs are scored once and met by two
    hashes of 96 bits together."""
    if ratios is None:
        return urls.withColumn("score", F.lit(0.0))
    urls = urls.withColumns({"_long": F.xxhash64("url"), "_short": F.hash("url")})
    sums = windows(urls.select("url", "_long", "_short").distinct(), "_long", "_short").join(ratios, "w").groupBy("_long", "_short")
    scores = sums.agg((F.sum(F.col("n") * F.col("ratio")) * UNIT / F.sum("n")).alias("score"))
    return urls.join(scores, ["_long", "_short"]).drop("_long", "_short")


def calibrated(scored: DataFrame) -> float:
    """The threshold with the smallest sum of the two labels' shares of errors, from histograms of BINS."""
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("score") * 200 + BINS // 2))).cast("int")
    found = np.zeros((2, BINS))
    for r in scored.groupBy("label", place.alias("bin")).count().collect():
        found[r["label"], r["bin"]] = r["count"]
    if not found.any(axis=1).all():
        return 0.0
    share = found / found.sum(axis=1, keepdims=True)
    lost = np.r_[0, np.cumsum(share[1])] + 1 - np.r_[0, np.cumsum(share[0])]  # accepted ones below, rejected ones from there on
    at = np.flatnonzero(lost <= lost.min() + 1e-12)
    return (float(at[len(at) // 2]) - BINS // 2) / 200


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest decides. All URLs
    that a rule decides are the models' accepted and rejected texts, but for a fifth (crc32 of the URL mod 5
    is 0), on which the threshold is calibrated. A URL without a rule is allowed if its score, the
    length-normalised difference of log-likelihoods, reaches the threshold. The models are counts of runs of six
    bytes in tables as large as the URLs make them; scores come from joins with them, at any size alike.

    A null URL or one without :// has an empty host and path; the models read a null one as empty. Repeated
    rows count as often as they come. Without URLs of both labels, scores and threshold are 0 and all else is
    allowed. An empty table gives no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    urls = urls.withColumn("url", F.coalesce("url", F.lit("")))
    urls = urls.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, "text"), "ruled": rule_of(F.col("host"), F.col("path"), rules, "verdict")})
    labelled = urls.filter("ruled is not null").select("url", (F.col("ruled") == "allow").cast("int").alias("label"))
    fold = F.crc32(F.col("url").cast("binary")) % 5 == 0
    counts = materialize(trained(labelled.filter(~fold)), "run_counts")
    seen = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    ratios = materialize(log_ratios(counts, windows(urls)), "log_ratios") if all(seen) else None
    scored = materialize(with_score(urls, ratios), "scored")
    judged = scored.filter("ruled is not null").select("url", "score", (F.col("ruled") == "allow").cast("int").alias("label"))
    threshold = calibrated(judged.filter(fold)) if ratios is not None else 0.0
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
