"""Language ID by fusing text likelihoods with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.llm.shared import materialize, text_batches
from rolegrain.llm.textvec import LOWER, text_chunks

BUCKETS = 1 << 14
NONE = "und"
#: Country suffixes that speak for one language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en", "au": "en"}
#: Labels under a country suffix below which domains are given out.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A text's log-likelihood weighs as that of n * DEPTH / (n + DEPTH) independent trigrams.
DEPTH = 60.0


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each byte trigram of lower-cased text with other ASCII than letters as space, its row's
    first trigram, trigrams of each row). Trigrams don't cross rows."""
    low = LOWER[data]
    low = np.where((low < 128) & ((low < 97) | (low > 122)), np.uint8(32), low)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    wide = low.astype(np.uint32)
    h = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18)
    n = np.maximum(np.diff(offsets) - 2, 0)
    inside = np.ones(len(h), bool)
    for back in (1, 2):
        at = offsets[1:-1] - back
        inside[at[(at >= 0) & (at < len(h))]] = False
    blank = (low[:-2] == 32) & (low[1:-1] == 32) & (low[2:] == 32)
    keep = np.flatnonzero(inside & ~blank)
    first = np.searchsorted(keep, offsets[:-1])
    n = np.searchsorted(keep, offsets[1:]) - first
    return h[keep].astype(np.int64), first, n


def trained(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Counts of the buckets, one more each: a line per language, from all rows that declare it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in batches:
            code = np.array([languages.index(x) if x in languages else -1 for x in batch.column("declared").to_pylist()])
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                h, _, n = trigrams(data, offsets)
                language = np.repeat(code[lo:hi], n)
                total += np.bincount(h[language >= 0] + BUCKETS * language[language >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.ones(len(languages) * BUCKETS)
    for r in rows.select("text", "declared").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts[r["bucket"]] += r["n"]
    return counts.reshape(len(languages), BUCKETS)


def log_likelihoods(counts: np.ndarray, declared: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each row's trigrams, under each language and, last, under a uniform model. A row that declares a language was
    counted for it; there it is judged by what the other rows leave."""
    row = np.repeat(np.arange(len(n)), n)
    out = np.empty((len(n), len(counts) + 1))
    for k, line in enumerate(np.log(counts)):
        out[:, k] = np.bincount(row, line[h], len(n)) - n * np.log(counts[k].sum())
    out[:, -1] = n * -np.log(BUCKETS)
    mine = declared[row] >= 0
    if mine.any():
        _, back, own = np.unique(row[mine] * BUCKETS + h[mine], return_inverse=True, return_counts=True)
        rest = counts[declared[row[mine]], h[mine]] - own[back]
        known = np.flatnonzero(declared >= 0)
        out[known, declared[known]] = np.bincount(row[mine], np.log(rest), len(n))[known] - n[known] * np.log(counts.sum(axis=1)[declared[known]] - n[known])
    return out


def softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def smoothed(sums: Column, above: Column, weight: float) -> Column:
    return F.zip_with(sums, above, lambda a, b: (a + weight * b) / (total(sums) + weight))


def judged(rows: DataFrame, keys: list[str], languages: tuple[str, ...] = ("de", "en", "es", "fr"), declared_trust: float = 0.9, suffix_trust: float = 0.7, smoothing: float = 20.0, least: float = 0.6) -> DataFrame:
    """One row per row of `rows`: keys, declared, language, posterior, accepted.

    Rows have text, declared (the language their markup or record declares), host and suffix (the last label
    of the address). Text likelihoods come from byte trigrams of all other rows that declare a language; `und`
    stands for text without one, under a uniform model. A declared language that is one of `languages` is
    right with odds of declared_trust, a country suffix with suffix_trust; others are no evidence. Priors:
    what text and declaration say alone is summed by host, domain and over all, each row without its own
    share, and each level is smoothed by smoothing rows of the level above. The sums are grouped aggregates;
    a host's reach its rows by a join, as hosts have no bound.

    A row is accepted if its best language is not `und`, has a posterior of `least` or more and its text has
    trigrams. Null and empty texts have none: their language is what the other evidence says, and they are
    not accepted. Null hosts and suffixes are one empty host. Ties go to the first language. Repeated rows
    each get their row. An empty table gives no rows.
    """
    spark = rows.sparkSession
    text_batches(spark)
    names, width = (*languages, NONE), len(languages) + 1
    rows = rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in ("text", "declared")], *[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in ("host", "suffix")])
    model = spark.sparkContext.broadcast(trained(rows, languages))
    kept = [*keys, "declared", "host", "suffix"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [np.zeros((0, width))], [np.zeros(0, np.int64)]
            code = np.array([languages.index(x) if x in languages else -1 for x in batch.column("declared").to_pylist()], np.int64)
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                h, _, n = trigrams(data, offsets)
                found.append(log_likelihoods(model.value, code[lo:hi], h, n) * (DEPTH / (n + DEPTH))[:, None])
                sizes.append(n)
            each = np.concatenate(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * width), pa.array(each.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists, pa.array(np.concatenate(sizes))], [*kept, "likelihood", "trigrams"])

    types = dict(rows.dtypes)
    weighed = rows.mapInArrow(weigh, ", ".join(f"{c} {types[c]}" for c in kept) + ", likelihood array<double>, trigrams long")
    declared = lambda x: F.when(~F.col("declared").isin(*languages) | F.col("declared").isNull(), 0.0).when(F.col("declared") == x, float(np.log(declared_trust))).otherwise(float(np.log((1 - declared_trust) / (width - 1))))
    own = F.array(*[F.col("likelihood")[k] + declared(x) for k, x in enumerate(names)])
    domain = F.regexp_extract("host", rf"([^.]*\.)?((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}|[^.]*)$", 0)
    weighed = materialize(weighed.withColumns({"evidence": own, "share": softmax(own), "domain": domain}), "weighed")

    sums = [F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(width)]
    hosts = materialize(weighed.groupBy("host", "domain").agg(*sums), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(f"s{k}") for k in range(width)]).alias("of_domain"))
    whole = [float(x or 0) for x in hosts.agg(*[F.sum(f"s{k}") for k in range(width)]).first()]
    levels = hosts.select("host", "domain", F.array(*[f"s{k}" for k in range(width)]).alias("of_host")).join(domains, "domain").drop("domain")
    joined = weighed.join(levels, "host")
    without = lambda sums: F.zip_with(sums, "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    prior = F.transform(without(F.array(*map(F.lit, whole))), lambda x: (x + 1) / (F.lit(max(sum(whole) - 1, 0.0)) + width))
    for level in ("of_domain", "of_host"):
        rest = without(F.col(level))
        prior = smoothed(rest, prior, smoothing)
    spoken = reduce(lambda out, item: out.when(F.col("suffix") == item[0], item[1]), SUFFIXES.items(), F.when(F.lit(False), ""))
    by_suffix = lambda x: F.when(F.col("spoken").isNull() | ~F.col("spoken").isin(*languages), 0.0).when(F.col("spoken") == x, float(np.log(suffix_trust))).otherwise(float(np.log((1 - suffix_trust) / (width - 1))))
    fused = joined.withColumn("prior", prior).withColumn("spoken", spoken).withColumn("chance", softmax(F.array(*[F.col("evidence")[k] + F.log(F.col("prior")[k]) + by_suffix(x) for k, x in enumerate(names)])))
    best = F.array_position("chance", F.array_max("chance")).cast("int")
    named = fused.select(*keys, "declared", "trigrams", F.element_at(F.array(*map(F.lit, names)), best).alias("language"), F.array_max("chance").alias("posterior"))
    return named.select(*keys, "declared", "language", "posterior", ((F.col("language") != NONE) & (F.col("posterior") >= least) & (F.col("trigrams") > 0)).alias("accepted"))


def document_rows(docs: DataFrame) -> DataFrame:
    """A document's record declares its language, its source is its host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit("").alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """A page's html element declares its language; its text is what remains without markup."""
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    host = F.regexp_extract(url, r"://([^/?#:]*)", 1)
    text = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return pages.select(F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.when(declared != "", declared).alias("declared"), host.alias("host"), F.regexp_extract(host, r"[^.]*$", 0).alias("suffix"))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """docs without those whose language ID is not accepted: null and empty texts always go. Each row goes or stays by
    its own text; rows equal in doc_id (null included), text, language and source share a decision, and it is made
    once more for each. An empty table stays empty; columns keep their names and values, whatever they are called.
    Only the rows that go are joined, by a hash and their doc_id."""
    rows = document_rows(docs).withColumn("row_hash", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("text", "declared", "host")]))
    by_key = judged(rows, ["doc_id", "row_hash"]).groupBy("doc_id", "row_hash").agg(F.bool_or("accepted").alias("accepted"))
    gone = materialize(by_key.filter("not accepted").select("doc_id", "row_hash"), "gone").alias("gone")
    all_rows = docs.alias("docs")
    text, lang, source = (F.coalesce(F.col(f"docs.{c}").cast("string"), F.lit("\x00")) for c in ("text", "lang", "source"))
    return all_rows.join(gone, (F.xxhash64(text, lang, source) == F.col("gone.row_hash")) & F.col("docs.doc_id").cast("long").eqNullSafe(F.col("gone.doc_id")), "left_anti")
