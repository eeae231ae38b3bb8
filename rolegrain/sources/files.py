"""Reading registries, dumps and stored responses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE_BYTES = 1 << 20
IMPORT_BOX = (51.3, 55.5, -10.8, -5.3)


def registry(spark: SparkSession, path: str, schema: str = "name string, sector string, aliases array<string>") -> DataFrame:
    """An evidence file by lower-case alias; an alias of two entries fails the job."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    each = rows.withColumn("alias", F.explode(F.array_distinct(F.transform("aliases", lambda a: F.lower(F.trim(a))))))
    doubled = each.groupBy("alias").agg(F.count("*").alias("_n"))
    checked = doubled.select(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("two entries for "), F.col("alias"))).cast("string")).otherwise(F.col("alias")).alias("alias"))
    return each.join(checked, "alias")


def companies_csv(spark: SparkSession, path: str, address: tuple[str, ...] = ("company_address_1", "company_address_2", "company_address_3", "company_address_4")) -> DataFrame:
    """Company rows with one address and an identity from number and content; all fields are text."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"company_num", "company_name", *address} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    parts = [F.nullif(F.trim(c), F.lit("")) for c in address]
    identity = F.concat(F.col("company_num"), F.lit(":"), F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256))
    return rows.select(identity.alias("identity"), F.col("company_num").alias("company_number"), F.trim("company_name").alias("name"), F.concat_ws(", ", *parts).alias("address"), F.col("company_status").alias("status"))


def places_jsonl(spark: SparkSession, path: str, country: str = "IE") -> DataFrame:
    """Place records, a line each: those with an address in the country; a coordinate outside the box and a
    line over a mebibyte fail the job."""
    schema = "id string, names struct<primary string>, addresses array<struct<freeform string, locality string, country string>>, latitude double, longitude double, confidence double"
    lines = spark.read.text(path).withColumn("value", F.when(F.octet_length("value") > LINE_BYTES, F.raise_error(F.lit("a line is too long")).cast("string")).otherwise(F.col("value")))
    rows = lines.select(F.from_json("value", schema).alias("r")).select("r.*")
    here = F.try_element_at(F.filter("addresses", lambda a: a["country"] == country), F.lit(1))
    south, north, west, east = IMPORT_BOX
    inside = F.col("latitude").between(south, north) & F.col("longitude").between(west, east)
    found = rows.withColumn("here", here).filter("here is not null")
    return found.withColumn("latitude", F.when(inside, F.col("latitude")).otherwise(F.raise_error(F.concat(F.lit("outside the box: "), F.col("id"))).cast("double"))).select("id", F.col("names.primary").alias("name"), F.col("here.freeform").alias("address"), F.col("here.locality").alias("city"), "latitude", "longitude", "confidence")


def dump_table(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """One table's rows of a SQL dump: the section after its COPY line, tab-separated, with \\N for null and
    backslash escapes. The dump is read by lines in parallel; pos, a line's stretch of the file and its place there,
    orders them, and the section lies between the first lines that begin and end it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(place.alias("pos"), "value")
    begins = lines.filter(F.col("value").rlike(rf"^COPY .*\b{table}\b.* FROM stdin;$")).agg(F.min("pos").alias("_from"))
    ends = lines.filter("value = '\\\\.'").crossJoin(begins).filter("pos > _from").agg(F.first("_from").alias("_from"), F.min("pos").alias("_to"))
    rows = lines.crossJoin(ends).filter("pos > _from and pos < _to and value <> ''").withColumn("v", F.split("value", "\t", -1))

    def value(c: Column) -> Column:
        out = F.replace(c, F.lit("\\\\"), F.lit("\x01"))
        for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
            out = F.replace(out, F.lit(escape), F.lit(char))
        return F.when(c != "\\N", F.replace(out, F.lit("\x01"), F.lit("\\")))

    return rows.select("pos", *[value(F.col("v")[i]).alias(c) for i, c in enumerate(columns)])


def responses(spark: SparkSession, path: str) -> DataFrame:
    """Stored bodies by their checksum: (path, digest, body); one whose file name is not its checksum fails."""
    files = spark.read.format("binaryFile").load(path)
    digest = F.sha2("content", 256)
    named = F.regexp_extract("path", r"([0-9a-f]{64})(?:\.\w+)?$", 1)
    checked = F.when((named == "") | (named == digest), digest).otherwise(F.raise_error(F.concat(F.lit("changed: "), F.col("path"))).cast("string"))
    return files.select("path", checked.alias("digest"), F.col("content").cast("string").alias("body"))


def scan_all(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """rows, or an error if there are more than most."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


TARGET = "name string, sector string, priority int, careers_url string, enabled boolean, scraper string, scraper_type string, notes string"


def targets(spark: SparkSession, path: str, stored: DataFrame | None) -> DataFrame:
    """Crawl targets: those of the store, also if it has none; where the store is unavailable (None) those of a YAML or JSON
    list. An entry without a name or address, or with an enabled that is no boolean, is an error, and so is an empty list."""
    if stored is not None:
        return stored
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    if path.endswith((".yaml", ".yml")):
        import yaml

        parsed = yaml.safe_load(text)
    else:
        parsed = json.loads(text)
    items = parsed.get("websites") if isinstance(parsed, dict) else parsed
    if not isinstance(items, list) or not items:
        raise ValueError(f"no list of targets: {path}")
    defaults = {"sector": "General", "priority": 50, "enabled": True, "scraper": "generic_crawler", "scraper_type": "watchlist", "notes": ""}
    rows = []
    for n, item in enumerate(items, 1):
        entry = defaults | (item if isinstance(item, dict) else {})
        if not entry.get("name") or not entry.get("careers_url") or not isinstance(entry["enabled"], bool):
            raise ValueError(f"target {n} of {path} is invalid")
        rows.append(tuple(str(v).strip() if isinstance(v, str) else v for v in (entry[c.split()[0]] for c in TARGET.split(", "))))
    return spark.createDataFrame(rows, TARGET)


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as one file of a folder, JSON lines or CSV with a header; the folder is there only once it is whole."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).format(kind).save(path)
