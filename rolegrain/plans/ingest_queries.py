"""Queries of what decides on and merges incoming postings, over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.functions import addresses, pay, validity
from rolegrain.operators import catalog, geo, ingest
from rolegrain.plans.adapters import table

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def cases(key, values: list[str]):
    """One of the texts by key modulo their number, with {} as the key."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.replace(F.lit(v), F.lit("{}"), key.cast("string"))).otherwise(out)
    return out


def cases_sql(key: str, values: list[str]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''").replace("{}", f"' || {key} || '") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


#: Addresses of postings, and the provider and board of each, written down by hand.
BOARDS = [
    ("https://job-boards.greenhouse.io/Acme{}/jobs/7", "greenhouse", "Acme{}"), ("https://boards-api.greenhouse.io/v1/boards/acme{}", "greenhouse", "boards-api.greenhouse.io/v1/boards/acme{}"), ("https://jobs.lever.co/acme{}?lever=1", "lever", "acme{}"), ("HTTPS://JOBS.ASHBYHQ.COM/Acme%20{}/x", "ashby", "Acme%20{}"),
    ("https://acme{}.bamboohr.com/careers", "bamboohr", "acme{}"), ("https://a{}.jobs.personio.de/job/1", "personio", "a{}"), ("https://acme{}.wd3.myworkdayjobs.com/en-US/Jobs{}/job/Cork", "workday", "acme{}.wd3.myworkdayjobs.com/Jobs{}"), ("https://jobs.dayforcehcm.com/en-US/acme{}/CANDIDATE", "dayforce", "acme{}/CANDIDATE"),
    ("https://Acme{}.rezoomo.com/jobs", "rezoomo", "acme{}"), ("https://www.rezoomo.com/company/acme{}/", "rezoomo", "www.rezoomo.com/company/acme{}"), ("https://careers-acme{}.icims.com/jobs/1", "icims", "careers-acme{}.icims.com"), ("https://acme.ie/careers/{}/?page=2#x", "generic", "acme.ie/careers/{}"),
    ("https://www.linkedin.com/company/acme{}", "linkedin", "www.linkedin.com/company/acme{}"), ("https://u.ukg.net/T{}/JobBoard/0123-4567/", "generic", "u.ukg.net/T{}/JobBoard/0123-4567"), ("https://rec.ukg.net/T{}/JobBoard/01234567-0123-4567-89ab-0123456789ab/?q", "ukg", "rec.ukg.net/T{}/JobBoard/01234567-0123-4567-89ab-0123456789ab"), ("{}", "generic", "{}"),
]
SECRETS = [
    ("https://x.test/a?token=1&b={}#f", "https://x.test/a?b={}"), ("http://x.test:80/p/{}?Authorization=abc", "http://x.test:80/p/{}"), ("https://x.test/?a=1&&b=&c&api_key=2&d={}", "https://x.test/?a=1&d={}"), ("https://u:p@x.test/{}", None), ("ftp://x.test/{}", None), ("https://x.test/{}?SIGNATURE=1&q=x=y&password=", "https://x.test/{}?q=x=y"),
]
DOMAINS = [
    ("https://www.Acme{}.ie/x", "acme{}.ie", "acme{}.ie", "acme{}.ie"), ("acme{}.ie/jobs", "acme{}.ie", None, "acme{}.ie"), ("https://u:p@acme{}.ie", "acme{}.ie", None, None), ("https://10.0.0.1:80/{}", "10.0.0.1", None, "10.0.0.1"), ("https://www.linkedin.com/company/{}", "linkedin.com", "linkedin.com", None), ("https://google.com/{}", "google.com", "google.com", None),
    ("https://youtube.com/{}", "youtube.com", "youtube.com", "youtube.com"), ("ftp://acme{}.ie", "acme{}.ie", None, None), ("https://localhost/{}", None, None, None),
]


def _nth(key: str, values: list) -> str:
    """SQL of one of the values, some null."""
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("{}", f"' || {key} || '") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def board_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    found = addresses.board(cases(key, [u for u, _, _ in BOARDS]))
    return table(spark, sf_dir, "pages").select("page_id", found["provider"].alias("provider"), found["board"].alias("board"))


def url_without_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", addresses.without_secrets(cases(F.col("page_id"), [u for u, _ in SECRETS])).alias("url"))


def company_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = cases(F.col("page_id"), [d[0] for d in DOMAINS])
    return table(spark, sf_dir, "pages").select("page_id", addresses.any_domain(url).alias("any_domain"), addresses.website_domain(url).alias("website"), addresses.company_domain(url).alias("company"))


TITLES = ["", "Senior Engineer {}", "engineer", "London", "Apply now", "Executive jobs 690,514 open jobs", "Page {}", "技術者 {}", "See all {}", "Nurse  Manager\t", "join our team {}", "Skip branding", "{}", "Loading...", "buyer", "Buyers"]
ADDRESSES = ["https://x.test/jobs/{}", "https://x.test/jobs/{}#main", "https://de.linkedin.com/jobs/view/{}", "https://ie.linkedin.com/jobs/view/{}", "https://www.linkedin.com/jobs/search", "https://x.test/en-US/ireland/{}", "https://x.test/job/krakow/ie/{}", "https://x.test/#", ""]
PLACES = ["Dublin, Ireland", "Dublin, OH", "Cork", "Remote", "", "Warsaw, Poland", "Belfast | Glasgow", "flexible", "Austin, TX", "Somewhere", "Berlin, Germany", "Galway or Paris"]


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, whole texts of documents and odd titles, with addresses and places."""
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    k = F.col("k")
    odd = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("odd").alias("kind")).withColumn("title", cases(k, TITLES))
    both = part.select(F.col("p_partkey").alias("k"), F.lit("part").alias("kind"), F.col("p_name").alias("title")).unionByName(docs.select(F.col("doc_id").alias("k"), F.lit("text").alias("kind"), F.col("text").alias("title"))).unionByName(odd)
    return both.withColumns({"url": cases(k, ADDRESSES), "place": cases(k, PLACES), "body": F.when(k % 7 == 0, "Sorry, this job is closed.").otherwise("Apply by May.")})


def title_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).select("kind", "k", validity.valid_title(F.col("title"), F.col("url")).alias("valid"))


def place_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).filter("kind = 'odd'").select("k", validity.valid_place(F.col("place"), F.col("title"), F.col("url")).alias("valid"))


def may_enter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles(spark, sf_dir).filter("kind = 'odd'").select("k", validity.may_enter(*[F.col(c) for c in ("title", "place", "url", "body")]).alias("enters"))


def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    k = F.col("page_id")
    html = F.concat(F.col("html"), cases(k, ["", "Cookie Settings", "Access Denied", "No open roles"]))
    url = cases(k, ["https://x.test/{}", "about:blank", "https://apply.workable.com/oops/{}", "https://x.test/404", "https://x.test/jobs"])
    return pages.select("page_id", validity.failed_page(html, url).alias("failure"), validity.says_empty(html).alias("empty"))


def salary_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, v = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    low, high = F.when(k % 4 < 2, v), F.when(k % 4 != 1, F.when(k % 8 == 0, v).otherwise(v + 5000))
    low, high = F.when(k % 5 != 0, low), F.when(k % 5 != 0, high)
    return o.select("o_orderkey", pay.compact(low, high, cases(k, ["EUR", "USD", "GBP"]), cases(k, ["45,000 - 50, 500 a year", "", "£60,000"])).alias("pay"))


def error_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    code = F.when(k % 4 == 0, 403).when(k % 4 == 1, 429).when(k % 4 == 2, 500)
    found = validity.error_outcome(cases(k, ["http", "challenge", "payload", "response_budget", "snapshot_budget", "request_budget", "other"]), code, k % 8 == 0)
    return e.groupBy(found["status"].alias("status"), found["code"].alias("code")).agg(F.count("*").alias("n"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    long = F.concat(F.lit("Duties of the role: "), F.repeat(F.lit("plan and review work "), 8))
    place = F.when(k % 5 == 0, "Cork").otherwise("Dublin")
    base = lambda key: (F.concat(F.lit("Role "), k % 900).alias("title"), F.concat(F.lit("https://x.test/jobs/"), k % 900).alias("url"), F.lit("Acme").alias("company"), F.lit(False).alias("closed"), F.concat(F.lit(key), k % 900).alias("dedupe_key"))
    # a row per key in the catalog, several per key in the batch
    known = o.filter("o_orderkey % 900 < 700").groupBy((k % 900).alias("g")).agg(F.min("o_orderkey").alias("o_orderkey"))
    catalog = known.select(F.col("o_orderkey").alias("id"), *base("c"), F.lit("Cork").alias("location"), F.when(k % 3 != 0, k).alias("employer_id"), F.when(k % 2 == 0, long).otherwise("stub").alias("description"), F.when(k % 4 == 0, 52.5).alias("latitude"), F.when(k % 4 == 0, -8.5).alias("longitude"), F.when(k % 4 == 0, "posting").alias("coordinate_source"))
    batch = o.filter("o_orderstatus <> 'P'").select(k.alias("pos"), *base("b"), place.alias("location"), F.when(k % 7 == 0, k).alias("employer_id"), F.when(k % 11 == 0, long).otherwise("stub").alias("description"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.lit(None).cast("string").alias("coordinate_source"))
    return batch, catalog


def ingest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.merged_batch(*_batch(spark, sf_dir))
    return found.select("dedupe_key", "pos", "employer_id", "location", F.length("description").alias("n_chars"), "latitude", "coordinate_source")


def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    row = lambda version, vector: e.select(k.alias("id"), F.sha2(F.concat(F.lit(version), k), 256).alias("hash"), F.lit(version).alias("version"), vector.alias("embedding"))
    stored = row("v1", F.col("embedding")).filter("id % 3 <> 0")
    results = row("v2", F.when(k % 5 != 0, F.col("embedding"))).filter("id % 2 = 0").withColumn("expected", F.when(F.col("id") % 8 == 0, "old").otherwise("now"))
    facts = e.select(k.alias("id"), F.lit("now").alias("facts"))
    return ingest.vectors_written(stored, results, facts, 64).groupBy("version").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcomes = e.select(F.when(F.col("event_type") == "error", "failed").otherwise("synced").alias("outcome"), F.col("user_id").alias("persisted"), (F.col("event_id") % 3).alias("failed_writes"), F.when(F.col("event_id") % 2 == 0, F.lit(1)).alias("vectors_pending"))
    return ingest.outcome_totals(outcomes)


def employer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("employer_id"), F.col("o_orderpriority").alias("source"))
    found = ingest.sources_of_employers(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("employer_id"), F.col("c_name").alias("name")))
    return found.withColumn("sources", F.array_join("sources", ","))


def ordered_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    lists = items.groupBy(F.col("l_suppkey").alias("user_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("ids"))
    vectors = table(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return ingest.slice_of(lists, vectors, 3, 10)


def run_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("task_id"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("complete").alias("status"), F.col("o_orderdate").alias("started_at"))
    tasks = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("task_id"), F.col("c_name").alias("source_key"), F.col("c_mktsegment").alias("target"))
    return ingest.runs_of_tasks(runs, tasks).select("run_id", "status", "source_key", "target")


def user_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("job_id"), F.col("l_quantity").cast("int").alias("relevance"))
    jobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), (F.col("p_size") > 40).alias("closed"))
    return ingest.evaluation_list(items, jobs, 3).select("job_id", "relevance", "job.title", "job.closed")


def expired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    token = F.concat(F.lit("t"), F.col("event_id"))
    runs = e.select(F.col("event_id").alias("id"), token.alias("token"), F.when(F.col("event_type") == "view", "running").otherwise("complete").alias("status"), F.when(F.col("event_type") != "view", F.col("ts")).alias("finished_at"))
    claimed = e.filter("event_id % 5 = 0").select(token.alias("token"), F.when(F.col("event_id") % 10 == 0, "running").otherwise("pending").alias("status"))
    return ingest.runs_expired(runs, claimed, now()).groupBy("status").agg(F.count("*").alias("n"), F.max(F.unix_micros(F.col("finished_at").cast("timestamp"))).alias("latest"))


def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    row = lambda status, url, mode: c.select(F.col("c_name").alias("name"), F.lit(status).alias("last_status"), now().alias("last_synced_at"), F.col("c_mktsegment").alias("detail"), k.alias("opportunities_found"), url.alias("url"), mode.alias("mode"))
    base = row("old", F.concat(F.lit("u"), k), F.lit("feed")).filter("opportunities_found % 3 <> 0")
    reports = row("synced", F.when(k % 2 == 0, F.concat(F.lit("n"), k)).otherwise(""), F.lit(None).cast("string")).filter("opportunities_found % 4 <> 1")
    return ingest.states_written(base, reports).select("name", "last_status", "url", "mode")


def restored_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    jobs = o.select(k.alias("id"), (k % 50).alias("employer_id"), k.cast("string").alias("dedupe_key"), F.when(k % 17 == 0, "Other").otherwise("Acme").alias("company"), F.lit("u").alias("url"), cases(k, ["Cork", "Cork (Remote)", "Ireland", "Galway"]).alias("location"))
    baseline = o.select(k.alias("id"), k.cast("string").alias("dedupe_key"), F.lit("Acme").alias("company"), F.lit("u").alias("url"), cases(k, ["Ireland", "remote", "Dublin"]).alias("location"))
    employers = o.select((k % 50).alias("employer_id")).distinct().select("employer_id", F.when(F.col("employer_id") % 2 == 0, "Cork").otherwise("").alias("location"))
    return ingest.places_restored(jobs, baseline, employers)


def availability_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many open rows each scope of the page shows."""
    o = table(spark, sf_dir, "orders")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderdate")).alias("closed_at"), F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "P", "closed").otherwise("unverified").alias("availability_status"), F.col("o_orderdate").alias("availability_checked_at"))
    at = F.lit("1995-01-01 12:00:00").cast("timestamp_ntz")
    each = [catalog.in_scope(jobs, s, at).agg(F.lit(s).alias("scope"), F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids")) for s in catalog.SCOPES]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"), (k % 60).alias("employer_id"), cases(k, ["Cork", "Dublin", "Galway"]).alias("location"), cases(k, ["Cork", "Dublin"]).alias("verified_location"), F.when(k % 5 != 0, "verified").otherwise("ambiguous").alias("location_status"), cases(k, ["city", "district", "street", "country"]).alias("precision"),
        cases(k, ["posting", "geocoded", "none"]).alias("coordinate_source"), (51.5 + k % 40 / 10.0).alias("latitude"), (-10.0 + k % 45 / 10.0).alias("longitude"), (k % 101).cast("int").alias("score"), F.col("o_orderpriority").alias("title"), F.col("o_clerk").alias("company") if "o_clerk" in o.columns else F.col("o_orderpriority").alias("company"),
    )


def shown_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.with_coordinates(_placed(spark, sf_dir)).groupBy("location").agg(F.count("list_latitude").alias("listed"), F.count("map_latitude").alias("mapped"), F.round(F.sum("map_longitude"), 6).alias("longitudes"))


def office_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _placed(spark, sf_dir)
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    offices = s.select((k % 60).alias("employer_id"), F.concat(F.lit("p"), k).alias("place_id"), (51.5 + k % 30 / 10.0).alias("latitude"), (-9.5 + k % 35 / 10.0).alias("longitude"), (now() - F.make_dt_interval(F.when((k % 8 == 0) | (k > 60), 200).otherwise(20))).alias("checked_at"))
    lookups = s.filter("s_suppkey % 7 <> 0").groupBy((k % 60).alias("employer_id")).agg(F.collect_list(F.concat(F.lit("p"), k)).alias("place_ids")).select("employer_id", F.explode(F.array(F.lit("Cork"), F.lit("Dublin"))).alias("location"), "place_ids", F.lit("Acme").alias("employer_name"), F.lit("found").alias("status"), F.lit("2024-02-01").cast("timestamp_ntz").alias("retry_after"))
    employers = s.select((k % 60).alias("employer_id")).distinct().select("employer_id", F.when(F.col("employer_id") % 9 == 0, "Renamed").otherwise("Acme").alias("name"))
    found = geo.office_clusters(jobs, employers, lookups, offices, now(), zoom=8, bounds=(-10.5, 51.0, -5.0, 56.0))
    return found.select("cell_y", "cell_x", "n", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "title", "precision", "top_ids", "truncated")


QUERIES = {
    f.__name__: f
    for f in (
        board_from_url, url_without_secrets, company_domains, title_valid, place_valid, may_enter, page_failures, salary_compact, error_outcomes, ingest_merge, vector_upsert, outcome_totals, employer_sources, ordered_slice, run_tasks, user_evaluations, expired_runs, source_states, restored_places,
        availability_scopes, shown_coordinates, office_clusters,
    )
}

_list = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)
_or = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_re = lambda c, patterns: "(" + " OR ".join(f"regexp_matches({c}, '(?i){p}')" for p in patterns) + ")"
_TITLES = f"""t0 AS (SELECT 'part' AS kind, p_partkey AS k, p_name AS title FROM part UNION ALL SELECT 'text', doc_id, text FROM documents UNION ALL SELECT 'odd', o_orderkey, {cases_sql('o_orderkey', TITLES)} FROM orders),
 t AS (SELECT kind, k, trim(regexp_replace(coalesce(title, ''), '[\\s\\x0B\\x{{85}}\\pZ]+', ' ', 'g')) AS c, lower(coalesce(title, '')) AS name, lower({cases_sql('k', ADDRESSES)}) AS u, lower({cases_sql('k', PLACES)}) AS w, k % 7 = 0 AS shut FROM t0),
 v AS (SELECT *, lower(c) AS l, regexp_replace(regexp_extract(u, '^https?://[^/?#]*([^?#]*)', 1), '/(en|fr|de|es|pt|nl|it|pl)[-_][a-z][a-z]/', '/', 'g') AS path FROM t)"""
_LATIN = "length(regexp_replace(c, '[^a-zA-Z0-9]', '', 'g'))"
_TITLE_OK = f"""length(c) BETWEEN 3 AND 150 AND {_LATIN} >= 3 AND {_LATIN} >= 0.6 * length(c) AND split_part(u, '#', 2) NOT IN ({_list(validity.FRAGMENTS)}) AND NOT {_or('u', validity.URL_PARTS)} AND NOT suffix(u, '#') AND NOT (contains(u, 'linkedin.com/jobs/') AND NOT contains(u, '/view/'))
 AND regexp_extract(u, 'https?://([a-z][a-z])\\.linkedin\\.com', 1) NOT IN ('de') AND l NOT IN ({_list(validity.NO_TITLES)}) AND NOT regexp_matches(l, '\\b\\d[\\d,]*\\s+(open\\s+)?jobs\\b') AND NOT regexp_matches(l, '\\bopen\\s+(jobs|positions)\\b') AND NOT regexp_matches(l, '^page\\s+\\d+$')
 AND (contains(l, ' ') OR l IN ({_list(validity.ONE_WORD)})) AND NOT ({' OR '.join(f"starts_with(l, '{b}')" for b in validity.BEGINNINGS)}) AND NOT {_or('l', validity.PHRASES)}"""
_WHOLE = "name || ' ' || w || ' ' || path"
_PLACE_OK = f"""CASE WHEN w IN ({_list(validity.FOREIGN_PLACES)}) THEN false WHEN {_re(_WHOLE, validity.FOREIGN)} THEN ({_re('w', validity.IRISH_PLACES)} AND NOT regexp_matches(w, 'dublin\\s*,\\s*(oh|ca|va|ga|texas)')) OR (regexp_matches(path, '/(ie|ireland|dublin|cork|galway)/') AND NOT {_re("name || ' ' || path", validity.FOREIGN_ROUTES)})
 ELSE {_re(_WHOLE, [validity.COUNTIES])} OR w IN ('', 'not specified', 'unspecified', 'various', 'hybrid', 'remote') END"""
_HTML = "lower(html || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Cookie Settings' WHEN 2 THEN 'Access Denied' ELSE 'No open roles' END)"
_K = lambda v: f"CASE WHEN {v} < 1000 THEN CAST({v} AS VARCHAR) WHEN ({v} + 50) // 100 % 10 = 0 THEN ({v} + 50) // 1000 || 'k' ELSE ({v} + 50) // 1000 || '.' || ({v} + 50) // 100 % 10 || 'k' END"
_PLACED = """j AS (SELECT o_orderkey AS id, o_orderkey % 60 AS employer_id, CASE o_orderkey % 3 WHEN 0 THEN 'Cork' WHEN 1 THEN 'Dublin' ELSE 'Galway' END AS location, CASE o_orderkey % 2 WHEN 0 THEN 'Cork' ELSE 'Dublin' END AS verified_location, o_orderkey % 5 <> 0 AS verified, CASE o_orderkey % 4 WHEN 0 THEN 'city' WHEN 1 THEN 'district' WHEN 2 THEN 'street' ELSE 'country' END AS precision,
 CASE o_orderkey % 3 WHEN 0 THEN 'posting' WHEN 1 THEN 'geocoded' ELSE 'none' END AS source, 51.5 + o_orderkey % 40 / 10.0 AS latitude, -10.0 + o_orderkey % 45 / 10.0 AS longitude, o_orderkey % 101 AS score, o_orderpriority AS title FROM orders)"""
_LONG = 20 + 8 * len("plan and review work ")

SQL = {
    "board_from_url": f"SELECT page_id, {_nth('page_id', [p for _, p, _ in BOARDS])} AS provider, {_nth('page_id', [b for _, _, b in BOARDS])} AS board FROM pages",
    "url_without_secrets": f"SELECT page_id, {_nth('page_id', [b for _, b in SECRETS])} AS url FROM pages",
    "company_domains": f"SELECT page_id, {_nth('page_id', [d[1] for d in DOMAINS])} AS any_domain, {_nth('page_id', [d[2] for d in DOMAINS])} AS website, {_nth('page_id', [d[3] for d in DOMAINS])} AS company FROM pages",
    "title_valid": f"WITH {_TITLES} SELECT kind, k, {_TITLE_OK} AS valid FROM v",
    "place_valid": f"WITH {_TITLES} SELECT k, {_PLACE_OK} AS valid FROM v WHERE kind = 'odd'",
    "may_enter": f"WITH {_TITLES} SELECT k, {_TITLE_OK} AND ({_PLACE_OK}) AND NOT shut AS enters FROM v WHERE kind = 'odd'",
    "page_failures": f"WITH p AS (SELECT page_id, {_HTML} AS h, page_id % 5 AS a FROM pages) SELECT page_id, CASE WHEN a = 1 THEN 'navigation_failed' WHEN a = 2 THEN 'board_gone' WHEN {_or('h', validity.CHALLENGES)} THEN 'anti_bot' WHEN {_or('h', validity.COOKIE_WALLS)} AND length(h) < 9000 THEN 'cookie_wall' WHEN a = 3 THEN 'not_found' END AS failure, {_or('h', validity.EMPTY_BOARD)} AS empty FROM p",
    "salary_compact": f"""WITH o AS (SELECT o_orderkey, o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders), p AS (SELECT *, CASE WHEN k % 5 <> 0 AND k % 4 < 2 THEN v END AS low, CASE WHEN k % 5 <> 0 AND k % 4 <> 1 THEN CASE WHEN k % 8 = 0 THEN v ELSE v + 5000 END END AS high, CASE k % 3 WHEN 0 THEN '€' WHEN 1 THEN '$' ELSE '£' END AS s FROM o)
 SELECT o_orderkey, CASE WHEN low > 0 AND high > 0 THEN CASE WHEN low = high THEN s || {_K('low')} ELSE s || {_K('low')} || ' - ' || s || {_K('high')} END WHEN high > 0 THEN s || {_K('high')} WHEN low > 0 THEN s || {_K('low')} || '+' ELSE CASE k % 3 WHEN 0 THEN '45k - 50k a year' WHEN 1 THEN 'Competitive' ELSE '£60k' END END AS pay FROM p""",
    "error_outcomes": """WITH e AS (SELECT event_id % 7 AS kind, event_id % 4 AS c, event_id % 8 = 0 AS cool FROM events), f AS (SELECT CASE WHEN kind = 1 OR (kind = 0 AND c < 2) THEN 'blocked' ELSE 'incomplete' END AS status, CASE kind WHEN 0 THEN CASE WHEN c < 2 AND cool THEN 'source_cooldown' WHEN c < 2 THEN 'source_http_denial' ELSE 'source_http_failed' END
 WHEN 1 THEN 'source_content_challenge' WHEN 2 THEN 'source_payload_invalid' WHEN 3 THEN 'source_response_budget_exceeded' WHEN 4 THEN 'source_snapshot_budget_exceeded' WHEN 5 THEN 'browser_request_budget_exceeded' ELSE 'source_acquisition_failed' END AS code FROM e) SELECT status, code, count(*) AS n FROM f GROUP BY ALL""",
    "ingest_merge": f"""WITH b AS (SELECT o_orderkey AS pos, o_orderkey % 900 AS g, CASE WHEN o_orderkey % 5 = 0 THEN 'Cork' ELSE 'Dublin' END AS location, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey END AS employer, CASE WHEN o_orderkey % 11 = 0 THEN {_LONG} ELSE 4 END AS n FROM orders WHERE o_orderstatus <> 'P'),
 c AS (SELECT g, id, CASE WHEN id % 3 <> 0 THEN id END AS employer, CASE WHEN id % 2 = 0 THEN {_LONG} ELSE 4 END AS n, id % 4 = 0 AS placed FROM (SELECT o_orderkey % 900 AS g, min(o_orderkey) AS id FROM orders WHERE o_orderkey % 900 < 700 GROUP BY 1)),
 m AS (SELECT b.*, c.id IS NOT NULL AND b.location = 'Cork' AS alias, c.employer AS known FROM b LEFT JOIN c ON b.g = c.g), k AS (SELECT *, CASE WHEN alias THEN 'c' ELSE 'b' END || g AS dedupe_key, CASE WHEN alias THEN coalesce(known, employer) ELSE employer END AS own FROM m), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY pos DESC) = 1)
 SELECT dedupe_key, pos, CASE WHEN alias THEN coalesce(own, c.employer) ELSE own END AS employer_id, location, CAST(CASE WHEN alias AND l.n = 4 THEN c.n ELSE l.n END AS INTEGER) AS n_chars, CASE WHEN alias AND c.placed THEN 52.5 END AS latitude, CASE WHEN alias AND c.placed THEN 'posting' END AS coordinate_source FROM l LEFT JOIN c ON l.g = c.g""",
    "vector_upsert": "WITH e AS (SELECT vec_id AS id, vec_id % 3 <> 0 AS had, vec_id % 2 = 0 AND vec_id % 8 <> 0 AS hit, vec_id % 5 <> 0 AS filled FROM embeddings), a AS (SELECT id, CASE WHEN hit THEN CASE WHEN filled THEN 'v2' END WHEN had THEN 'v1' END AS version FROM e) SELECT version, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM a WHERE version IS NOT NULL GROUP BY version",
    "outcome_totals": "SELECT CAST(sum(user_id) AS BIGINT) AS persisted, CAST(sum(event_id % 3) AS BIGINT) AS failed_writes, count(*) FILTER (WHERE event_id % 2 = 0) AS vectors_pending, count(*) FILTER (WHERE event_type = 'error') AS failed_sources, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'incomplete' ELSE 'complete' END AS status FROM events",
    "employer_sources": "SELECT o_custkey AS employer_id, count(*) AS n_jobs, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS sources, any_value(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 10 <> 0 GROUP BY o_custkey",
    "ordered_slice": "WITH p AS (SELECT l_suppkey AS user_id, l_partkey AS id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem) SELECT user_id, CAST(place AS INTEGER) AS place, id, p_size AS size FROM p JOIN part ON id = p_partkey WHERE place BETWEEN 3 AND 10 AND id % 3 <> 0",
    "run_tasks": "SELECT o_orderkey AS run_id, 'complete' AS status, c_name AS source_key, c_mktsegment AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' AND c_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "user_evaluations": "SELECT l_partkey AS job_id, CAST(l_quantity AS INTEGER) AS relevance, p_name AS title, p_size > 40 AS closed FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 3",
    "expired_runs": f"WITH r AS (SELECT CASE WHEN event_type <> 'view' THEN 'complete' WHEN event_id % 10 = 0 THEN 'expired' ELSE 'running' END AS status, CASE WHEN event_type <> 'view' THEN ts WHEN event_id % 10 = 0 THEN TIMESTAMP '{NOW}' END AS finished FROM events) SELECT status, count(*) AS n, epoch_us(max(finished)) AS latest FROM r GROUP BY status",
    "source_states": "WITH c AS (SELECT c_name AS name, c_custkey AS k, c_custkey % 3 <> 0 AS had, c_custkey % 4 <> 1 AS told FROM customer) SELECT name, CASE WHEN told THEN 'synced' ELSE 'old' END AS last_status, CASE WHEN told AND k % 2 = 0 THEN 'n' || k WHEN had THEN 'u' || k ELSE 'https://google.com' END AS url, CASE WHEN had THEN 'feed' ELSE 'company crawler' END AS mode FROM c WHERE had OR told",
    "restored_places": "WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Cork' WHEN 1 THEN 'Cork (Remote)' WHEN 2 THEN 'Ireland' ELSE 'Galway' END AS place, CASE o_orderkey % 3 WHEN 0 THEN 'Ireland' WHEN 1 THEN 'Ireland (Remote)' ELSE 'Dublin, Ireland' END AS old FROM orders WHERE o_orderkey % 17 <> 0 AND o_orderkey % 50 % 2 = 0) SELECT id, old AS location FROM o WHERE old LIKE 'Ireland%' AND place LIKE 'Cork%'",
    "availability_scopes": """WITH j AS (SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS gone, CASE WHEN o_orderstatus = 'P' THEN 'closed' WHEN o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1995-01-01 12:00:00' - INTERVAL 24 HOURS AND o_orderdate <= TIMESTAMP '1995-01-01 12:00:00' THEN 'active' ELSE 'unverified' END AS state FROM orders), s AS (SELECT unnest(['active', 'closed', 'unverified', 'all', 'legacy']) AS scope)
 SELECT scope, count(id) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM s LEFT JOIN j ON scope = 'all' OR (scope = 'legacy' AND NOT gone) OR scope = state GROUP BY scope""",
    "shown_coordinates": f"WITH {_PLACED} SELECT location, count(*) FILTER (WHERE source = 'posting') AS listed, count(*) FILTER (WHERE source = 'geocoded' AND verified AND location = verified_location) AS mapped, round(sum(longitude) FILTER (WHERE source = 'geocoded' AND verified AND location = verified_location), 6) AS longitudes FROM j GROUP BY location",
    "office_clusters": f"""WITH {_PLACED}, l AS (SELECT s_suppkey % 60 AS employer_id, s_suppkey AS place FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 60 % 9 <> 0), f AS (SELECT employer_id, min(51.5 + place % 30 / 10.0) AS latitude, min(-9.5 + place % 35 / 10.0) AS longitude FROM l WHERE place % 8 <> 0 AND place <= 60 GROUP BY employer_id HAVING count(*) = 1),
 o AS (SELECT j.id, j.score, j.title, f.latitude, f.longitude, CAST(floor(f.latitude / (360.0 / 8192)) AS BIGINT) AS cell_y, CAST(floor(f.longitude / (360.0 / 8192)) AS BIGINT) AS cell_x FROM j JOIN f USING (employer_id) WHERE j.location IN ('Cork', 'Dublin') AND verified AND location = verified_location AND precision IN ('city', 'district')),
 p AS (SELECT *, row_number() OVER (PARTITION BY cell_y, cell_x ORDER BY score DESC, id) AS place FROM o)
 SELECT cell_y, cell_x, count(*) AS n, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, min(title) AS title, 'company_office' AS precision, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 5) AS top_ids, false AS truncated FROM p GROUP BY cell_y, cell_x""",
}
