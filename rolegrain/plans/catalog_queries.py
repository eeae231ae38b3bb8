"""Queries of the catalog page, its facets, scores and map over the adapted tables, with their SQL."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.functions import places, scores, sectors, skills
from rolegrain.operators import catalog, facets, geo, merge, rules
from rolegrain.operators.catalog import PageRequest
from rolegrain.operators.rules import Profile, Rule
from rolegrain.plans import adapters
from rolegrain.plans.adapters import EVALUATIONS, JOBS, SUBSCORES, score_sql
from rolegrain.sources import markup

GROUPS_SQL = "CASE " + " ".join(
    [f"WHEN lower(trim(coalesce(sector, ''))) IN ({', '.join(repr(x) for x in sectors.BLANK_LABELS)}) THEN '{sectors.UNCATEGORIZED}'"]
    + [f"WHEN regexp_matches(lower(trim(coalesce(sector, ''))), '{p}'){f" AND NOT regexp_matches(lower(trim(coalesce(sector, ''))), '{sectors.EXCEPT[g]}')" if g in sectors.EXCEPT else ''} THEN '{g}'" for g, p in sectors.GROUP_PATTERNS]
    + [f"ELSE '{sectors.OTHER}' END"]
)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapters.evaluations(spark, sf_dir)
    score = scores.compose({c: F.col(c) for c in SUBSCORES})
    return found.select("job_id", score.alias("score"), scores.fit_tier(score).alias("tier"))


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.jobs(spark, sf_dir)
    trackers = jobs.select("id", "status", "is_saved")
    return catalog.combined(jobs.drop("status", "is_saved"), scored(spark, sf_dir), trackers, facets.sector_mapping(jobs))


MAPPED = f"""grouped AS (SELECT sector, count(*) AS n, {GROUPS_SQL} AS grouped FROM jobs GROUP BY sector),
 kept AS (SELECT grouped FROM grouped WHERE grouped NOT IN ('Other', 'Uncategorized') GROUP BY grouped ORDER BY sum(n) DESC, grouped LIMIT 20),
 mapping AS (SELECT sector, CASE WHEN grouped = 'Uncategorized' OR grouped IN (SELECT grouped FROM kept) THEN grouped ELSE 'Other' END AS category FROM grouped)"""
ROWS = f"""WITH {JOBS}, {EVALUATIONS}, {MAPPED}, graded AS (SELECT job_id, {score_sql()} AS s FROM evaluations),
 combined AS (SELECT j.id, j.title, j.company, j.location, j.sector, j.metadata_source, j.pay, j.last_seen_at, j.status, j.is_saved, coalesce(g.s, 0) AS score,
 CASE WHEN g.job_id IS NULL THEN 'Unassessed' WHEN g.s >= 75 THEN 'Strong Match' WHEN g.s >= 55 THEN 'Good Match' WHEN g.s >= 35 THEN 'Moderate Match' WHEN g.s >= 15 THEN 'Low Match' ELSE 'Mismatch' END AS tier,
 coalesce(m.category, 'Uncategorized') AS category FROM jobs j LEFT JOIN graded g ON j.id = g.job_id LEFT JOIN mapping m ON j.sector = m.sector WHERE NOT j.closed)"""
#: The same rows in each availability, whatever their state.
SCOPED = ROWS.replace(" WHERE NOT j.closed)", ")") + """, held AS (SELECT c.*, j.closed AS gone, CASE WHEN c.id % 3 = 1 THEN 'closed' WHEN c.id % 3 = 0 AND c.id % 48 < 24 THEN 'active' ELSE 'unverified' END AS state,
  CASE WHEN c.id % 4 = 0 THEN CAST(c.id % 120 - 60 AS DOUBLE) END AS listed_y, CASE WHEN c.id % 4 = 0 THEN CAST(c.id * 7 % 340 - 170 AS DOUBLE) END AS listed_x,
  CASE WHEN c.id % 4 <> 0 AND c.id % 5 <> 0 AND c.id % 7 <> 0 AND c.location IS NOT NULL THEN c.id % 120 - 60 END AS y, CASE WHEN c.id % 4 <> 0 AND c.id % 5 <> 0 AND c.id % 7 <> 0 AND c.location IS NOT NULL THEN c.id * 7 % 340 - 170 END AS x
  FROM combined c JOIN jobs j USING (id)), scopes AS (SELECT unnest(['active', 'closed', 'unverified', 'all', 'legacy']) AS scope),
 shown AS (SELECT * FROM scopes JOIN held ON scope = 'all' OR (scope = 'legacy' AND NOT gone) OR scope = state)"""
PAGE_COLUMNS = ("id", "title", "company", "location", "pay", "status", "score", "tier", "category")

PAGES: dict[str, tuple[PageRequest, str, str]] = {
    "page_default": (PageRequest(), "true", "score DESC NULLS LAST"),
    "page_salary_asc": (PageRequest(sort="salary", direction="asc", limit=25), "true", "pay ASC NULLS LAST"),
    "page_offset": (PageRequest(sort="date", offset=80, limit=40), "true", "last_seen_at DESC NULLS LAST"),
    "page_location_search": (PageRequest(location="ION_1", sort="company", direction="asc", limit=100), "location ILIKE '%ION\\_1%' ESCAPE '\\'", "company ASC NULLS LAST"),
    "filter_literal_search": (PageRequest(search="1-U", limit=50), "(title ILIKE '%1-U%' OR company ILIKE '%1-U%' OR location ILIKE '%1-U%')", "score DESC NULLS LAST"),
    "filter_threshold": (PageRequest(min_score=60, least_pay=200_000, limit=60), "score >= 60 AND pay >= 200000", "score DESC NULLS LAST"),
    "filter_legacy_exists": (PageRequest(sector="BUILDING", limit=60), "(category = 'BUILDING' OR (sector = 'BUILDING' AND metadata_source IN ('curated', 'watchlist', 'verified')))", "score DESC NULLS LAST"),
    "filter_saved": (PageRequest(status="saved", sort="title", direction="asc", limit=70), "is_saved", "title ASC NULLS LAST"),
}


def one_page(spark: SparkSession, sf_dir: str, request: PageRequest) -> DataFrame:
    return catalog.page(rows(spark, sf_dir), request).select(*PAGE_COLUMNS)


def page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = PageRequest(status="applied", min_score=40, limit=40, offset=400)
    return catalog.page_total(rows(spark, sf_dir), request)


def facet_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.top_counts(rows(spark, sf_dir), "location")


def sector_mapping_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.sector_mapping(adapters.jobs(spark, sf_dir), named=3)


def facet_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.sector_counts(rows(spark, sf_dir))


def sector_groups_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping over free text: each document's text as a label."""
    docs = adapters.table(spark, sf_dir, "documents")
    label = F.concat_ws(" ", F.lit("data"), F.col("text"))
    return docs.select("doc_id", sectors.sector_group(F.when(F.col("doc_id") % 2 == 0, label).otherwise(F.col("text"))).alias("category"))


def histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.histogram(rows(spark, sf_dir))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.stage_summary(rows(spark, sf_dir), ("new", "applied", "interviewing", "offer", "rejected"))


def saved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.saved_summary(rows(spark, sf_dir))


def skill_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ").alias("skills"))
    return facets.skill_frequency(docs, "skills")


def mean_by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rows(spark, sf_dir).withColumn("assessed", F.col("tier") != "Unassessed")
    return facets.mean_by_category(own, own)


def new_by_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.jobs(spark, sf_dir)
    return facets.untouched(jobs.filter(~F.col("closed")), jobs.select("id", "status"))


NOW = "2001-01-01 00:00:00"


def availability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.jobs(spark, sf_dir)
    raw = F.when(F.col("closed"), "closed").when(F.col("status") != "new", "active").otherwise("unverified")
    status = catalog.effective_availability(raw, F.col("last_seen_at"), F.lit(NOW).cast("timestamp_ntz"))
    return jobs.groupBy(status.alias("availability")).agg(F.count("*").alias("n"), F.max("last_seen_at").cast("string").alias("latest"))


def _scoped(spark: SparkSession, sf_dir: str, scope: str) -> DataFrame:
    """The catalog's rows of an availability: checks up to two days old, some places verified and some not."""
    jobs, k = adapters.jobs(spark, sf_dir), F.col("id")
    state = F.when(k % 3 == 0, "active").when(k % 3 == 1, "closed").otherwise("unverified")
    checked = F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (k % 48).cast("int"))
    whole = jobs.withColumns({
        "closed_at": F.when(F.col("closed"), F.col("last_seen_at")), "availability_status": state, "availability_checked_at": checked, "coordinate_source": F.when(k % 4 == 0, "posting").otherwise("geocoded"), "location_status": F.when(k % 5 == 0, "ambiguous").otherwise("verified"),
        "verified_location": F.when(k % 7 == 0, "Elsewhere").otherwise(F.col("location")), "latitude": (k % 120 - 60).cast("double"), "longitude": (k * 7 % 340 - 170).cast("double"), "precision": F.when(k % 2 == 0, "city").otherwise("district"),
    })
    own = scored(spark, sf_dir), jobs.select("id", "status", "is_saved"), facets.sector_mapping(jobs)
    return catalog.scoped(whole.drop("status", "is_saved"), *own, scope, F.lit(NOW).cast("timestamp_ntz"))


def _each_scope(step) -> DataFrame:
    return reduce(DataFrame.unionByName, [step(scope).withColumn("scope", F.lit(scope)) for scope in catalog.SCOPES])


def scoped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of applied jobs in each availability, and how many there are, with the postings' own coordinates."""
    request = PageRequest(status="applied", sort="date", limit=20, offset=20)

    def one(scope: str) -> DataFrame:
        found = _scoped(spark, sf_dir, scope)
        total = catalog.page_total(found, request).select("total")
        return geo.with_coordinates(catalog.page(found, request)).select("id", "availability_status", "score", "category", "list_latitude", "list_longitude").crossJoin(F.broadcast(total))

    return _each_scope(one)


def scoped_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each availability: jobs, those with verified coordinates and those in view, with the clusters in view."""
    bounds = (150.0, -30.0, -120.0, 40.0)

    def one(scope: str) -> DataFrame:
        shown = geo.map_rows(_scoped(spark, sf_dir, scope))
        west, south, east, north = bounds
        pins = geo.clusters(shown.filter(places.in_bounds(F.col("latitude"), F.col("longitude"), south, west, north, east)), 0)
        return geo.map_counts(shown, bounds).join(pins.select("cell_y", "cell_x", "n", "top_ids", "precision"), how="left")

    return _each_scope(one)


def scoped_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each availability: jobs by stage, the good ones and the assessed ones."""
    return _each_scope(lambda scope: _scoped(spark, sf_dir, scope).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= 75).alias("high_fit"), F.count_if(F.col("tier") != "Unassessed").alias("evaluated")))


def score_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def score_recompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sub-scores under other weights than those they were stored with."""
    found = adapters.evaluations(spark, sf_dir)
    return found.select("job_id", scores.compose({c: F.col(c) for c in SUBSCORES}, {"sector": 35, "semantic": 10}).alias("score"))


def tier_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


def score_preview_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).orderBy(F.desc("score"), F.desc("job_id")).limit(5)


def literal_skill_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = adapters.table(spark, sf_dir, "documents")
    return docs.agg(*[F.count_if(skills.has_skill(F.col("text"), s)).alias(f"n{i}") for i, s in enumerate(SKILLS)])


SKILLS = ("the", "und", "CC BY-NC 4.0", " de ", "x", "password", "en, ")


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.jobs(spark, sf_dir).join(scored(spark, sf_dir), F.col("id") == F.col("job_id"))
    return jobs.select("id", ((F.col("employer_id") * 37 % 1800) / 10.0 - 90).alias("latitude"), ((F.col("employer_id") * 91 % 3600) / 10.0 - 180).alias("longitude"), "score", "title", "metadata_source", F.col("metadata_source").alias("precision"))


LOCATED = f"""{JOBS}, {EVALUATIONS}, graded AS (SELECT job_id, {score_sql()} AS score FROM evaluations),
 located AS (SELECT id, (employer_id * 37 % 1800) / 10.0::DOUBLE - 90 AS latitude, (employer_id * 91 % 3600) / 10.0::DOUBLE - 180 AS longitude, score, title, metadata_source AS precision FROM jobs JOIN graded ON id = job_id)"""


def grid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geo.clusters(located(spark, sf_dir), zoom=1)
    return found.select("cell_y", "cell_x", "n", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "title", "precision", "top_ids", "truncated")


def bbox_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box over the date line."""
    return located(spark, sf_dir).filter(places.in_bounds(F.col("latitude"), F.col("longitude"), -30, 170, 30, -160)).select("id", "latitude", "longitude")


def office_unique_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = adapters.jobs(spark, sf_dir).select("id", "employer_id", "location")
    supplier = adapters.table(spark, sf_dir, "supplier").join(adapters.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    offices = supplier.select((F.col("s_suppkey") % 40).alias("employer_id"), F.col("n_name").alias("location"), F.col("s_suppkey").alias("office_id"), (F.col("s_acctbal") > 0).alias("recent"))
    return geo.only_office(jobs.withColumn("employer_id", F.col("employer_id") % 40), offices).select("id", "office_id")


def overlay_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders patched by the last update of each field, one a line item."""
    base = adapters.jobs(spark, sf_dir).select("id", "status", "title")
    items = adapters.table(spark, sf_dir, "lineitem")
    updates = items.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "status").otherwise("title").alias("field"), F.col("l_returnflag").alias("value"), F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey").alias("seq"))
    return merge.overlay(base, updates, "id", ("status", "title"))


QUERIES = {name: partial(one_page, request=request) for name, (request, _, _) in PAGES.items()} | {
    f.__name__: f
    for f in (page_total, facet_locations, sector_mapping_topn, facet_sectors, sector_groups_by_type, histogram_bins, stage_counts, saved_counts, skill_top10, mean_by_sector, new_by_antijoin, availability_counts, scoped_pages, scoped_maps, scoped_overviews, score_compose, score_recompose, tier_counts, score_preview_top5, literal_skill_hits, grid_clusters, bbox_wrap, office_unique_join, overlay_patch)
}


def _hit(i: int, s: str) -> str:
    import re

    needle = s.strip(" ")
    quoted = re.escape(needle).replace("'", "''")
    if not 2 <= len(needle) <= 50:
        return f"CAST(0 AS BIGINT) AS n{i}"
    return rf"count(*) FILTER (WHERE regexp_matches(text, '(?i)(^|[^\pL\pM\pN_]){quoted}($|[^\pL\pM\pN_])')) AS n{i}"


SQL = {name: f"{ROWS} SELECT {', '.join(PAGE_COLUMNS)} FROM combined WHERE {where} ORDER BY {order}, score DESC NULLS LAST, last_seen_at DESC NULLS LAST, id DESC LIMIT {request.page_size} OFFSET {request.start}" for name, (request, where, order) in PAGES.items()} | {
    "page_total": f"{ROWS} SELECT count(*) AS total, CAST(11 AS INTEGER) AS page_number, CAST(40 AS INTEGER) AS page_size FROM combined WHERE status = 'applied' AND score >= 40",
    "facet_locations": f"{ROWS} SELECT location, count(*) AS n FROM combined WHERE trim(location) <> '' GROUP BY location ORDER BY n DESC, location LIMIT 200",
    "sector_mapping_topn": f"WITH {JOBS}, {MAPPED.replace('LIMIT 20', 'LIMIT 3')} SELECT sector, category FROM mapping",
    "facet_sectors": f"{ROWS} SELECT category, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE category WHEN 'Other' THEN 1 WHEN 'Uncategorized' THEN 2 ELSE 0 END, count(*) DESC, category) AS INTEGER) AS place FROM combined GROUP BY category",
    "sector_groups_by_type": f"SELECT doc_id, {GROUPS_SQL} AS category FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data ' || text ELSE text END AS sector FROM documents)",
    "histogram_bins": f"{ROWS} SELECT {', '.join(f'count(*) FILTER (WHERE score >= {10 * i} AND score < {10 * i + 10 + (i == 9)}) AS b{i}' for i in range(10))} FROM combined",
    "stage_counts": f"{ROWS}, stages AS (SELECT unnest(['new', 'applied', 'interviewing', 'offer', 'rejected']) AS status) SELECT s.status, count(c.id) AS n, CAST(coalesce(round(CAST(sum(c.score) AS DECIMAL(18,6)) / count(c.score)), 0) AS INTEGER) AS mean_score FROM stages s LEFT JOIN combined c ON s.status = c.status GROUP BY s.status",
    "saved_counts": f"{ROWS} SELECT count(*) FILTER (WHERE is_saved) AS saved, CAST(coalesce(round(avg(score) FILTER (WHERE is_saved)), 0) AS INTEGER) AS saved_mean FROM combined",
    "skill_top10": "WITH t AS (SELECT trim(unnest(string_split(lower(text), ' '))) AS skill FROM documents), c AS (SELECT skill, count(*) AS n FROM t WHERE skill <> '' GROUP BY skill ORDER BY n DESC, skill LIMIT 10) SELECT skill, n, CAST(round(n * 100.0 / (SELECT count(*) FROM documents)) AS INTEGER) AS percent FROM c",
    "mean_by_sector": f"{ROWS} SELECT category, CAST(coalesce(round(avg(score) FILTER (WHERE tier <> 'Unassessed')), 0) AS INTEGER) AS mean_score FROM combined GROUP BY category",
    "new_by_antijoin": f"WITH {JOBS} SELECT count(*) AS n_new FROM jobs j WHERE NOT closed AND NOT EXISTS (SELECT 1 FROM jobs t WHERE t.id = j.id AND t.status <> 'new')",
    "availability_counts": f"WITH {JOBS}, a AS (SELECT CASE WHEN closed THEN 'closed' WHEN status <> 'new' AND last_seen_at <= TIMESTAMP '{NOW}' AND last_seen_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS THEN 'active' ELSE 'unverified' END AS availability, last_seen_at FROM jobs) SELECT availability, count(*) AS n, CAST(max(last_seen_at) AS VARCHAR) AS latest FROM a GROUP BY availability",
    "scoped_pages": f"{SCOPED}, p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY last_seen_at DESC NULLS LAST, score DESC NULLS LAST, id DESC) AS place, count(*) OVER (PARTITION BY scope) AS total FROM shown WHERE status = 'applied') SELECT scope, id, state AS availability_status, score, category, listed_y AS list_latitude, listed_x AS list_longitude, total FROM p WHERE place BETWEEN 21 AND 40",
    "scoped_maps": f"""{SCOPED}, v AS (SELECT *, y IS NOT NULL AND y BETWEEN -30 AND 40 AND (x >= 150 OR x <= -120) AS seen FROM shown), t AS (SELECT scope, count(*) AS total, count(y) AS mapped, count(*) FILTER (WHERE seen) AS in_view FROM v GROUP BY scope),
 c AS (SELECT scope, id, id % 2 AS odd, CAST(floor(y / 11.25) AS BIGINT) AS cell_y, CAST(floor(x / 11.25) AS BIGINT) AS cell_x, row_number() OVER (PARTITION BY scope, floor(y / 11.25), floor(x / 11.25) ORDER BY score DESC, id) AS place FROM v WHERE seen),
 g AS (SELECT scope, cell_y, cell_x, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 5) AS top_ids, CASE WHEN min(odd) <> max(odd) THEN 'mixed' WHEN min(odd) = 0 THEN 'city' ELSE 'district' END AS precision FROM c GROUP BY scope, cell_y, cell_x) SELECT * FROM t LEFT JOIN g USING (scope)""",
    "scoped_overviews": f"{SCOPED} SELECT scope, status, count(*) AS n, count(*) FILTER (WHERE score >= 75) AS high_fit, count(*) FILTER (WHERE tier <> 'Unassessed') AS evaluated FROM shown GROUP BY scope, status",
    "score_compose": f"WITH {EVALUATIONS}, g AS (SELECT job_id, {score_sql()} AS score FROM evaluations) SELECT job_id, score, CASE WHEN score >= 75 THEN 'Strong Match' WHEN score >= 55 THEN 'Good Match' WHEN score >= 35 THEN 'Moderate Match' WHEN score >= 15 THEN 'Low Match' ELSE 'Mismatch' END AS tier FROM g",
    "score_recompose": f"WITH {EVALUATIONS} SELECT job_id, {score_sql(35, 10)} AS score FROM evaluations",
    "tier_counts": f"{ROWS} SELECT tier, count(*) AS n FROM combined GROUP BY tier",
    "score_preview_top5": f"WITH {EVALUATIONS}, g AS (SELECT job_id, {score_sql()} AS score FROM evaluations) SELECT job_id, score, CASE WHEN score >= 75 THEN 'Strong Match' WHEN score >= 55 THEN 'Good Match' WHEN score >= 35 THEN 'Moderate Match' WHEN score >= 15 THEN 'Low Match' ELSE 'Mismatch' END AS tier FROM g ORDER BY score DESC, job_id DESC LIMIT 5",
    "literal_skill_hits": f"SELECT {', '.join(_hit(i, s) for i, s in enumerate(SKILLS))} FROM documents",
    "grid_clusters": f"""WITH {LOCATED}, cells AS (SELECT *, CAST(floor(latitude / 5.625) AS BIGINT) AS cell_y, CAST(floor(longitude / 5.625) AS BIGINT) AS cell_x FROM located), placed AS (SELECT *, row_number() OVER (PARTITION BY cell_y, cell_x ORDER BY score DESC, id) AS place FROM cells),
 g AS (SELECT cell_y, cell_x, count(*) AS n, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude, min(title) AS title, CASE WHEN min(precision) = max(precision) THEN min(precision) ELSE 'mixed' END AS precision, string_agg(CAST(id AS VARCHAR), ',' ORDER BY place) FILTER (WHERE place <= 5) AS top_ids FROM placed GROUP BY cell_y, cell_x)
 SELECT *, (SELECT count(*) FROM g) > 2000 AS truncated FROM g ORDER BY n DESC, cell_y, cell_x LIMIT 2000""",
    "bbox_wrap": f"WITH {LOCATED} SELECT id, latitude, longitude FROM located WHERE latitude BETWEEN -30 AND 30 AND (longitude >= 170 OR longitude <= -160)",
    "office_unique_join": f"WITH {JOBS}, offices AS (SELECT s_suppkey % 40 AS employer_id, n_name AS location, s_suppkey AS office_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0), one AS (SELECT employer_id, location, min(office_id) AS office_id FROM offices GROUP BY ALL HAVING count(*) = 1) SELECT j.id, o.office_id FROM jobs j JOIN one o ON j.employer_id % 40 = o.employer_id AND j.location = o.location",
    "overlay_patch": f"WITH {JOBS}, u AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'status' ELSE 'title' END AS field, l_returnflag AS value, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS place FROM lineitem) SELECT j.id, coalesce(s.value, j.status) AS status, coalesce(t.value, j.title) AS title FROM jobs j LEFT JOIN u s ON s.id = j.id AND s.field = 'status' AND s.place = 1 LEFT JOIN u t ON t.id = j.id AND t.field = 'title' AND t.place = 1",
}


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sub-scores of documents as postings under one candidate's rules."""
    docs = adapters.table(spark, sf_dir, "documents")
    jobs = docs.select(
        F.col("doc_id").alias("id"), F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("description"), F.col("source").alias("location"), F.col("lang").alias("employment_type"), F.lit("Fintech").alias("sector"), (F.col("doc_id") % 11 / 10.0).alias("similarity"),
        F.col("n_chars").cast("int").alias("salary_min_amount"), F.lit(None).cast("int").alias("salary_max_amount"), F.lit("EUR").alias("salary_currency"), F.lit("annual").alias("salary_period"),
    )
    found = rules.scored(jobs, CANDIDATE)
    return found.select("id", "sector_name", "seniority_name", F.array_join("matched_skills", ",").alias("matched"), *[F.col(c).cast("double").alias(c) for c in RULE_COLUMNS], "relevance", "tier")


RULE_COLUMNS = ("sub_sector", "sub_semantic", "sub_competency", "sub_seniority", "sub_salary", "sub_location", "sub_target_role", "sub_disqualified", "sub_negative_sector")
CANDIDATE = Profile(
    keywords=("the", "und", "nowhere"), target_roles=("of the",), target_locations=("src1", "src2", "of"), salary_min=3000, disqualifiers=("password=", "("), negative_sectors=(Rule(("!!",), "Noise"),),
    positive_sectors=(Rule(("ción",), "Spanish"), Rule(("thin",), "Thin")), seniority_tiers=(Rule(("was",), "Past", 0.7), Rule(("of",), "Of", 2.0)),
)
QUERIES["rule_scores"] = rule_scores
_SKILL = lambda s: rf"regexp_matches(full_text, '(?i)(^|[^\pL\pM\pN_]){s}($|[^\pL\pM\pN_])')"
SQL["rule_scores"] = rf"""WITH j AS (SELECT doc_id AS id, split_part(text, '.', 1) AS title, split_part(text, '.', 1) || ' ' || text AS full_text, source, n_chars, doc_id % 11 / 10.0::DOUBLE AS sim FROM documents),
 s AS (SELECT *, regexp_matches(full_text, '(?i)!!') AS neg, regexp_matches(full_text, '(?i)password=') AS dis, regexp_matches(title, '(?i)ción') AS t1, regexp_matches(title, '(?i)thin') AS t2, regexp_matches(full_text, '(?i)ción') AS f1, regexp_matches(full_text, '(?i)thin') AS f2, regexp_matches(title, '(?i)was') AS past, regexp_matches(title, '(?i)of') AS off,
 {_SKILL('the')} AS k1, {_SKILL('und')} AS k2, {_SKILL('nowhere')} AS k3, {_SKILL('of the')} AS k4, contains(lower(title), 'of the') AS role, lower(full_text || ' ' || source) AS placed FROM j),
 v AS (SELECT id, CASE WHEN neg THEN 'Noise' WHEN t1 THEN 'Spanish' WHEN t2 THEN 'Thin' WHEN f1 THEN 'Spanish' WHEN f2 THEN 'Thin' ELSE 'Fintech' END AS sector_name, CASE WHEN past THEN 'Past' WHEN off THEN 'Of' ELSE 'Professional / Mid-Level' END AS seniority_name,
 array_to_string(list_filter([CASE WHEN k3 THEN 'nowhere' END, CASE WHEN k4 THEN 'of the' END, CASE WHEN k1 THEN 'the' END, CASE WHEN k2 THEN 'und' END], lambda x: x IS NOT NULL), ',') AS matched,
 CASE WHEN neg THEN 0.05 WHEN t1 OR t2 THEN 1.0 WHEN f1 OR f2 THEN 0.8 ELSE 0.5 END::DOUBLE AS sub_sector, sim AS sub_semantic, least(1.0, (k1::INT + k2::INT + k3::INT + k4::INT) / 4.0::DOUBLE * 1.5)::DOUBLE AS sub_competency, CASE WHEN past THEN 0.7 WHEN off THEN 1.0 ELSE 0.5 END::DOUBLE AS sub_seniority,
 CASE WHEN n_chars >= 3000 THEN 1.0 WHEN n_chars < 2400 THEN 0.3 ELSE 0.6 END::DOUBLE AS sub_salary, CASE WHEN contains(placed, 'src1') THEN 1.0 WHEN contains(placed, 'src2') THEN 0.8 WHEN contains(placed, 'of') THEN 0.6 ELSE 0.0 END::DOUBLE AS sub_location, role::INT::DOUBLE AS sub_target_role, dis::INT::DOUBLE AS sub_disqualified, neg::INT::DOUBLE AS sub_negative_sector FROM s),
 d AS (SELECT *, CAST(round(CASE WHEN sub_negative_sector > 0 THEN least(15, CAST(sub_semantic AS DECIMAL(18,6)) * 20 + CAST(sub_sector AS DECIMAL(18,6)) * 10) ELSE CAST(sub_sector AS DECIMAL(18,6)) * 20 + CAST(sub_semantic AS DECIMAL(18,6)) * 25 + CAST(sub_competency AS DECIMAL(18,6)) * 20 + CAST(sub_seniority AS DECIMAL(18,6)) * 15 + CAST(sub_salary AS DECIMAL(18,6)) * 10 + 10 + CAST(sub_target_role AS DECIMAL(18,6)) * 6 + CAST(sub_location AS DECIMAL(18,6)) * 4 END) AS INTEGER) AS raw FROM v),
 r AS (SELECT *, least(CASE WHEN sub_disqualified > 0 THEN 10 ELSE 100 END, greatest(0, least(100, raw))) AS relevance FROM d)
 SELECT * EXCLUDE (raw), CASE WHEN relevance >= 75 THEN 'Strong Match' WHEN relevance >= 55 THEN 'Good Match' WHEN relevance >= 35 THEN 'Moderate Match' WHEN relevance >= 15 THEN 'Low Match' ELSE 'Mismatch' END AS tier FROM r"""


def anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.anchors(adapters.table(spark, sf_dir, "pages")).select("page_id", "pos", "url", "label")


QUERIES["anchor_extract"] = anchor_counts
SQL["anchor_extract"] = r"""WITH a AS (SELECT page_id, url, unnest(range(len(h))) AS pos, h, i FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS i FROM pages))
 SELECT page_id, CAST(pos AS INTEGER) AS pos, regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || h[pos + 1] AS url, trim(i[pos + 1]) AS label FROM a"""
