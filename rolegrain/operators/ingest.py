"""What a run brings in: merging it with the catalog, its vectors, totals and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.addresses import name_key
from rolegrain.functions.identity import canonical_url, company_name, is_posting_url
from rolegrain.functions.places import display_place
from rolegrain.functions.text import has_body
from rolegrain.operators.merge import merge
from rolegrain.operators.vectors import usable

# Places that a repair may bring back, work modes, states of companies that are gone.
WHOLE_COUNTRY = ("Ireland", "Ireland (Hybrid)", "Ireland (Remote)", "Ireland (On-site)")
MODES = ("Hybrid", "Remote", "On-site")
GONE = ("dissolved", "closed", "permanently_closed")
SUCCESSES = ("synced", "empty")


def _spaced(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def merged_batch(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """A batch as it is to be written, a row per dedupe_key. Both have dedupe_key, url, title, company, location, closed,
    employer_id, description, latitude, longitude and coordinate_source; catalog has id, batch pos.

    An item whose catalog rows of its URL are all the same posting takes the key and company of the one with a body and
    the lowest id. Two are one posting with one canonical URL, title, place and state, and a posting's URL or one company;
    blank titles and places agree with nothing. Of one key the last item counts. Then what the catalog knows under the key is kept where the item has
    less: the employer, a posting's own coordinates while the place is the same, and a body against a stub."""
    facts = lambda rows: rows.withColumns({"_at": canonical_url(F.col("url")), "_title": _spaced(F.col("title")), "_place": _spaced(F.col("location")), "_company": company_name(F.coalesce("company", F.lit("")))})
    best = F.struct(has_body(F.col("description")).alias("body"), (-F.col("id")).alias("low"))
    # a URL's catalog rows as one row: they are all one posting with an item if the least and the greatest of each fact are the item's
    ends = [f(c).alias(f"{c}_{n}") for c in ("_title", "_place", "closed", "_company") for n, f in (("low", F.min), ("high", F.max))]
    known = facts(catalog).filter("_at <> ''").groupBy("_at").agg(F.max_by(F.struct("dedupe_key", "company", "employer_id"), best).alias("keeper"), *ends).withColumn("_posting", is_posting_url(F.col("_at")))
    both_are = lambda c: (F.col(c) == F.col(f"{c}_low")) & (F.col(c) == F.col(f"{c}_high"))
    same = (F.col("_title") != "") & (F.col("_place") != "") & both_are("_title") & both_are("_place") & both_are("closed") & (F.col("_posting") | ((F.col("_company") != "") & both_are("_company")))
    joined = facts(batch).join(known, "_at", "left").withColumn("keeper", F.when(same, F.col("keeper")))
    named = joined.withColumns({
        "dedupe_key": F.coalesce("keeper.dedupe_key", "dedupe_key"), "company": F.when(F.col("keeper").isNotNull(), F.col("keeper.company")).otherwise(F.col("company")), "employer_id": F.coalesce("keeper.employer_id", "employer_id"),
    }).drop("keeper")
    last = named.groupBy("dedupe_key").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "dedupe_key"]), "pos").alias("item")).select("dedupe_key", "item.*")
    old = catalog.select("dedupe_key", *[F.col(c).alias(f"old_{c}") for c in ("employer_id", "location", "description", "latitude", "longitude", "coordinate_source")])
    both = last.join(old, "dedupe_key", "left")
    placed = F.col("coordinate_source").isNull() & (F.col("old_coordinate_source") == "posting") & (F.col("old_location") == F.col("location"))
    kept = {c: F.when(placed, F.col(f"old_{c}")).otherwise(F.col(c)) for c in ("latitude", "longitude", "coordinate_source")}
    body = F.when(~has_body(F.col("description")) & has_body(F.col("old_description")), F.col("old_description")).otherwise(F.col("description"))
    return both.withColumns({**kept, "employer_id": F.coalesce("employer_id", "old_employer_id"), "description": body}).select(*batch.columns)


def vectors_written(stored: DataFrame, results: DataFrame, facts: DataFrame, width: int = 384) -> DataFrame:
    """stored vectors (id, hash, version, embedding) after results (the same and expected, the hash of the facts that
    were embedded): a result counts only while the job's facts (id, facts) are those; one without a vector removes the
    stored one, one with an unusable vector or hash is an error."""
    current = results.join(facts, "id").filter(F.col("expected").eqNullSafe(F.col("facts")))
    bad = F.col("embedding").isNotNull() & ~(usable(F.col("embedding"), width) & F.coalesce((F.length("hash") == 64) & F.length("version").between(1, 200), F.lit(False)))
    checked = current.withColumn("embedding", F.when(~bad, F.col("embedding")).when(bad, F.raise_error(F.lit("invalid job vector"))))
    after = merge(stored, checked.select(*stored.columns), ["id"])
    return after.filter("embedding is not null")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row: persisted, failed_writes and vectors_pending in all, failed_sources, and a status by them."""
    failed = F.count_if(~F.coalesce(F.col("outcome").isin(*SUCCESSES), F.lit(False)))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("persisted", "failed_writes", "vectors_pending")]
    return outcomes.agg(*sums, failed.alias("failed_sources"), F.when(failed > 0, "incomplete").otherwise("complete").alias("status"))


def sources_of_employers(jobs: DataFrame, employers: DataFrame) -> DataFrame:
    """By known employer: its jobs and their different sources, in order."""
    each = jobs.filter("employer_id is not null").groupBy("employer_id").agg(F.count("*").alias("n_jobs"), F.array_sort(F.collect_set("source")).alias("sources"))
    return each.join(employers.select("employer_id", "name"), "employer_id")


def slice_of(lists: DataFrame, vectors: DataFrame, begin: int, end: int) -> DataFrame:
    """The vectors of places begin to end (from 1, both inside) of each list of job ids, in order; ids without one are
    left out. lists: user_id, ids."""
    places = lists.select("user_id", F.posexplode(F.slice("ids", begin, end - begin + 1)).alias("place", "id"))
    return places.join(vectors, "id").select("user_id", (F.col("place") + begin).alias("place"), "id", *[c for c in vectors.columns if c != "id"])


def runs_of_tasks(runs: DataFrame, tasks: DataFrame, limit: int = 100) -> DataFrame:
    """The latest finished runs with their task's source_key and target."""
    return runs.filter("status <> 'running'").join(tasks.select("task_id", "source_key", "target"), "task_id").orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def evaluation_list(evaluations: DataFrame, jobs: DataFrame, user) -> DataFrame:
    """A user's evaluations with their jobs, the highest first."""
    own = evaluations.filter(F.col("user_id") == user)
    return own.join(jobs.select(F.col("id").alias("job_id"), F.struct("title", "company", "closed").alias("job")), "job_id").orderBy(F.desc("relevance"), F.desc("job_id"))


def runs_expired(runs: DataFrame, claimed: DataFrame, now: Column) -> DataFrame:
    """runs after claims: a running run whose lease was taken over (a claimed task that was running, by its old token)
    has expired."""
    gone = claimed.filter("status = 'running'").select(F.col("token").alias("_token")).distinct()
    joined = runs.join(gone, runs["token"] == F.col("_token"), "left")
    over = (F.col("status") == "running") & F.col("_token").isNotNull()
    return joined.withColumns({"status": F.when(over, "expired").otherwise(F.col("status")), "finished_at": F.when(over, now).otherwise(F.col("finished_at"))}).select(*runs.columns)


def states_written(base: DataFrame, reports: DataFrame, url: str = "https://google.com", mode: str = "company crawler") -> DataFrame:
    """Sources (name, last_status, last_synced_at, detail, opportunities_found, url, mode) after reports of runs: blank
    addresses and modes keep what is known; a new source gets set ones."""
    given = reports.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("url", "mode")})
    after = merge(base, given, ["name"], {"url": "fill", "mode": "fill"})
    return after.withColumns({"url": F.coalesce("url", F.lit(url)), "mode": F.coalesce("mode", F.lit(mode))})


def crawl_targets(boards: DataFrame, now: Column, employer: str | None = None, limit: int | None = None) -> DataFrame:
    """Enabled boards that don't cool down, of one employer if it is named, the first by priority and id."""
    due = boards.filter(F.coalesce(F.col("enabled"), F.lit(True)) & F.coalesce(F.col("cooldown_until") <= now, F.lit(True)))
    if employer:
        due = due.filter(F.lower("name") == employer.lower())
    return due.orderBy(F.desc("priority"), "board_id").limit(limit) if limit else due


def places_restored(jobs: DataFrame, baseline: DataFrame, employers: DataFrame) -> DataFrame:
    """(id, location): jobs whose place was overwritten with their employer's seat, and the whole-country place that the
    baseline had for the same key, company and URL."""
    old = baseline.select("id", *[F.col(c).alias(f"_{c}") for c in ("dedupe_key", "company", "url")], display_place(F.col("location")).alias("_original"))
    seat = employers.select("employer_id", F.col("location").alias("_seat"))
    joined = jobs.join(old, "id").join(seat, "employer_id")
    same = F.col("dedupe_key").eqNullSafe(F.col("_dedupe_key")) & F.col("company").eqNullSafe(F.col("_company")) & F.col("url").eqNullSafe(F.col("_url"))
    at_seat = (F.col("location") == F.col("_seat")) | F.col("location").isin(*[F.concat(F.col("_seat"), F.lit(f" ({m})")) for m in MODES])
    return joined.filter(same & F.col("_original").isin(*WHOLE_COUNTRY) & (F.col("_seat") != "") & (F.col("location") != F.col("_original")) & at_seat).select("id", F.col("_original").alias("location"))


def decisions_checked(decisions: DataFrame, facts: DataFrame) -> DataFrame:
    """(pair_id, decision, model_decision, valid): proposals on pairs of companies after a check against the pair's facts.
    decisions: pair_id, decision, relationship, citations array<struct<fact_id, quote>>; facts: pair_id, facts map.

    A decision is valid if its pair is known and decided once, and each citation is part of the fact that it cites. A
    positive one needs the same entity, cited equal company numbers or a first-party text that names both with the
    candidate's name cited, and a living candidate; a negative one needs a citation. Otherwise evidence is insufficient."""
    joined = decisions.join(facts, "pair_id", "left").withColumn("_times", F.count("*").over(Window.partitionBy("pair_id")))
    fact = lambda k: F.coalesce(F.col("facts")[k], F.lit(""))
    cited = lambda k: F.exists("citations", lambda c: c["fact_id"] == k)
    quoted = F.forall("citations", lambda c: F.coalesce(F.col("facts")[c["fact_id"]].contains(c["quote"]), F.lit(False)))
    number = (fact("employer.company_number") != "") & (fact("employer.company_number") == fact("candidate.company_number")) & cited("employer.company_number") & cited("candidate.company_number")
    keys = joined.withColumns({"_employer": name_key(fact("employer.name")), "_candidate": name_key(fact("candidate.name")), "_quotes": name_key(F.array_join(F.transform(F.filter("citations", lambda c: c["fact_id"].rlike(r"^first_party\..*\.text$")), lambda c: c["quote"]), "\n"))})
    first_party = F.col("_quotes").contains(F.col("_employer")) & F.col("_quotes").contains(F.col("_candidate")) & (F.col("_quotes") != "")
    positive = (F.col("relationship") == "same_entity") & (number | (first_party & cited("candidate.name"))) & ~F.lower(fact("candidate.status")).isin(*GONE)
    weak = ((F.col("decision") == "same_company") & ~F.coalesce(positive, F.lit(False))) | ((F.col("decision") == "different_company") & (F.size("citations") == 0))
    valid = F.coalesce((F.col("_times") == 1) & F.col("facts").isNotNull() & quoted, F.lit(False))
    return keys.select("pair_id", F.when(weak, "insufficient_evidence").otherwise(F.col("decision")).alias("decision"), F.when(weak, F.col("decision")).alias("model_decision"), valid.alias("valid"))


def rule_terms(name: Column, keywords: Column) -> Column:
    """A rule's different non-blank terms, its name first."""
    terms = F.concat(F.array(name), F.coalesce(keywords, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))


def rules_retagged(rules: DataFrame, wanted: list[str]) -> DataFrame:
    """rules (pos, name, keywords) after the wanted terms were chosen: rules keep the terms that are wanted and go when
    none is; a name that isn't wanted becomes the first kept term; new terms follow as rules of their own."""
    listed = F.array(*map(F.lit, wanted)).cast("array<string>")
    left = F.filter(rule_terms(F.col("name"), F.col("keywords")), lambda t: F.array_contains(listed, t))
    keywords = F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda t: F.array_contains(listed, F.trim(t)))
    kept = rules.withColumn("_left", left).filter(F.size("_left") > 0).select("pos", F.when(F.array_contains(listed, F.trim("name")), F.col("name")).otherwise(F.col("_left")[0]).alias("name"), keywords.alias("keywords"))
    had = rules.select(F.explode(rule_terms(F.col("name"), F.col("keywords"))).alias("term")).distinct()
    last = rules.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
    new = rules.sparkSession.createDataFrame([(i, t) for i, t in enumerate(wanted)], "n int, term string").join(had, "term", "left_anti").crossJoin(last)
    return kept.unionByName(new.select((F.col("_last") + 1 + F.col("n")).cast(rules.schema["pos"].dataType).alias("pos"), F.col("term").alias("name"), F.array("term").alias("keywords")))
