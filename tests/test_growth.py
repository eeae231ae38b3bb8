"""Copies and frequent keys: the rows that joins make grow with the input, and results are those of all pairs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from rolegrain.operators import ingest, resolve


def joined(frame) -> tuple[list, int]:
    """The rows of frame, and the most rows that one of its joins made."""
    rows = frame.collect()

    def nodes(plan):
        yield plan
        kind = plan.getClass().getSimpleName()
        children = plan.children()
        below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [children.apply(i) for i in range(children.size())]
        for p in below:
            yield from nodes(p)

    plans = [p for p in nodes(frame._jdf.queryExecution().executedPlan()) if "Join" in p.getClass().getSimpleName()]
    assert plans
    return rows, max(p.metrics().apply("numOutputRows").value() for p in plans)


def grams(name):
    return list({name[i : i + 3] for i in range(len(name) - 2) if " " not in name[i : i + 3]}) if name and 6 <= len(name) <= 128 else []


def test_trigrams_of_copies_match_all_pairs(spark):
    rnd = random.Random(3)
    words = ["large", "larger", "ring", "rings", "bolt", "old", "gold"]
    names = [" ".join(rnd.choices(words, k=2)) for _ in range(12)]
    entries = [(i, rnd.choice([*names[:3], *names, "abc", None])) for i in range(300)] + [(5, names[0]), (5, names[1]), (7, names[2])]
    queries = [(i, rnd.choice(names)) for i in range(40)] + [(3, names[4]), (90, None), (91, "ab")]
    q, e = spark.createDataFrame(queries, "query_id long, name string"), spark.createDataFrame(entries, "entry_id long, name string")
    held = {}
    for i, n in entries:
        held.setdefault(i, Counter()).update(grams(n))
    asked = {}
    for i, n in queries:
        asked.setdefault(i, Counter()).update(grams(n))
    for most in (1, 4, 50, 1000):
        want = []
        for i, a in asked.items():
            shared = sorted((-n, j) for j, h in held.items() if (n := sum(a[g] * h[g] for g in a)))
            want += [(i, j, -n) for n, j in shared[:most]]
        assert sorted(tuple(r) for r in resolve.trigram_candidates(q, e, most).collect()) == sorted(want)


def test_copies_of_a_name_are_met_once(spark):
    entries = spark.range(4000).select(F.col("id").alias("entry_id"), F.when(F.col("id") % 2 == 0, "large ring").otherwise("old widget").alias("name"))
    queries = entries.filter("entry_id % 20 = 0").withColumnRenamed("entry_id", "query_id")
    rows, most = joined(resolve.trigram_candidates(queries, entries, 5))
    assert sorted(tuple(r) for r in rows) == [(i, j, 5) for i in range(0, 4000, 20) for j in range(0, 10, 2)] and most <= 1000


def test_similar_copies_are_matched_once(spark):
    entries = spark.range(3000).select(F.col("id").alias("entry_id"), F.when(F.col("id") % 3 == 0, "large ring").when(F.col("id") % 3 == 1, "large rings").otherwise("old widget").alias("name"))
    queries = entries.filter("entry_id % 10 = 0").withColumnRenamed("entry_id", "query_id")
    rows, most = joined(resolve.fuzzy_matches(queries, entries, keep=4))
    names = ("large ring", "large rings", "old widget")
    assert sorted((r.query_id, r.entry_id, r.similarity) for r in rows) == [(i, j, 100.0) for i in range(0, 3000, 10) for j in range(i % 3, 12, 3)]
    assert {(r._q, r._e) for r in resolve.worth_matching(queries, entries, 85.0).select("_q", "_e").distinct().collect()} >= {(n, n) for n in names}
    assert most <= 6000  # 300 queries with 1000 candidates each made 300,000


def test_three_ways_match_all_pairs(spark):
    rnd = random.Random(4)
    row = lambda i: (i, rnd.choice(["x", "x", "y", "", None]), rnd.choice("abcdefgh"), str(rnd.randrange(60)))
    entries = [row(i) for i in range(400)] + [row(i) for i in range(0, 400, 7)]
    queries = [row(i) for i in range(50)] + [row(3)]
    names = "{} long, a string, b string, c string"
    q, e = spark.createDataFrame(queries, names.format("query_id")), spark.createDataFrame(entries, names.format("entry_id"))
    agree = {}
    for i, *k in queries:
        agree.setdefault(i, set()).update(j for j, *m in entries if any(x and x == y for x, y in zip(k, m, strict=True)))
    for limit in (1, 6, 50, 110, 1000):
        want = sorted((i, j, len(js) > limit) for i, js in agree.items() for j in sorted(js)[:limit])
        rows, most = joined(resolve.three_way(q, e, ("a", "b", "c"), limit))
        assert sorted(tuple(r) for r in rows) == want
        assert limit > 6 or most <= 51 * 2 * (limit + 1)


def test_unique_matches_of_frequent_keys(spark):
    rnd = random.Random(5)
    row = lambda i, n: (i, rnd.choice([None, "", *map(str, range(n))]), rnd.choice([None, "", *map(str, range(n // 4))]))
    left, right = [row(i, 200) for i in range(150)] + [row(3, 200), row(4, 200)], [row(i, 200) for i in range(120)] + [(i, "900", "901") for i in range(2000)]
    left += [(i, "900", "901") for i in range(200, 300)]
    got = joined(resolve.unique_match(spark.createDataFrame(left, "left_id long, strong string, weak string"), spark.createDataFrame(right, "right_id long, strong string, weak string"), "strong", "weak"))
    by = lambda at: {i: {j for x in left if x[0] == i for j, *k in right if k[at] and k[at] == x[at + 1]} for i, *_ in left}
    strong, weak = by(0), by(1)
    want = [(i, next(iter(found)) if len(found := strong[i] or weak[i]) == 1 else None) for i, *_ in left]
    assert Counter(tuple(r) for r in got[0]) == Counter(want) and len({r[1] for r in want}) > 20
    assert got[1] <= 1000  # the frequent key made 200,000


def test_batches_match_all_pairs(spark):
    rnd = random.Random(9)
    long = "Duties of the role: plan and review the work of the team, " * 4
    fields = "dedupe_key string, url string, title string, company string, location string, closed boolean, employer_id long, description string, latitude double, longitude double, coordinate_source string"
    row = lambda i, key: (i, f"{key}{i}", rnd.choice([f"https://x.test/{k}/{rnd.randrange(12)}" for k in ("jobs", "about")] + ["", None]), rnd.choice(["Role", " role", "Role", "Lead", "", None]), rnd.choice(["Acme", "Acme Ltd", "Beta", ""]), rnd.choice(["Cork", "Cork", "cork ", ""]), rnd.choice([False, False, False, True, None]), rnd.choice([None, i]), rnd.choice([long, "stub", None]), None, None, None)
    known, items = [row(i, "c") for i in range(24)], [row(i, "b") for i in range(400)]
    clean = lambda x: " ".join((x or "").lower().split())
    firm = lambda x: clean(x).replace(" ltd", "")

    def same(a, b):
        if not a[2] or a[2] != b[2] or any(not clean(a[i]) or clean(a[i]) != clean(b[i]) for i in (3, 5)):
            return False
        if "/jobs/" not in a[2] and (not firm(a[4]) or firm(a[4]) != firm(b[4])):
            return False
        return None if a[6] is None or b[6] is None else a[6] == b[6]

    keys = set()
    for a in items:
        said = [x for b in known if a[2] and b[2] == a[2] and (x := same(a, b)) is not None]
        at = [b for b in known if b[2] == a[2]]
        keys.add(min(at, key=lambda b: (b[8] != long, b[0]))[1] if said and all(said) else a[1])
    batch, catalog = spark.createDataFrame(items, "pos long, " + fields), spark.createDataFrame(known, "id long, " + fields)
    got = ingest.merged_batch(batch, catalog)
    assert {r.dedupe_key for r in got.collect()} == keys and len([k for k in keys if k[0] == "c"]) >= 3


def test_a_url_with_many_rows_is_met_once(spark):
    at = lambda n, key, name: spark.range(n).select(F.col("id").alias(name), F.concat(F.lit(key), "id").alias("dedupe_key"), F.lit("https://x.test/jobs/1").alias("url"), F.lit("Role").alias("title"), F.lit("Acme").alias("company"), F.lit("Cork").alias("location"), F.lit(False).alias("closed"), F.lit(7).cast("long").alias("employer_id"), F.lit("stub").alias("description"), *[F.lit(None).cast("double").alias(c) for c in ("latitude", "longitude")], F.lit(None).cast("string").alias("coordinate_source"))
    rows, most = joined(ingest.merged_batch(at(400, "b", "pos"), at(300, "c", "id")))
    assert [(r.dedupe_key, r.pos) for r in rows] == [("c0", 399)] and most <= 400


def test_texts_are_parted_once(spark):
    w = spark.createDataFrame([(1, "Large ring of the old wörld"), (2, "a large bolt"), (3, None)], "witness_id long, text string")
    a = spark.createDataFrame([("s", "1", "the old"), ("s", "2", "large ring Ltd"), ("s", "3", "world")], "source string, identity string, alias string")
    met = resolve.alias_meetings(w, a)
    assert met._jdf.queryExecution().analyzed().toString().count("Generate explode") == 1
    assert sorted((r.witness_id, r.identity) for r in resolve.alias_candidates(w, a).collect()) == [(1, "1"), (1, "2"), (1, "3")]
