"""Scalar functions, by the cases that the catalog has to get right."""

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import identity, pay, places, scores, sectors, skills


def apply(spark, column, values, kind="string"):
    """column(c) for each value of a one-column table."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("c"))).collect())]


def test_pay_shapes(spark):
    texts = ["€55.5 - 70k annual", "$90,000 monthly", None, "€60k per week", "€60k plus holiday allowance", "€45,000 to €55,000", "35000-40000", "£9,000", "28 /hr", " ", "30,000 base and 5k bonus"]
    rows = pay.with_pay(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, salary_text string")).orderBy("i").collect()
    got = [(r.salary_min_amount, r.salary_max_amount, r.salary_currency, r.salary_period) for r in rows]
    assert got == [
        (55500, 70000, "EUR", "annual"), (90000, 90000, "USD", "monthly"), (None, None, None, None), (60000, 60000, "EUR", "weekly"), (60000, 60000, "EUR", "annual"), (45000, 55000, "EUR", "annual"),
        (35000, 40000, "EUR", "annual"), (None, None, "GBP", "annual"), (None, None, "EUR", "hourly"), (None, None, None, None), (30000, 30000, "EUR", "annual"),
    ]


def test_crossed_pay_is_flagged(spark):
    r = pay.with_pay(spark.createDataFrame([("60,000 with a 10,000 bonus",)], "salary_text string")).first()
    assert r.salary_crossed and r.salary_min_amount is None and r.salary_max_amount is None


def test_refreshed_pay(spark):
    schema = "salary_text string, salary_min_amount int, salary_max_amount int, salary_currency string, salary_period string"
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [("$90,000 monthly", 55500, 70000, "EUR", "annual", "€55.5 to 70k", 55500, 70000, "EUR", "annual"), ("€60k", 1, 70000, "EUR", "daily", "€50k", 50000, 70000, "EUR", "annual"), ("€50k", 7, 8, "USD", "daily", "€50k", 7, 8, "USD", "daily")]
    frame = spark.createDataFrame(rows, schema + ", " + ", ".join("old_" + c for c in schema.split(", ")))
    got = [tuple(r) for r in pay.refreshed(frame).select(*names).collect()]
    assert got == [("$90,000 monthly", 90000, 90000, "USD", "monthly"), ("€60k", 1, 60000, "EUR", "daily"), ("€50k", 7, 8, "USD", "daily")]


def test_pay_text(spark):
    texts = ["pay is €40,000 - €50,000 per annum now", "Salary: £30k", "we pay 40k", "compensation $25 / hour", "€20 to €25 /hr", None]
    assert apply(spark, pay.pay_text, texts) == ["€40,000 - €50,000 per annum", "£30k", None, "$25", "€20 to €25 /hr", None]


def test_pay_filter_grammar():
    for bad in ("0k", "5k", "15k", "310k", "010k", "10000"):
        with pytest.raises(ValueError):
            pay.discloses(bad)
    assert pay.discloses("all") is None and all(pay.discloses(f"{n}0k") is not None for n in range(1, 31))


def test_literal_skills(spark):
    cases = [
        ("Uses C++ daily", "C++", True), ("C#", "c#", True), ("the .NET stack", ".NET", True), ("Node.js!", "Node.js", True), ("UI/UX work", "UI/UX", True), ("[SQL]", "[SQL]", True), ("Google", "Go", False), ("maintain", "AI", False), ("C++Builder", "C++", False),
        ("ASP.NET", ".NET", False), ("x_C#", "C#", False), ("déGo", "Go", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("Gopher Go", "Go", True), ("go", "  Go ", True), ("any", "  ", False), ("a" * 60, "a" * 51, False), ("x", "x", False), (None, "Go", None), ("a\\E b", "a\\E", True),
    ]
    rows = spark.createDataFrame(cases, "text string, skill string, want boolean").withColumn("got", skills.has_skill(F.col("text"), F.col("skill")))
    assert [r for r in rows.collect() if r.got != r.want] == []


def test_search_is_literal(spark):
    got = apply(spark, lambda c: skills.contains_literal(c, " 100%_exact "), ["Dublin 100%_Exact", "Dublin 100xyexact", "100%_exact\\", None])
    assert got == [True, False, True, None]


def test_scores(spark):
    point = {c: F.lit(0.9) for c in ("sector", "semantic", "competency", "seniority", "salary", "contract")}
    extra = point | {c: F.lit(1) for c in ("target_role", "location", "work_mode")}
    row = spark.range(1).select(
        scores.compose(point), scores.compose(point, {"sector": 25, "salary": 15}), scores.compose(extra), scores.compose(point | {"disqualified": F.lit(1)}), scores.compose(point | {"negative_sector": F.lit(1)}), scores.compose({}), scores.compose({"semantic": F.lit(0.5)}, {"semantic": 25}), scores.compose({"auth_deduction": F.lit(12)}), scores.compose(point | {"disqualified": F.lit(1)}, {"disqualification_cap": 40})
    ).first()
    assert tuple(row) == (90, 99, 100, 10, 15, 0, 13, 0, 15)
    assert apply(spark, scores.fit_tier, [75, 74, 55, 35, 15, 14], "int") == ["Strong Match", "Good Match", "Good Match", "Moderate Match", "Low Match", "Mismatch"]


def test_sector_groups(spark):
    labels = [None, " General ", "Healthcare Recruitment", "Food and restaurant", "Dairy food", "Fintech", "IT services", "zzz", "Hr, people", "AI labs"]
    assert apply(spark, sectors.sector_group, labels) == ["Uncategorized", "Uncategorized", "Recruitment & Staffing", "Hospitality & Tourism", "Food & Beverage", "Financial Services", "Technology & Software", "Other", "Recruitment & Staffing", "Technology & Software"]
    names = [g for g, _ in sectors.GROUP_PATTERNS]
    assert len(set(names)) == 28


def test_companies_and_titles(spark):
    assert apply(spark, identity.company_name, ["Acme (Ireland) Ltd.", "The Co Group", None, "Corporate Co"]) == ["acme", "the", "", "corporate"]
    assert apply(spark, lambda c: identity.trailing_suffixes_off(c, ("ltd", "group", "ireland")), ["Acme Ireland Group Ltd", "Group Nine Ltd"]) == ["acme", "group nine"]
    titles = ["Sr. Eng - Dublin (Hybrid)", "Developer (Ref: AB-12) 2026", "Mgr, Sales (Permanent)", "Analyst (Cork)", "A&nbsp;B | Remote work", None]
    assert apply(spark, identity.job_title, titles) == ["senior engineer", "developer", "manager sales", "analyst", "a b", ""]


def test_urls_and_keys(spark):
    urls = ["https://X.com/Jobs/1/?utm_source=a&b=2&A=1#top", "https://x.com/", "https://x.com/a?b=&c", None, " https://x.com/a?ref=z "]
    assert apply(spark, identity.canonical_url, urls) == ["https://x.com/jobs/1?a=1&b=2", "https://x.com", "https://x.com/a", "", "https://x.com/a"]
    posts = ["https://x.com/jobs/12", "https://x.com/about", "https://x.com/p?id=3", "ftp://x.com/jobs/1", "https://u:p@x.com/jobs/1", "https://x.com/01234567-89ab-cdef-0123-456789abcdef", None]
    assert apply(spark, identity.is_posting_url, posts) == [True, False, True, False, False, True, False]
    keys = spark.createDataFrame([("Acme Ltd", "Dev", "https://a/1?ref=q"), ("ACME", "Other", "https://a/1"), ("Acme", "Dev", None), ("Acme", "dev ", "")], "c string, t string, u string").select(identity.posting_key(F.col("c"), F.col("t"), F.col("u"), F.lit(None).cast("string"), F.lit(""))).collect()
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[0] != keys[2]


def test_places(spark):
    names = ["Dublin", "Dublin, OH", "London and Cork", "Berlin", "", None, "us", "Springfield"]
    assert apply(spark, places.maybe_irish, names) == [True, False, True, False, True, True, False, True]
    assert apply(spark, places.surely_irish, names) == [True, False, False, False, False, False, False, False]
    row = spark.range(1).select(places.coordinates_valid(F.lit(0.0), F.lit(0.0)), places.coordinates_valid(F.lit(91.0), F.lit(0.0)), places.coordinates_valid(F.lit(None).cast("double"), F.lit(0.0)), places.coordinates_valid(F.lit(float("nan")), F.lit(0.0))).first()
    assert tuple(row) == (True, False, False, False)
