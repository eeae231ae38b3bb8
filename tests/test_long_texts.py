"""Cleaning and grouping of long texts: each step once, by plain words where they decide, with the patterns' results."""

import random
from functools import reduce

from pyspark.sql import functions as F

from rolegrain.functions import sectors, text

BITS = [
    '").appendTo("head"); x //]]>', "$(window).on('load', f});", "$(window).load(f});", '{ "themeOptions": 1', "').attr('x')", "// $(window) y });", "By continuing to use this website, you consent to the use of cookies a Accept  Close", "We use cookies to offer you the best possible website experience Accept All Cookies",
    "Privacy and Cookies Cookies help us improve your website experience Accept Close", "or choose to opt out of cookies Accept All Cookies", "WE USE COOKIES find out more.", "Welcome! AIB We use cookies Accept All", "session so the server can identify the visitor Accept All Cookies", "Cookie Notice x Decline", "This website uses cookies Got it",
    "Careers at Workday x Join Our Talent Community!", "Recruitment Privacy Statement reserved.", "Toggle navigation", "Follow Us  Recruitment Privacy Statement x", "Job Details | At ESB Careers Create Alert", "JOB SEARCH x Clear", "E-mail similar jobs to me Select how often (in days) to receive an alert: Create Alert",
    "Modify All Cookies Accept All Cookies Our Group Career Streams Apply now »", "Modify All Cookies Accept All Cookies JOB OPPORTUNITIES x JOIN OUR TALENT COMMUNITY", "Modify All Cookies Filter jobs by Posting Language x Login", "Language Deutsch (Deutschland) x View Profile", "Find similar jobs: x", "Opens in a new tab. All Rights Reserved.",
    "© Copyright 2024 All Rights Reserved.", "// $(window).load x", "via Sign Up »", "Apply now", "Start Please wait...", "× Select how often (in days) to receive an alert:", "Skip to main content", "duties of the role", "a\nb", "Toggle", "navigation", "Cookie", "Notice", "Accept", "Close",
]


def test_boilerplate_goes_by_the_patterns(spark):
    rnd = random.Random(7)
    texts = [*BITS, *("Duties. " + b + " Pay." for b in BITS), *(" ".join(rnd.choices(BITS, k=rnd.randrange(2, 6))) for _ in range(300)), "", None]
    every = reduce(lambda t, p: F.regexp_replace(t, p, " "), text.BOILERPLATE, F.col("t"))
    every = F.regexp_replace(F.regexp_replace(F.regexp_replace(every, "[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", every.alias("want"), text.without_boilerplate(F.col("t")).alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows] and sum(r.want != r.t for r in rows) > 300
    robots = ["Verify you're not a ROBOT", "verify that youre not a robot", "verify you are human", "verify you are a human", "verify you are there", "Attention required! | Cloudflare", "attention required", "404 Not Found", "not a robot", "this job is closed", "", None]
    rows = spark.createDataFrame([(t,) for t in robots], "t string").select(F.lower("t").rlike("|".join(text.ANTI_BOT)).alias("want"), text.is_anti_bot(F.col("t")).alias("got"), text.has_closed_notice(F.col("t")).alias("closed")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and [r.closed for r in rows] == [t == "this job is closed" for t in robots]


def test_a_text_is_cleaned_once(spark):
    frame = spark.createDataFrame([("<p>x",)], "t string").select(text.clean_description(F.col("t"), F.lit("Acme"), F.lit("x")).alias("c"))
    assert frame._jdf.queryExecution().analyzed().toString().count("Toggle navigation") == 1


def test_sector_groups_by_the_patterns(spark):
    rnd = random.Random(8)
    words = [w for _, p in sectors.GROUP_PATTERNS for w in p.replace("^", "").replace("[ ,&]", ",").split("|")] + list(sectors.EXCEPT["Food & Beverage"].split("|"))
    labels = [*words, *(f"a {w}" for w in words), *(" ".join(rnd.choices(words, k=2)) for _ in range(200)), "hr", "HR & pay", " AI lab", "it x", "nothing", "General", "", None]
    s = F.lower(F.trim(F.coalesce("t", F.lit(""))))
    want = F.when(s.isin(*sectors.BLANK_LABELS), sectors.UNCATEGORIZED)
    for group, pattern in sectors.GROUP_PATTERNS:
        want = want.when(s.rlike(pattern) & (~s.rlike(sectors.EXCEPT[group]) if group in sectors.EXCEPT else F.lit(True)), group)
    got = sectors.sector_group(F.col("t"))
    frame = spark.createDataFrame([(t,) for t in labels], "t string")
    rows = frame.select("t", want.otherwise(sectors.OTHER).alias("want"), got.alias("got")).collect()
    assert [(r.t, r.got) for r in rows] == [(r.t, r.want) for r in rows] and len({r.got for r in rows}) > 25
    assert frame.select(got.alias("g"))._jdf.queryExecution().analyzed().toString().count("trim(") == 1
