"""Aliases by their rarest words, similar names behind the letters' bound, the rollup under writes, nested facets."""

import json
import random
import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import identity
from rolegrain.operators import resolve, rollup
from rolegrain.sources import facet_tree, feeds


def test_aliases_match_all_pairs_and_meet_rarely(spark):
    rnd = random.Random(2)
    words = ["the", "The", "of", "and", *[f"w{i}" for i in range(60)], "Café", "straße"]
    texts = [(i, " ".join(rnd.choice(words[:4]) if rnd.random() < 0.5 else rnd.choice(words) for _ in range(30))) for i in range(120)] + [(900, None), (901, "")]
    aliases = [("s", f"i{i}", " ".join([rnd.choice(words[:2]), *rnd.choices(words, k=rnd.randrange(1, 3))]) + rnd.choice(["", " Ltd", "!"])) for i in range(60)] + [("s", "none", ""), ("s", "absent", "the nowhere"), ("t", "i1", "the of")]
    w, a = spark.createDataFrame(texts, "witness_id long, text string"), spark.createDataFrame(aliases, "source string, identity string, alias string")
    key = lambda t: " ".join(re.sub(r"[\W_]+", " ", "".join(c for c in unicodedata.normalize("NFKD", (t or "").casefold()) if not unicodedata.combining(c))).split())
    phrases = {(s, i, re.sub(r"(?:\s+(?:limited|ltd|plc|dac|inc|llc))+$", "", key(x))) for s, i, x in aliases}
    hits = {i: sorted({(s, e) for s, e, p in phrases if p and f" {p} " in f" {key(t)} "}) for i, t in texts}
    want = sorted((i, s, e, len(h) > 10) for i, h in hits.items() for s, e in h[:10])
    assert sorted(tuple(r) for r in resolve.alias_candidates(w, a).collect()) == want and len(want) > 100
    met = resolve.alias_meetings(w, a).count()
    by_first = sum(p.split()[0] in key(t).split() for _, t in texts for p in {p for _, _, p in phrases if p})
    assert met < by_first / 4


def test_name_keys(spark):
    names = ["Ünïcode  Ltd.", "A_B-c d", "Große Straße PLC inc", "Ltd", "Mc Ltd Donald", "ﬁne Ltd", "naïve café́", ""]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, n string").select("n", identity.name_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows] == ["unicode", "a b c d", "grosse strasse", "ltd", "mc ltd donald", "ﬁne", "naive cafe", ""]


def test_similar_names_match_all_pairs(spark):
    rnd = random.Random(6)
    stems = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(4, 8))) for _ in range(12)]
    names = [" ".join(rnd.sample(stems, rnd.randrange(1, 4))) for _ in range(150)]
    names += ["".join(rnd.choice("abcdefghé ") if rnd.random() < 0.1 else c for c in n) for n in names[:100]] + ["a  b   cdefgh", "cdefgh b a"]
    frame = spark.createDataFrame(list(enumerate(names)), "entry_id int, name string")
    queries = frame.filter("entry_id % 3 = 0").withColumnRenamed("entry_id", "query_id")

    def similar(a, b):
        mean = lambda x, y: (SequenceMatcher(None, x, y, autojunk=False).ratio() + SequenceMatcher(None, y, x, autojunk=False).ratio()) / 2
        return round(100 * max(mean(a, b), mean(" ".join(sorted(a.split())), " ".join(sorted(b.split())))), 2)

    met = {(r.query_id, r.entry_id) for r in resolve.trigram_candidates(queries, frame).collect()}
    scores = {(q, e): similar(names[q], names[e]) for q, e in met}
    best = {}
    for (q, e), s in sorted(scores.items(), key=lambda x: (x[0][0], -x[1], x[0][1])):
        if s >= 85 and len(best.setdefault(q, [])) < 10:
            best[q].append((e, s))
    got = {}
    for r in resolve.fuzzy_matches(queries, frame).orderBy("query_id", F.desc("similarity"), "entry_id").collect():
        got.setdefault(r.query_id, []).append((r.entry_id, r.similarity))
    assert got == {q: b for q, b in best.items() if b}
    calls = {(r.query_id, r.entry_id) for r in resolve.worth_matching(queries, frame, 85.0).collect()}
    assert {p for p, s in scores.items() if s >= 85} <= calls and len(calls) < len(met) / 2


def test_name_evidence(spark):
    row = spark.createDataFrame([("acme data group", "group acme systems acme"), ("the co", "the group")], "a string, b string").select(resolve.name_evidence(F.col("a"), F.col("b")).alias("e")).collect()
    assert [tuple(r.e) for r in row] == [(["acme"], False, ["systems"], ["data"]), ([], True, ["group"], ["co"])]


def test_rollup_follows_writes(spark, tmp_path):
    rnd, home, schema = random.Random(8), f"{tmp_path}/rollup", "id int, closed boolean, location string, category string"
    job = lambda i: (i, rnd.random() < 0.2, rnd.choice(["Cork", "Dublin", " ", None]), rnd.choice(["Tech", "Other", None]))
    table = {i: job(i) for i in range(200)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    with pytest.raises(ValueError, match="refresh"):
        rollup.after_write(spark, home, frame([]), frame([]))
    rollup.refresh(frame(table.values()), home)
    for _ in range(4):
        ids = rnd.sample(range(260), 30)
        before = [table[i] for i in ids if i in table]
        after = [job(i) for i in ids if rnd.random() < 0.7]
        for i in ids:
            table.pop(i, None)
        table |= {r[0]: r for r in after}
        rollup.after_write(spark, home, frame(before), frame(after))
        assert sorted(rollup.stored(spark, home).collect()) == sorted(rollup.rollup(frame(table.values())).collect())
    assert rollup.versions(spark, home) == [1, 2, 3, 4, 5]
    jobs = frame(table.values())
    assert rollup.current(jobs, home).count() == rollup.stored(spark, home).count() and rollup.versions(spark, home)[-1] == 5
    more = frame([*table.values(), (999, False, "Cork", "Tech")])
    assert sorted(rollup.current(more, home).collect()) == sorted(rollup.rollup(more).collect()) and rollup.versions(spark, home)[-1] == 6
    assert [r.category for r in rollup.categories(rollup.stored(spark, home)).collect()] == ["Tech", "Other", "Uncategorized"]
    assert {r.location for r in rollup.locations(rollup.stored(spark, home)).collect()} == {"Cork", "Dublin"}


def values(kind, *names):
    return {"facetParameter": kind, "values": [{"id": n.lower(), "descriptor": n} for n in names]}


def test_facets_of_any_depth(spark):
    def nested(depth, inner):
        for i in range(depth):
            inner = {"facetParameter": f"group{i}", "values": [{"id": "x", "descriptor": "y"}, None, 7, inner]}
        return inner

    boards = {
        "deep": [nested(5, values("locationCountry", "Ireland", "Spain"))], "deeper": [nested(40, values("locations", "Cork"))], "first": [values("locations", "Cork"), values("locations", "Dublin")],
        "odd": [{"facetParameter": "locations", "values": [{"id": 5, "descriptor": "Cork"}, {"id": "c" * 129, "descriptor": "Cork"}, {"id": "ok", "descriptor": "Galway, Ireland"}, "text"]}], "none": [values("locations", "Madrid")], "empty": [],
    }
    frame = spark.createDataFrame([(k, json.dumps({"facets": v})) for k, v in boards.items()] + [("bad", "no json"), ("null", None)], "source string, body string")
    got = {r.source: (r.parameter, r.ids, r.only_irish) for r in facet_tree.irish_facets(frame).collect()}
    assert got == {"deep": ("locationCountry", ["ireland"], False), "deeper": ("locations", ["cork"], True), "first": ("locations", ["cork"], True), "odd": ("locations", ["ok"], False)}
    many = {"facetParameter": "locations", "values": [{"id": str(i), "descriptor": "Cork"} for i in range(129)]}
    with pytest.raises(Exception, match="too many Irish facets"):
        facet_tree.irish_facets(spark.createDataFrame([("s", json.dumps({"facets": [many]}))], "source string, body string")).collect()


def test_workday_keeps_ambiguous_places_with_proof_only(spark):
    posting = lambda n, place: {"title": f"Senior Role {n}", "locationsText": place, "externalPath": f"/job/{n}"}
    listing = lambda *facets: json.dumps({"total": 4, "facets": list(facets), "jobPostings": [posting(1, "Dublin"), posting(2, "2 Locations"), posting(3, ""), posting(4, "Paris, France"), posting(5, "Remote")]})
    boards = [("proven", "Acme", "a.test/en-US/site", listing(values("locationCountry", "Ireland"))), ("open", "Beta", "b.test/en-US/site", listing(values("locationCountry", "Ireland", "France")))]
    got = sorted((r.source, r.title[-1], r.location) for r in feeds.read_feed(spark.createDataFrame(boards, "source string, company string, token string, body string"), "workday").collect())
    assert got == [("open", "1", "Dublin"), ("proven", "1", "Dublin"), ("proven", "2", "Ireland"), ("proven", "3", "Ireland"), ("proven", "5", "Ireland")]
