"""Stores: running totals, limits of stored responses and their replay, archives, evaluations by version."""

import datetime as dt
import gzip
import hashlib
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import evaluations, tables
from rolegrain.operators.rules import Profile, scored
from rolegrain.sources import store, zipped
from tests.test_sources_and_rules import JOB

NOW = dt.datetime(2026, 3, 1)


def test_running_totals_need_no_single_task(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randrange(50), rnd.randrange(1, 9)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id int, at int, n long")
    got = tables.with_running(frame, [F.desc("at"), F.asc("id")], {"so_far": F.col("n"), "count": F.lit(1).cast("long")})
    want, total = {}, 0
    for k, (i, _, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += n
        want[i] = (total, k)
    assert {r.id: (r.so_far, r["count"]) for r in got.collect()} == want
    assert tables.with_running(frame.limit(0), [F.col("id")], {"so_far": F.col("n")}).count() == 0


def test_each_limit_of_the_store_binds(spark):
    files = [(f"k{i:04d}", 100 + i, NOW - dt.timedelta(hours=i)) for i in range(1000)] + [("tie-b", 1, NOW), ("tie-a", 1, NOW)]
    frame = spark.createDataFrame(files, "key string, stored_bytes long, at timestamp")
    kept = lambda **limits: sorted(r.key for r in store.within_limits(frame, F.lit(NOW), **limits).collect())
    assert kept() == sorted(k for k, _, at in files if at >= NOW - dt.timedelta(days=30)) and len(kept()) == 723
    newest = [k for k, _, _ in sorted(files, key=lambda f: (-f[2].timestamp(), f[0]))]
    assert kept(most_files=2) == ["k0000", "tie-a"] and kept(most_files=50) == sorted(newest[:50])
    size, within = {k: n for k, n, _ in files}, 0
    for n in range(len(newest)):
        if (within := within + size[newest[n]]) > 5000:
            break
    assert kept(most_bytes=5000) == sorted(newest[:n]) and kept(days=1) == sorted(newest[:27])
    assert kept(most_files=0) == []


def test_saved_and_replayed(spark):
    big, small = b"<p>text</p>" * 500, b"x"
    rows = [("https://a.test/x?token=secret&p=1", 200, "text/html", big, NOW), ("https://b.test/", 200, "text/html", big, NOW + dt.timedelta(days=1)), ("https://c.test/", 404, None, small, NOW)]
    bodies, entries = store.saved(spark.createDataFrame(rows, "url string, status int, content_type string, body binary, at timestamp"))
    found = {r.digest: r for r in bodies.collect()}
    assert set(found) == {hashlib.sha256(b).hexdigest() for b in (big, small)}
    packed = found[hashlib.sha256(big).hexdigest()]
    assert bytes(packed.stored) == store.PACKED + gzip.compress(big, 6, mtime=0) and packed.stored_bytes < packed.raw_bytes and packed.at == NOW + dt.timedelta(days=1)
    assert bytes(found[hashlib.sha256(small).hexdigest()].stored) == small
    said = [json.loads(r.metadata) for r in entries.collect()]
    assert all(m["parser_version"] == "vacancy-parser:v1" for m in said) and not any("secret" in m["url"] for m in said)
    again = {r.url: bytes(r.body) for r in store.replayed(entries, bodies).collect()}
    assert len(again) == 3 and again["https://c.test/"] == small and again["https://b.test/"] == big
    for damaged, reason in (
        (lambda: store.replayed(entries, bodies, "vacancy-parser:v2"), "unsupported parser version"), (lambda: store.replayed(entries.withColumn("metadata", F.replace("metadata", F.lit("200"), F.lit("201"))), bodies), "metadata changed"),
        (lambda: store.replayed(entries, bodies.withColumn("stored", F.lit(b"other"))), "body changed"), (lambda: store.replayed(entries, bodies.limit(0)), "no body"),
    ):
        with pytest.raises(Exception, match=reason):
            damaged().collect()
    with pytest.raises(Exception, match="too large"):
        store.saved(spark.createDataFrame([("u", 200, "t", bytes(store.MOST_BODY + 1), NOW)], "url string, status int, content_type string, body binary, at timestamp"))[0].collect()


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return str(path)


HEADER = "company_num,company_name,company_status,company_address_1,company_address_2,company_address_4,eircode\n"


def test_register_in_an_archive(spark, tmp_path):
    rows = "".join(f'{i},"Name, {i} ",Normal, Street {i} ,,Cork,D0{i}\n' for i in range(20_000))
    path = archive(tmp_path / "a.zip", {"readme.txt": "no", "Companies.CSV": "﻿" + HEADER + rows + '20000,"two\nlines",Dissolved,,,,\n'})
    got = zipped.companies_zip(spark, path)
    assert got.count() == 20_001 and got.select("identity").distinct().count() == 20_001
    r = got.filter("company_number = '7'").first()
    assert (r.name, r.address, r.country, r.status, json.loads(r.evidence)) == ("Name, 7", "Street 7, Cork", "IE", "Normal", {"eircode": "D07"})
    assert got.filter("company_number = '20000'").first().name == "two\nlines"
    for name, members, reason in (
        ("two", {"a.csv": HEADER, "b.csv": HEADER}, "one bounded CSV member"), ("none", {"a.txt": HEADER}, "one bounded CSV member"), ("header", {"a.csv": "company_num,other\n1,2\n"}, "columns are missing"), ("empty", {"a.csv": ""}, "columns are missing"),
    ):
        with pytest.raises(Exception, match=reason):
            zipped.companies_zip(spark, archive(tmp_path / f"{name}.zip", members)).collect()
    with pytest.raises(Exception, match="one bounded CSV member"):
        zipped.companies_zip(spark, path, most_bytes=1000).collect()


def test_a_member_that_lies_about_its_size(tmp_path):
    class Endless:
        def read(self, n):
            return b"x" * n

    stream = zipped.Bounded(Endless(), 1000)
    with pytest.raises(ValueError, match="too large"):
        while True:
            stream.readinto(bytearray(300))


def test_evaluations_rewrite_only_what_changed(spark, tmp_path):
    home = f"{tmp_path}/evaluations"
    row = lambda i, score, at: ("u", i, score, "Good Match", ["a"], "{}", f"h{i}", "p", "v", at, hashlib.md5(f"{i}{score}".encode()).hexdigest())
    frame = lambda rows: spark.createDataFrame(rows, evaluations.ROW)

    def files():
        return {os.path.join(d, f) for d, _, fs in os.walk(f"{home}/data") for f in fs if f.endswith(".parquet")}

    def of_manifest():
        return {r.range: r.folder for r in evaluations.manifest(spark, home).collect()}

    assert evaluations.stored(spark, home).count() == 0
    first = evaluations.upsert(spark, home, frame([row(i, 10, NOW) for i in range(600)] + [row(5, 9, NOW - dt.timedelta(days=1))]))
    before, at_first = files(), of_manifest()
    assert len(first) > 200 and evaluations.stored(spark, home).count() == 600 and evaluations.stored(spark, home).filter("job_id = 5").first().relevance == 10
    later = NOW + dt.timedelta(days=1)
    second = evaluations.upsert(spark, home, frame([row(i, 11 if i in (3, 4) else 10, later) for i in range(600)] + [row(1000, 1, later)]))
    assert 1 <= len(second) <= 3 and before <= files()
    assert {r: f for r, f in of_manifest().items() if r not in second} == {r: f for r, f in at_first.items() if r not in second}
    now = {r.job_id: (r.relevance, r.calculated_at) for r in evaluations.stored(spark, home).collect()}
    assert now == {i: (11, later) if i in (3, 4) else (10, NOW) for i in range(600)} | {1000: (1, later)}
    assert evaluations.upsert(spark, home, frame([row(3, 11, later)])) == [] and evaluations.verified(spark, home).count() == 0
    assert evaluations.stored(spark, home, 1).filter("job_id = 3").first().relevance == 10
    folder = of_manifest()[second[0]]
    frame([tuple(r) for r in spark.read.schema(evaluations.ROW).parquet(folder).limit(1).collect()]).coalesce(1).write.mode("append").parquet(folder)  # a row comes twice
    assert [r.range for r in evaluations.verified(spark, home).collect()] == [second[0]]


def test_evaluation_documents(spark):
    job = dict(zip([f.split()[0] for f in JOB.split(", ")], [None] * 99)) | {"id": 1, "title": "Senior Engineer", "location": "Cork", "description": "python", "sector": "Data"}
    rows = scored(spark.createDataFrame([tuple(job.values())], JOB), Profile(keywords=("python",), disqualifiers=("python",))).withColumn("job_hash", F.lit("j"))
    r = evaluations.documents(rows, "u", "p", F.lit(NOW)).first()
    said = json.loads(r.analysis)
    assert said["mismatch_flags"] == ["Disqualified Dealbreaker"] and said["fit_score"] == r.relevance and said["sub_scores"]["disqualified"] == 1.0 and said["matched_skills"] == r.matched_skills
    again = evaluations.documents(rows, "u", "p", F.lit(NOW + dt.timedelta(days=9))).first()
    assert again.content_hash == r.content_hash and again.calculated_at != r.calculated_at
