"""Learned routes and requests of the last minute as keyed state: streams of several batches against plain folds."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rolegrain.operators import health, telemetry
from rolegrain.streaming import learned, queue

START = datetime(2024, 1, 1)


def run(spark, folder, frames, step, name):
    """frames as files, one a batch; what step makes of them, in the order of batches."""
    other = learned.with_rocksdb(spark)
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        time.sleep(1.1 if i + 1 < len(frames) else 0)  # files come by their time of change
    out = step(other.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    queue.stream_into(out, f"{folder}/checkpoint", lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out-{name}/b={i}"))
    return spark.read.parquet(f"{folder}/out-{name}").collect()


def test_routes_match_the_batch_and_are_forgotten(spark, tmp_path):
    rnd = random.Random(7)
    uses = [(i, rnd.choice(["a", "b", None]), rnd.choice("xyz"), rnd.random() < 0.45, START + timedelta(hours=2 * i + rnd.random())) for i in range(120)]
    uses += [(500, "quiet", "x", True, START), (501, "late", "x", True, START + timedelta(days=30))]
    uses.sort(key=lambda u: u[4])
    schema = "id long, source string, route string, ok boolean, at timestamp"
    frames = [spark.createDataFrame(uses[k : k + 31], schema) for k in range(0, len(uses), 31)]
    rows = run(spark, tmp_path, frames, learned.routes_stream, "routes")
    given = {r.id: r.route for r in rows if not r.expired}
    assert len(given) == len(uses)
    for n, (i, source, _, _, at) in enumerate(uses):
        if n % 40 == 0:  # the batch's view of all uses so far
            seen = spark.createDataFrame([u for u in uses[: n + 1] if u[1] == source], schema)
            best = health.learned_routes(seen, F.lit(at)).collect()
            assert given[i] == (best[0].route if best else None), i
    gone = [r for r in rows if r.expired and r.source == "quiet"]
    assert [(r.at, r.route) for r in gone] == [((START + timedelta(days=7) - datetime(1970, 1, 1)).total_seconds(), None)]


def test_three_failures_in_a_row_and_a_success_between(spark, tmp_path):
    uses = [(i, "s", "r", ok, START + timedelta(minutes=i)) for i, ok in enumerate([True, False, False, True, False, False, False, False, True])]
    rows = run(spark, tmp_path, [spark.createDataFrame(uses, "id int, source string, route string, ok boolean, at timestamp")], learned.routes_stream, "fails")
    assert [r.route for r in sorted(rows, key=lambda r: r.id)] == ["r"] * 6 + [None, None, "r"]


def test_state_expires_by_the_clock(spark, tmp_path):
    schema = "id int, source string, route string, ok boolean, at timestamp"
    other, got = learned.with_rocksdb(spark), []
    (tmp_path / "in").mkdir()
    out = learned.routes_stream(other.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl_days=2 / 86_400)
    # Such a stream always has another batch to run, as time goes on without rows; so it runs until it is stopped.
    query = out.writeStream.foreachBatch(lambda batch, i: got.extend(batch.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="500 milliseconds").start()
    try:
        for n, use in enumerate([(1, "s", "r", True, START), (2, "s", "q", False, START + timedelta(seconds=1))]):
            spark.createDataFrame([use], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            until = time.time() + 60
            while len(got) <= n and time.time() < until:
                time.sleep(0.2)
            time.sleep(3)
    finally:
        query.stop()
    assert {r.id: r.route for r in got} == {1: "r", 2: None}


def test_preceding_minute_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    events = sorted(((START + timedelta(seconds=rnd.randrange(900)), rnd.choice(["h", "k", None]), rnd.random() < 0.8, rnd.random() < 0.4) for _ in range(400)), key=lambda e: e[0])
    rows = [(i, host, at, sent, denied) for i, (at, host, sent, denied) in enumerate(events)]
    cuts = [0] + [n for n in range(1, len(rows)) if rows[n][2] != rows[n - 1][2] and n % 100 < 2][:6] + [len(rows)]
    schema = "id int, host string, at timestamp, sent boolean, denied boolean"
    frames = [spark.createDataFrame(rows[a:b], schema) for a, b in zip(cuts, cuts[1:]) if a < b]
    got = {r.id: r.preceding for r in run(spark, tmp_path, frames, learned.denials_stream, "minute")}
    batch = telemetry.with_preceding(spark.createDataFrame(rows, schema).fillna("", ["host"])).filter("denied").collect()
    assert got == {r.id: r.preceding for r in batch} and len(frames) > 2
