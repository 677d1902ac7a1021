"""Leases and retries as a stream, against the same jobs replayed one event at a time."""

import random
from datetime import datetime, timedelta

import pytest

from siftline import workspace
from siftline.streaming import jobs, leases

T0 = datetime(2024, 1, 1)
KINDS = "job_id string, id long, at timestamp, action string, lease_until timestamp"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(spark, folder, batches, **options):
    """The rows of the stream over some micro-batches, each a run of its own under one checkpoint."""
    source, out, check = (f"file://{folder}/{n}" for n in ("in", "out", "check"))
    with workspace.session_conf(spark, spark__sql__streaming__stateStore__providerClass=leases.STORE):
        for batch in batches:
            spark.createDataFrame(batch, KINDS).coalesce(1).write.mode("append").parquet(source)
            rows = jobs.read_table(spark, source, spark.createDataFrame([], KINDS).schema)
            jobs.write_available(leases.supervised(rows, **options), out, check)
    return sorted((r.job_id, r.event, r.attempt, (r.at - T0).total_seconds()) for r in spark.read.parquet(out).collect())


def replayed(rows, most, base, longest, end):
    """What happens to each job, by a list of deadlines kept in plain seconds."""
    out = []
    for job in sorted({r[0] for r in rows}):
        attempt, lease, due = 0, None, None

        def lost(moment):
            nonlocal attempt, due
            attempt += 1
            if attempt > most:
                out.append((job, "JOB_FAILED", attempt, moment))
                attempt, due = 0, None
            else:
                due = moment + min(longest, base * 2 ** (attempt - 1))

        def until(moment, closed=False):
            nonlocal lease, due
            before = lambda x: x is not None and (x <= moment if closed else x < moment)
            if before(lease):
                moment_lost, lease = lease, None
                lost(moment_lost)
            if lease is None and before(due):
                out.append((job, "RETRY_DUE", attempt, due))
                due = None

        for _, _, t, action, end_of in sorted((r for r in rows if r[0] == job), key=lambda r: (r[2], r[1])):
            t = (t - T0).total_seconds()
            until(t)
            lease_before, lease, due = lease, None, None
            if action in ("CLAIM", "RENEW"):
                lease = (end_of - T0).total_seconds()
            elif action == "FAIL":
                lost(t)
            elif action == "ABORT":
                out.append((job, "JOB_FAILED", attempt + 1, t))
                attempt = 0
            else:
                attempt = 0
        until(end, closed=True)
    return sorted(out)


def history(seed, jobs_=12, events=12):
    rng, rows = random.Random(seed), []
    for j in range(jobs_):
        t = rng.randint(0, 50_000) / 1000
        for i in range(events):
            action = rng.choice(["CLAIM", "RENEW", "CLAIM", "FAIL", "DONE", "ABORT", "CANCEL"])
            rows.append((f"j{j}", len(rows), at(t), action, at(t + rng.randint(5000, 60_000) / 1000) if action in ("CLAIM", "RENEW") else None))
            t += rng.randint(1000, 60_000) / 1000
    return rows


@pytest.mark.parametrize("cuts", [1, 3])
def test_jobs_are_those_replayed_however_events_are_cut(spark, tmp_path, cuts):
    rows = sorted(history(cuts), key=lambda r: r[2])
    size = -(-len(rows) // cuts)
    got = run(spark, tmp_path, [rows[i : i + size] for i in range(0, len(rows), size)], most=2, base=7.0, longest=20.0)
    end = max((r[2] - T0).total_seconds() for r in rows)
    rounded = lambda out: [(*r[:3], round(r[3], 3)) for r in out]
    assert rounded(got) == rounded(replayed(rows, 2, 7.0, 20.0, end))


def test_held_leases_start_the_stream(spark, tmp_path):
    held = spark.createDataFrame([("a", 0, at(10)), ("b", 3, at(20)), ("c", 1, at(9000))], "job_id string, attempt int, lease_until timestamp")
    batches = [[("c", 1, at(5), "DONE", None), ("z", 2, at(100), "CLAIM", at(9000))]]
    assert run(spark, tmp_path, batches, held=held) == [("a", "RETRY_DUE", 1, 11.0), ("b", "JOB_FAILED", 4, 20.0)]


def test_tails_close_each_with_its_job(spark, tmp_path):
    kinds = "job_id string, sequence_no long, event_type string"
    batches = [
        [("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 3, "job_failed")],
        [("a", 3, "job_completed"), ("a", 4, "late"), ("b", 2, "x"), ("b", 2, "x")],
        [("a", 5, "late"), ("b", 3, "job_cancelled"), ("c", 2, "x")],
    ]
    cursors = spark.createDataFrame([("a", 1), ("b", 0), ("d", 3)], "job_id string, cursor long")
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    with workspace.session_conf(spark, spark__sql__streaming__stateStore__providerClass=leases.STORE):
        for batch in batches:
            spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(source)
            rows = jobs.read_table(spark, source, spark.createDataFrame([], kinds).schema)
            jobs.write_available(jobs.tails(rows, cursors), out, check)
    got = sorted((r.job_id, r.sequence_no) for r in spark.read.parquet(out).collect())
    assert got == [("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 2), ("b", 3)]


def test_a_hot_key_is_replayed_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from siftline.operators import lifecycle

    # A burst of five hits every hundred seconds for a key with most hits; a key without a gap; single hits; nulls.
    hot = spark.range(40_000).select(F.lit("hot").alias("k"), (F.floor(F.col("id") / 5) * 100 + F.col("id") % 5).alias("s"))
    steady = spark.range(3000).select(F.lit("steady").alias("k"), (F.col("id") * 7).alias("s"))
    single = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.lit(5).cast("long").alias("s"))
    hits = hot.unionByName(steady).unionByName(single).withColumn("ts", F.timestamp_seconds("s"))
    numbered = lifecycle.quiet_segments(hits, "k", "ts", 60)
    per = numbered.groupBy("segment").agg(F.min("k").alias("a"), F.max("k").alias("b"), F.count("*").alias("n"))
    assert per.where("a <> b").count() == 0 and per.count() == 8000 + 1 + 50 and per.agg(F.max("n")).first()[0] == 3000
    got = lifecycle.admitted(hits, "k", "ts", 3, 60)
    with workspace.session_conf(spark, spark__sql__adaptive__coalescePartitions__enabled="false"):
        assert got.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
    seen = {}
    for r in got.orderBy("k", "s").collect():
        held = [t for t in seen.get(r.k, []) if t > r.s - 60]
        assert r.allowed == (len(held) < 3)
        seen[r.k] = held + [r.s] if r.allowed else held
    assert lifecycle.admitted(hits.limit(0), "k", "ts", 3, 60).collect() == []
