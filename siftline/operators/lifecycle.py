"""Job lifecycle as decisions over event and command tables.

State is derived from append-only logs (latest event per job), never updated in place;
uniqueness is kept by anti joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions.values import backoff_seconds
from siftline.workspace import materialise

# States, allowed transitions, event names, progress checkpoints and failure codes.
STATES = (
    "QUEUED", "PLANNING", "BROWSER_INITIALIZING", "DISCOVERING", "EXTRACTING", "VALIDATING", "READY_FOR_EXPORT", "EXPORTING",
    "COMPLETED", "FAILED", "CANCELLED",
)
TERMINAL = ("COMPLETED", "FAILED", "CANCELLED")
ACTIVE = tuple(s for s in STATES if s not in TERMINAL and s != "QUEUED")
TRANSITIONS = {
    "QUEUED": ("PLANNING", "CANCELLED"),
    "PLANNING": ("BROWSER_INITIALIZING", "FAILED", "CANCELLED"),
    "BROWSER_INITIALIZING": ("DISCOVERING", "FAILED", "CANCELLED"),
    "DISCOVERING": ("EXTRACTING", "FAILED", "CANCELLED"),
    "EXTRACTING": ("VALIDATING", "FAILED", "CANCELLED"),
    "VALIDATING": ("READY_FOR_EXPORT", "EXPORTING", "COMPLETED", "FAILED", "CANCELLED"),
    "READY_FOR_EXPORT": ("EXPORTING", "CANCELLED"),
    "EXPORTING": ("COMPLETED", "FAILED", "CANCELLED"),
}
EVENTS = {
    ("QUEUED", "PLANNING"): "planning_started",
    ("PLANNING", "BROWSER_INITIALIZING"): "planning_completed",
    ("BROWSER_INITIALIZING", "DISCOVERING"): "discovery_started",
}
DEFAULT_EVENTS = {"CANCELLED": "job_cancelled", "FAILED": "job_failed", "COMPLETED": "job_completed"}
PROGRESS = {
    "QUEUED": 0, "PLANNING": 10, "BROWSER_INITIALIZING": 20, "DISCOVERING": 30, "EXTRACTING": 40, "VALIDATING": 60,
    "READY_FOR_EXPORT": 80, "EXPORTING": 80, "COMPLETED": 100,
}
RETRYABLE = {
    "PLANNER_TIMEOUT": True, "PLANNER_RATE_LIMITED": True, "PLANNER_UNAVAILABLE": True, "PLANNER_INVALID_OUTPUT": False,
    "PLANNER_SCHEMA_ERROR": False, "PLANNER_NOT_CONFIGURED": False, "PLANNER_POLICY_REJECTED": False,
    "BROWSER_LAUNCH_FAILED": True, "NAVIGATION_FAILED": True, "BROWSER_CRASHED": True, "PAGE_CRASHED": True,
    "BROWSER_TIMEOUT": False, "NAVIGATION_TIMEOUT": False, "BROWSER_POLICY_BLOCKED": False, "BROWSER_RESOURCE_LIMIT": False,
    "DOWNLOAD_TOO_LARGE": False,
    "DISCOVERY_TIMEOUT": True, "DISCOVERY_NAVIGATION_FAILED": True, "DISCOVERY_BROWSER_FAILED": True,
    "DISCOVERY_POLICY_BLOCKED": False, "DISCOVERY_SCOPE_DENIED": False, "DISCOVERY_LIMIT_REACHED": False, "SITEMAP_TOO_LARGE": False,
    "EXTRACTION_TIMEOUT": True, "EXTRACTION_BROWSER_FAILED": True, "EXTRACTION_POLICY_BLOCKED": False,
    "EXTRACTION_LIMIT_REACHED": False, "EXTRACTION_INPUT_INVALID": False,
    "VALIDATION_INFRASTRUCTURE_FAILED": True, "VALIDATION_ENGINE_FAILED": False,
    "EXPORT_INFRASTRUCTURE_FAILED": True, "EXPORT_UNSUPPORTED_FORMAT": False, "EXPORT_TOO_LARGE": False,
    "EXPORT_SERIALIZATION_FAILED": False, "JOB_CANCELLED": False, "INVALID_STATE_TRANSITION": False, "INTERNAL_ERROR": False,
}
STAGES = {
    "QUEUED": "source", "PLANNING": "plan", "BROWSER_INITIALIZING": "discover", "DISCOVERING": "discover", "EXTRACTING": "extract",
    "VALIDATING": "validate", "READY_FOR_EXPORT": "export", "EXPORTING": "export", "COMPLETED": "export",
}


def lookup(key: Column, table: dict[str, object]) -> Column:
    """A small fixed table as a literal map; null for other keys."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def is_allowed(source: Column, target: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(source, F.lit(">"), target).isin(*pairs)


def event_name(source: Column, target: Column) -> Column:
    named = lookup(F.concat(source, F.lit(">"), target), {f"{a}>{b}": e for (a, b), e in EVENTS.items()})
    return F.coalesce(named, lookup(target, DEFAULT_EVENTS), F.concat(F.lower(target), F.lit("_started")))


def stage(status: Column) -> Column:
    return F.coalesce(lookup(status, STAGES), F.lit("source"))


def progress(status: Column, before: Column) -> Column:
    """Progress never falls; a cancelled job stays below 100."""
    reached = F.greatest(before, F.coalesce(lookup(status, PROGRESS), F.lit(0)))
    return F.when(status == "CANCELLED", F.least(before, F.lit(99))).otherwise(reached)


def numbered_events(events: DataFrame, held: DataFrame | None = None, order: tuple[str, ...] = ("occurred_at", "id")) -> DataFrame:
    """events with the next sequence_no of their job, gap-free; `held` has events numbered before."""
    w = Window.partitionBy("job_id").orderBy(*order)
    rows = events.withColumn("_n", F.row_number().over(w).cast("long"))
    if held is None:
        return rows.withColumnRenamed("_n", "sequence_no")
    last = held.groupBy("job_id").agg(F.max("sequence_no").alias("_last"))
    return rows.join(last, "job_id", "left").withColumn("sequence_no", F.col("_n") + F.coalesce("_last", F.lit(0))).drop("_n", "_last")


def current_states(transitions: DataFrame) -> DataFrame:
    """The state of each job: the target of its transition with the highest version."""
    return transitions.groupBy("job_id").agg(F.max_by("target", "status_version").alias("status"), F.max("status_version").alias("status_version"))


def illegal_transitions(transitions: DataFrame) -> DataFrame:
    """Transitions that aren't allowed, or whose source isn't the state before."""
    before = F.lag("target").over(Window.partitionBy("job_id").orderBy("status_version"))
    rows = transitions.withColumn("_before", before)
    bad = ~is_allowed(F.col("source"), F.col("target")) | (F.col("_before").isNotNull() & (F.col("_before") != F.col("source")))
    return rows.where(bad).drop("_before")


def retry_decision(retryable: Column, attempt: Column, most: Column) -> Column:
    """struct(next_attempt, action, delay_seconds) after a failed attempt."""
    nxt = attempt + 1
    again = retryable & (nxt <= most)
    return F.struct(
        nxt.alias("next_attempt"),
        F.when(again, "RESCHEDULE").otherwise("FAIL").alias("action"),
        F.when(again, backoff_seconds(nxt)).alias("delay_seconds"),
    )


def lease_decision(status: Column, expires: Column, now: Column, attempt: Column, most: Column) -> Column:
    """What happens to a leased job: KEEP, REQUEUE or FAIL."""
    lapsed = status.isin(*ACTIVE) & expires.isNotNull() & (expires < now)
    return F.when(~F.coalesce(lapsed, F.lit(False)), "KEEP").when(attempt + 1 > most, "FAIL").otherwise("REQUEUE")


def cancel_decision(status: Column, requested_at: Column, now: Column) -> Column:
    """At each checkpoint: CANCEL a job whose cancellation was requested, unless it has ended; else CONTINUE."""
    asked = requested_at.isNotNull() & (requested_at <= now) & ~status.isin(*TERMINAL)
    return F.when(F.coalesce(asked, F.lit(False)), "CANCEL").otherwise("CONTINUE")


def lease_until(now: Column, seconds: int) -> Column:
    return now + F.make_interval(secs=F.lit(seconds))


def outbox_due(outbox: DataFrame, now: Column, batch: int = 50) -> DataFrame:
    """The oldest unpublished commands that are due."""
    return outbox.where(F.col("published_at").isNull() & (F.col("available_at") <= now)).orderBy("created_at", "id").limit(batch)


def dispatch(outbox: DataFrame, now: Column, batch: int = 50) -> DataFrame:
    """Due commands, one per operation_key, as a transport that drops repeats would pass them on."""
    w = Window.partitionBy("operation_key").orderBy("created_at", "id")
    return outbox_due(outbox, now, batch).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def idempotent(requests: DataFrame) -> DataFrame:
    """Each request's outcome: NEW, REPLAY or CONFLICT; requests without a key are new each.

    Columns: project_id, key, request_hash, received_at, id.
    """
    w = Window.partitionBy("project_id", "key").orderBy("received_at", "id")
    first = F.first("request_hash").over(w)
    outcome = (
        F.when(F.col("key").isNull() | (F.row_number().over(w) == 1), "NEW").when(first == F.col("request_hash"), "REPLAY").otherwise("CONFLICT")
    )
    return requests.withColumn("outcome", outcome)


def claimable(commands: DataFrame, done: DataFrame) -> DataFrame:
    """Commands whose operation isn't done yet."""
    return commands.join(done.select("operation_key").distinct(), "operation_key", "left_anti")


def append_unique(new: DataFrame, held: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, duplicates): the first of each key that isn't held."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = held.select(*keys).distinct().withColumn("_held", F.lit(True))
    marked = new.withColumn("_n", F.row_number().over(w)).join(known, keys, "left")
    fresh = (F.col("_n") == 1) & F.col("_held").isNull()
    return marked.where(fresh).drop("_n", "_held"), marked.where(~fresh).drop("_n", "_held")


def exports_done(exports: DataFrame) -> DataFrame:
    """job_id, completed: whether a job has exports and all are completed."""
    return exports.groupBy("job_id").agg((F.bool_and(F.col("status") == "COMPLETED") & (F.count("*") > 0)).alias("completed"))


def trailing_hits(hits: DataFrame, key: str, ts: str, seconds: int) -> Column:
    """Hits of a key in the window (t - seconds, t], each counted whether it was let through or not."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return F.count("*").over(w)


def quiet_segments(hits: DataFrame, key: str, ts: str, seconds: int, name: str = "segment") -> DataFrame:
    """hits with a number for each stretch of a key's hits without a quiet gap of `seconds`.

    A key may have most of the hits, so no task gets a key: hits are range-partitioned by key
    and time and written once; gaps are seen inside partitions, and from the partitions' first
    and last hits, a row for each, between them.
    """
    part, at, starts = f"{name}_part", f"{name}_at", f"{name}_starts"
    placed = hits.repartitionByRange(key, ts).sortWithinPartitions(key, ts)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(placed.select("*", F.spark_partition_id().alias(part), within.alias(at)), "hits", keep=True)
    w = Window.partitionBy(part).orderBy(at)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # The first hit of a partition is compared with the last one before it below.
    new = ~F.lag(key).over(w).eqNullSafe(F.col(key)) | (micros - F.lag(micros).over(w) >= seconds * 1_000_000)
    marked = placed.withColumn(starts, F.when(F.col(at) == 0, 0).otherwise(F.coalesce(new, F.lit(True)).cast("int")))
    hit = F.struct(F.col(key).alias("key"), micros.alias("micros"))
    ends = marked.groupBy(part).agg(F.min_by(hit, at).alias("first"), F.max_by(hit, at).alias("last"), F.sum(starts).alias("starts")).orderBy(part)
    base, number, last = [], 0, None
    for r in ends.collect():
        if last is None or r["first"]["key"] != last["key"] or r["first"]["micros"] is None or last["micros"] is None or r["first"]["micros"] - last["micros"] >= seconds * 1_000_000:
            number += 1
        base.append((r[part], number))
        number, last = number + r["starts"], r["last"]
    bases = F.broadcast(hits.sparkSession.createDataFrame(base, f"{part} int, {name}_base long"))
    counted = marked.withColumn(name, F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return counted.join(bases, part).select(*hits.columns, (F.col(name) + F.col(f"{name}_base")).alias(name))


def admitted(hits: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """hits with `allowed`: at most `limit` admitted hits in any window, rejected ones not counted.

    Admission depends on what was admitted before, so hits are replayed in time order; a quiet
    gap as long as the window forgets all, so each stretch between gaps is replayed on its own.
    Only the admitted times in the window are held.
    """
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*hits.schema.fields, T.StructField("allowed", T.BooleanType())])

    def replay(batches):
        from collections import deque

        current, held = None, deque()
        for batch in batches:
            out = []
            for k, t in zip(batch["_segment"], batch[ts]):
                if k != current:
                    current, held = k, deque()
                start = t - pd.Timedelta(seconds=seconds)
                while held and held[0] <= start:
                    held.popleft()
                ok = len(held) < limit
                if ok:
                    held.append(t)
                out.append(ok)
            yield batch.drop(columns="_segment").assign(allowed=out)

    dealt = quiet_segments(hits, key, ts, seconds, "_segment").repartition("_segment").sortWithinPartitions("_segment", ts)
    return dealt.mapInPandas(replay, schema)


def failure_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RETRYABLE.items()), "code string, retryable boolean")


def retry_failures(failures: DataFrame) -> DataFrame:
    """failures (code, attempt, max_attempts) with the decision; unknown codes aren't retried."""
    known = failure_table(failures.sparkSession)
    joined = failures.join(F.broadcast(known), "code", "left").withColumn("retryable", F.coalesce("retryable", F.lit(False)))
    return joined.select("*", retry_decision(F.col("retryable"), F.col("attempt"), F.col("max_attempts")).alias("_d")).select("*", "_d.*").drop("_d")
