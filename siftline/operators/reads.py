"""Reads over the engine's tables: ownership, pages of results, files, status and events.

Each takes DataFrames and returns a lazy DataFrame. `now` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 100
COUNTS = ("pass", "fail", "warn", "unresolved", "records")


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, limit) with page at least 1 and size 1 to 100."""
    size = min(MAX_PAGE_SIZE, max(1, size))
    return (max(1, page) - 1) * size, size


def paged(df: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    offset, limit = page_bounds(page, size)
    return df.orderBy(*order).offset(offset).limit(limit)


def last_page(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def owned(df: DataFrame, projects: DataFrame, principal: Column) -> DataFrame:
    """Rows whose project belongs to the principal; what isn't owned isn't there."""
    own = projects.where(F.col("owner_id") == principal).select(F.col("id").alias("project_id"))
    return df.join(own, "project_id", "left_semi")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each group that comes first in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_plan(plans: DataFrame) -> DataFrame:
    return latest(plans, ["job_id"], [F.desc("version")])


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest completed validation run of each job."""
    return latest(runs.where(F.col("status") == "COMPLETED"), ["job_id"], [F.desc("run_number")])


def results_page(records: DataFrame, results: DataFrame, page: int, size: int, order: list[str] | None = None) -> DataFrame:
    """One page of records with their validation of a run, null where there is none.

    `results` holds one run. The page is cut first, so that the join is with a page of ids.
    """
    order = order or ["created_at", "id"]
    chosen = paged(records, order, page, size)
    own = results.select("record_id", F.col("status").alias("validation_status"), "quality")
    return chosen.join(own, chosen["id"] == own["record_id"], "left").drop("record_id").orderBy(*order)


def values_only(fields: str = "fields") -> Column:
    """A map of structs reduced to its values."""
    return F.transform_values(fields, lambda _, v: v["value"])


def summary_with_defaults(summary: Column) -> Column:
    """The known counters of a JSON summary, 0 where one is absent or no integer."""
    return F.struct(*[F.coalesce(F.get_json_object(summary, f"$.{c}").try_cast("long"), F.lit(0)).alias(c) for c in COUNTS])


def needs_review(warn: Column, unresolved: Column) -> Column:
    return F.coalesce(warn, F.lit(0)) + F.coalesce(unresolved, F.lit(0))


def result_columns(df: DataFrame, data: str, order: list[str]) -> DataFrame:
    """Keys of a map column in order of first appearance: key, position.

    The keys are the fields of plans (64 at most in one), so their window is a small one.
    """
    w = Window.orderBy("_at", "_i")
    keys = df.select(F.struct(*order).alias("_at"), F.posexplode(F.map_keys(data)).alias("_i", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct("_at", "_i")).alias("_first")).select("key", "_first._at", "_first._i")
    return first.select("key", F.row_number().over(w).alias("position"))


def page_inventory(pages: DataFrame, page: int, size: int) -> DataFrame:
    columns = [
        "id", "url", "canonical_url", "final_url", "status", "title", "depth", "parent_page_id", "discovered_via", "policy_decision",
        "relevance_score", "relevance_reason", "http_status", "discovered_at", "visited_at",
    ]
    return paged(pages, ["depth", "discovered_at", "id"], page, size).select(*[c for c in columns if c in pages.columns])


def files(generated: DataFrame, exports: DataFrame, now: Column) -> DataFrame:
    """Files of a job's exports that haven't expired, with their download URL."""
    job = exports.select(F.col("id").alias("export_job_id"), "job_id", "format")
    live = generated.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    url = F.concat(F.lit("/api/files/"), F.col("id"), F.lit("/download"))
    return live.join(job, "export_job_id").withColumn("download_url", url).orderBy("created_at", "id")


def owned_files(generated: DataFrame, exports: DataFrame, jobs: DataFrame, projects: DataFrame, principal: Column, now: Column) -> DataFrame:
    """Live files through exports, jobs and projects to their owner."""
    own = owned(jobs, projects, principal).select(F.col("id").alias("job_id"))
    return files(generated, exports, now).join(own, "job_id", "left_semi")


def job_status(jobs: DataFrame, plans: DataFrame) -> DataFrame:
    """Status with the latest plan, and an error only where a code is set."""
    plan = latest_plan(plans).select("job_id", F.struct("version", "plan_hash").alias("plan"))
    error = F.when(F.col("last_error_code").isNotNull(), F.struct("last_error_code", "last_error_message", "retryable"))
    return jobs.join(plan, jobs["id"] == plan["job_id"], "left").drop("job_id").withColumn("error", error)


def accepted_job(jobs: DataFrame) -> DataFrame:
    """What the creator of a job is told: its ids, state, and progress as it stood at creation."""
    progress = F.struct(
        F.col("progress_percent").alias("percent"), F.col("status").alias("stage"), F.lit("Job accepted").alias("message"), F.col("created_at").alias("updated_at")
    )
    return jobs.select(F.col("id").alias("job_id"), "project_id", "status", progress.alias("progress"), "created_at")


def events_after(events: DataFrame, cursor: int) -> DataFrame:
    return events.where(F.col("sequence_no") > cursor).orderBy("job_id", "sequence_no")


def event_frame() -> Column:
    """The JSON of one event for a stream: its payload with job_id and occurred_at."""
    body = F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>"))
    clean = F.map_filter(body, lambda k, _: ~k.isin("job_id", "occurred_at"))
    own = F.create_map(F.lit("job_id"), F.col("job_id").cast("string"), F.lit("occurred_at"), F.col("occurred_at").cast("string"))
    return F.to_json(F.map_concat(clean, own))


def expired(first: DataFrame, second: DataFrame, now: Column, budget: int) -> DataFrame:
    """The oldest expired rows of two tables within one budget, the first table's before the second's."""
    take = lambda df, name: (
        df.where(F.col("expires_at").isNotNull() & (F.col("expires_at") <= now))
        .orderBy("expires_at", "id")
        .limit(budget)
        .select(F.lit(name).alias("kind"), "id", "expires_at")
    )
    both = take(first, "0_first").unionByName(take(second, "1_second"))
    return both.orderBy("kind", "expires_at", "id").limit(budget)
