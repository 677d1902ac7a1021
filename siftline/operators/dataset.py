"""Export datasets: ordered, filtered, plan-ordered columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.plans.plan import Plan

POLICIES = {"ALL_RECORDS": None, "VALID_ONLY": ("PASS",), "VALID_AND_WARNINGS": ("PASS", "WARN")}
MAX_RECORDS = 10_000


class ExportTooLarge(ValueError):
    code = "EXPORT_TOO_LARGE"


@dataclass(frozen=True)
class Options:
    record_policy: str = "ALL_RECORDS"
    include_validation_metadata: bool = False
    include_provenance_metadata: bool = False


@dataclass(frozen=True)
class Dataset:
    """An ordered DataFrame with what the writers say about it."""

    rows: DataFrame
    fields: tuple[str, ...]
    validation_run_id: str
    plan_version: int
    options: Options
    title: str = "Extraction results"


def policy_filter(status: Column, policy: str) -> Column:
    allowed = POLICIES[policy]
    return F.lit(True) if allowed is None else F.coalesce(status.isin(*allowed), F.lit(False))


def check_size(df: DataFrame, most: int | None) -> None:
    """Refuse a table of more than `most` rows; reads at most one row more than that."""
    if most is not None and df.limit(most + 1).count() > most:
        raise ExportTooLarge(f"more than {most} records")


def build_dataset(
    validated: DataFrame, plan: Plan, run_id: str, options: Options = Options(), max_records: int | None = MAX_RECORDS
) -> Dataset:
    """Rows by record_identity in code point order. The size is checked before the policy filters.

    `validated` has record_identity, status, quality and either fields (a struct with value
    per plan field) or the plan's fields as columns.
    """
    check_size(validated, max_records)
    nested = "fields" in validated.columns
    values = [F.col(f"fields.{f.name}.value" if nested else f.name).alias(f.name) for f in plan.fields]
    extra: list[Column] = []
    if options.include_validation_metadata:
        extra += [F.col("status").alias("validation_status"), F.col("quality")]
    if options.include_provenance_metadata:
        extra += [F.col("record_identity")]
    rows = validated.where(policy_filter(F.col("status"), options.record_policy))
    rows = rows.orderBy(F.coalesce("record_identity", F.lit(""))).select(*values, *extra)
    return Dataset(rows, tuple(rows.columns), run_id, plan.plan_version, options)


def load_dataset(
    records: DataFrame, results: DataFrame, plan: Plan, run_id: str, options: Options = Options(), max_records: int | None = MAX_RECORDS
) -> Dataset:
    """The dataset of one run: records joined with that run's results, those without one left out."""
    own = results.where(F.col("validation_run_id") == run_id).select("record_id", "status", "quality")
    joined = records.join(own, records["id"] == own["record_id"]).drop("record_id")
    joined = joined.withColumn("record_identity", F.coalesce("record_identity", F.col("id").cast("string")))
    return build_dataset(joined, plan, run_id, options, max_records)
