"""Deduplication of records by the plan's keys, across pages.

A plan names up to five alternative keys, each one field or several joined by "+". Records
that agree on a key are the same thing, and so are those that a chain of such agreements
connects. The least record of each component represents it. Components come from rounds
of two steps on tables in the work folder: every record takes the least label of those
that share a key with it, then the label of its label, so that chains shrink by halves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import workspace
from siftline.functions import values
from siftline.plans.plan import Plan

MAX_ROUNDS = 60


def key_fields(plan: Plan) -> list[list[str]]:
    """The fields of each deduplication key; a field that the plan hasn't got is an error."""
    known = {f.name for f in plan.fields}
    keys = [[part.strip() for part in key.split("+")] for key in plan.deduplication.keys]
    for name in (n for key in keys for n in key):
        if name not in known:
            raise ValueError(f"deduplication key names no field of the plan: {name!r}")
    return keys


def _agreements(records: DataFrame, plan: Plan, id: str) -> DataFrame:
    """id, key: what a record can agree with others on. A key with a missing or blank value says nothing."""
    kinds = {f.name: f.type for f in plan.fields}
    found = []
    for i, names in enumerate(key_fields(plan)):
        texts = [F.trim(values.identity_text(F.col(f"fields.{n}.value"), kinds[n])) for n in names]
        # Zero and false are values here, unlike in an identity.
        texts = [F.when(F.col(f"fields.{n}.value").isNotNull(), F.coalesce(F.nullif(t, F.lit("")), F.when(F.lit(kinds[n] in (*values.NUMERIC, "boolean")), "0"))) for n, t in zip(names, texts)]
        whole = F.reduce(F.array(*texts), F.lit(True), lambda a, x: a & x.isNotNull())
        found.append(F.when(whole, F.sha2(F.to_json(F.struct(F.lit(i).alias("key"), F.array(*texts).alias("of"))), 256)))
    return records.select(F.col(id).alias("id"), F.explode(F.array_compact(F.array(*found))).alias("key"))


def components(pairs: DataFrame) -> DataFrame:
    """id, label: the least id that a record is connected with, for the records of pairs (id, key) that share a key with another."""
    spark = pairs.sparkSession
    several = pairs.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    pairs = workspace.materialise(pairs.join(several, "key", "left_semi").distinct(), "agreements", keep=True)
    labels = workspace.materialise(pairs.select("id", F.col("id").alias("label")).distinct(), "labels", keep=True)
    for _ in range(MAX_ROUNDS):
        with workspace.temporary(spark):
            least = workspace.materialise(pairs.join(labels, "id").groupBy("key").agg(F.min("label").alias("least")), "least")
            near = workspace.materialise(pairs.join(least, "key").groupBy("id").agg(F.min("least").alias("label")), "near")
            onward = near.select(F.col("id").alias("label"), F.col("label").alias("further"))
            after = near.join(onward, "label", "left").select("id", F.coalesce("further", "label").alias("label"))
            after = workspace.materialise(after, "labels", keep=True)
        before, labels = labels, after
        if before.join(labels, ["id", "label"], "left_anti").isEmpty():
            return labels
    raise RuntimeError("deduplication did not settle")


def deduplicated(records: DataFrame, plan: Plan, id: str = "record_identity") -> DataFrame:
    """records with `represented_by` (the id that stands for a record, its own if it stands for itself) and `kept`.

    `records` are those of extraction with an id column without nulls; rows of one id are one
    record. With deduplication switched off or without keys every record stands for itself.
    """
    itself = F.col(id)
    if not (plan.deduplication.enabled and plan.deduplication.keys):
        return records.select("*", itself.alias("represented_by"), F.lit(True).alias("kept"))
    labels = components(_agreements(records, plan, id)).select(F.col("id").alias("_id"), F.col("label").alias("_label"))
    joined = records.join(labels, records[id] == labels["_id"], "left")
    by = F.coalesce("_label", id)
    return joined.select(*[records[c] for c in records.columns], by.alias("represented_by"), (by == itself).alias("kept"))
