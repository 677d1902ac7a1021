"""Rule evaluation over records: a column per rule with the rank of its status, so that all rules are generated code.

Counts and severities are sums and maxima over those columns; the array of outcomes is
built from them last, and not at all where nobody asks for it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import urls, values
from siftline.plans.plan import Plan, PlanField

# Severities in rising order, and the pairs that must not be out of order.
SEVERITY = ("SKIPPED", "PASS", "WARN", "UNRESOLVED", "FAIL")
QUALITY = ("HIGH", "HIGH", "MEDIUM", "UNRESOLVED", "INVALID")
#: Ranks of the statuses.
SKIPPED, PASS, WARN, UNRESOLVED, FAIL = range(5)
ORDERED_PAIRS = (("start_date", "end_date"), ("min_price", "max_price"), ("discounted_price", "original_price"))
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
EVIDENCE_CHARS = 500


def passed(good: Column) -> Column:
    return F.when(good, PASS).otherwise(FAIL)


def is_missing(f: PlanField, value: Column) -> Column:
    blank = F.trim(F.regexp_replace(value.cast("string"), r"(?U)\s+", " ")) == ""
    return value.isNull() | (F.lit(f.type not in (*values.NUMERIC, "boolean")) & blank)


def type_status(f: PlanField, value: Column) -> Column:
    if f.type == "integer":
        return passed(values.is_finite(value) & (value == F.floor(value)))
    if f.type in values.NUMERIC:
        return passed(values.is_finite(value))
    return passed(value.isNotNull())


def format_rule(f: PlanField, value: Column) -> tuple[str, Column]:
    name = f"format.{f.type}.v1"
    if f.type == "url":
        return name, passed(value.rlike(r"^https?://[^/?#\s:@]"))
    if f.type == "email":
        return name, passed(value.rlike(EMAIL_SHAPE))
    if f.type == "date":
        return name, passed(values.iso_date(value).isNotNull())
    if f.type == "datetime":
        return name, passed(values.iso_datetime(value).isNotNull())
    if f.type in ("string", "text"):
        return name, passed(F.trim(value) != "")
    return "format.skipped.v1", F.lit(SKIPPED)


class Rule(NamedTuple):
    field: str
    rule_id: str
    #: The rank of its status, null where the rule doesn't apply.
    rank: Column


def field_rules(f: PlanField, missing: Column, cell: Column, base: Column | urls.Base, missing_evidence_warns: bool = True) -> list[Rule]:
    """The rules of one field in order; a missing value has only the first ones."""
    value, raw = cell["value"], cell["raw"]
    rules = [Rule(f.name, "required.v1", F.when(missing & F.lit(f.required), FAIL).otherwise(PASS))]
    if not f.required:
        rules.append(Rule(f.name, "optional_missing.v1", F.when(missing, WARN)))
    shape, shape_status = format_rule(f, value)
    again = values.normalised(raw, f.type, base)
    bounded = (F.length(cell["source_text"]) <= EVIDENCE_CHARS) & (cell["location"] != "")
    absent = cell["source_text"].isNull() & cell["location"].isNull()
    rest = [
        (f"type.{f.type}.v1", type_status(f, value)),
        (shape, shape_status),
        ("normalization.v1", F.when(raw.isNotNull(), passed(again.eqNullSafe(value)))),
        ("evidence.v1", F.when(absent, WARN if missing_evidence_warns else FAIL).otherwise(passed(bounded))),
    ]
    return rules + [Rule(f.name, name, F.when(~missing, rank)) for name, rank in rest]


def record_rules(plan: Plan, fields: Column, page_id: Column, plan_version: Column) -> list[Rule]:
    """Provenance, and a failure for each ordered pair that is out of order."""
    provenance = passed((plan_version.cast("string") == str(plan.plan_version)) & (F.coalesce(page_id, F.lit("")) != ""))
    have = {f.name for f in plan.fields}
    rules = [Rule("", "provenance.v1", provenance)]
    for low, high in ORDERED_PAIRS:
        if low in have and high in have:
            crossed = fields[low]["value"] > fields[high]["value"]
            rules.append(Rule("", f"cross_field.{low}.{high}.v1", F.when(crossed, FAIL)))
    return rules


def severity(ranks: list[str]) -> Column:
    """The gravest of the rank columns, 0 if all are null."""
    return F.coalesce(F.greatest(*ranks) if len(ranks) > 1 else F.col(ranks[0]), F.lit(SKIPPED))


def status_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITY)), rank + 1)


def quality_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, QUALITY)), rank + 1)


def counted(ranks: list[str]) -> Column:
    """struct of pass, fail, warn and unresolved counts over rank columns; skipped and null ones count nowhere."""
    n = lambda rank: F.expr(" + ".join(f"CAST({r} <=> {rank} AS BIGINT)" for r in ranks))
    return F.struct(*[n(rank).alias(SEVERITY[rank].lower()) for rank in (PASS, FAIL, WARN, UNRESOLVED)])


def outcomes_of(rules: dict[str, Rule]) -> Column:
    """field, rule_id and status of the rank columns that aren't null, in order."""
    names = ", ".join(f"'{x}'" for x in SEVERITY)
    made = [
        f"IF({c} IS NULL, NULL, named_struct('field', '{r.field}', 'rule_id', '{r.rule_id}', 'status', element_at(array({names}), {c} + 1)))"
        for c, r in rules.items()
    ]
    return F.expr(f"filter(array({', '.join(made)}), x -> x IS NOT NULL)")


def validate(records: DataFrame, plan: Plan) -> DataFrame:
    """records with outcomes, field_status, status, quality and summary added."""
    rows, base = records, None
    if any(f.type == "url" for f in plan.fields):
        rows, base = urls.Base.add(records, F.col("page_url"), "_rule_base")
    missing = [is_missing(f, F.col(f"fields.{f.name}.value")).alias(f"_missing{i}") for i, f in enumerate(plan.fields)]
    rows = rows.select("*", *missing)
    found = [r for i, f in enumerate(plan.fields) for r in field_rules(f, F.col(f"_missing{i}"), F.col(f"fields.{f.name}"), base)]
    found += record_rules(plan, F.col("fields"), F.col("page_id"), F.col("plan_version"))
    rules = {f"_rule{i}": r for i, r in enumerate(found)}
    rows = rows.select("*", *[r.rank.alias(c) for c, r in rules.items()]).withColumn("_rank", severity(list(rules)))
    per_field = [status_of(severity([c for c, r in rules.items() if r.field == f.name])).alias(f.name) for f in plan.fields]
    return rows.select(
        *records.columns,
        outcomes_of(rules).alias("outcomes"),
        (F.struct(*per_field) if per_field else F.lit(None)).alias("field_status"),
        status_of(F.col("_rank")).alias("status"),
        quality_of(F.col("_rank")).alias("quality"),
        counted(list(rules)).alias("summary"),
    )


def run_summary(validated: DataFrame) -> DataFrame:
    """One row for a run: records and the sums of the rule outcomes, as in reads of a run."""
    sums = [F.coalesce(F.sum(f"summary.{s}"), F.lit(0)).cast("long").alias(s) for s in ("pass", "fail", "warn", "unresolved")]
    return validated.agg(F.count("*").alias("records"), *sums)


def violations(validated: DataFrame, *keep: str) -> DataFrame:
    """The outcomes that are failures or warnings, a row each: the columns to keep, field, rule_id, status."""
    # Without "outer" Spark would filter by the array's size first, and so evaluate all rules twice.
    return validated.select(*keep, F.inline_outer("outcomes")).where(F.col("status").isin("FAIL", "WARN"))


def findings(validated: DataFrame) -> DataFrame:
    """record_identity and the findings as JSON text."""
    return validated.select("record_identity", F.to_json(F.struct("status", "quality", "summary", "field_status", "outcomes")).alias("findings"))
