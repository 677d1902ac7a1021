"""Plan-driven extraction as one lazy projection over parsed pages.

The plan is compiled into Column expressions once. All four strategies (structured data,
tables, repeated blocks, detail page) give candidates in one array on the page's row, whose
raw values are typed once; the first strategy with a value is kept and exploded: no join
and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import text as txt
from siftline.functions import urls, values
from siftline.plans.plan import Plan, PlanField
from siftline.sources.structured import script_values, scripts_to_read

STRATEGIES = ("structured_data", "table", "repeated_block", "detail_page")
EVIDENCE_CHARS = 500
LEAST_BLOCK_CHARS = 3
LEAST_BLOCKS = 2
RAWS = "array<string>"
CANDIDATES = "array<struct<strategy:string,location:string,raws:array<string>>>"


def _raw_columns(plan: Plan, given: list[Column], text: Column, url: Column) -> Column:
    """Raw values in plan order; a text field without one takes the source's text, a url field its url."""
    out = []
    for f, raw in zip(plan.fields, given):
        if f.type in ("string", "text"):
            raw = F.coalesce(raw, F.nullif(text, F.lit("")))
        elif f.type == "url":
            raw = F.coalesce(raw, F.nullif(url, F.lit("")))
        out.append(raw.cast("string"))
    return F.array(*out).cast(RAWS)


def has_value(values: list[Column]) -> Column:
    """Whether any of a record's typed values is there."""
    return F.coalesce(*[F.when(v.isNotNull(), True) for v in values], F.lit(False))


def _candidate(strategy: str, location: Column, raws: Column) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), location.alias("location"), raws.alias("raws"))


def column_for(field: PlanField, headers: Column) -> Column:
    """Index of the first header that is or contains one of the field's names, null if there is none."""
    plain = F.transform(headers, lambda h: F.lower(txt.collapse(h)))
    hit = F.transform(plain, lambda h, i: F.when(_any_name(field, h), i))
    return F.get(F.filter(hit, lambda i: i.isNotNull()), F.lit(0))


def _any_name(field: PlanField, text: Column) -> Column:
    out = F.lit(False)
    for name in field.names():
        out = out | F.contains(text, F.lit(name))
    return out


def structured_candidates(plan: Plan, document: Column, entities: Column) -> Column:
    return F.transform(
        entities,
        lambda e: _candidate(
            "structured_data",
            e["location"],
            _raw_columns(plan, [F.get(e["raws"], F.lit(i)) for i in range(len(plan.fields))], e["text"], e["url"]),
        ),
    )


def table_candidates(plan: Plan, document: Column) -> Column:
    """One candidate per row of each table that has a header for some plan field."""

    def rows(table: Column, t: Column) -> Column:
        at = F.array(*[column_for(f, table["headers"]) for f in plan.fields])
        mapped = F.exists(at, lambda i: i.isNotNull())
        place = lambda r: F.format_string("table[%d].row[%d]", t, r)
        nothing = F.lit(None).cast("string")
        made = F.transform(
            table["rows"],
            lambda row, r: _candidate(
                "table",
                place(r),
                _raw_columns(plan, [F.get(row, F.get(at, F.lit(i))) for i in range(len(plan.fields))], nothing, nothing),
            ),
        )
        return F.when(mapped, made).otherwise(F.filter(made, lambda _: F.lit(False)))

    return F.flatten(F.transform(document["tables"], rows))


def block_candidates(plan: Plan, document: Column, page_url: Column) -> Column:
    """Candidates of blocks with enough text, none unless there are two."""
    useful = F.filter(document["blocks"], lambda b: F.length(b["text"]) >= LEAST_BLOCK_CHARS)

    def one(b: Column, i: Column) -> Column:
        href = F.coalesce(F.nullif(b["href"], F.lit("")), page_url)
        source = {"text": b["text"], "url": href, "image": F.coalesce(b["image_url"], F.lit(""))}
        given = [_first_named(f, list(source.items())) for f in plan.fields]
        return _candidate("repeated_block", F.format_string("block[%d]", i), _raw_columns(plan, given, b["text"], href))

    return F.when(F.size(useful) >= LEAST_BLOCKS, F.transform(useful, one)).otherwise(F.array().cast(CANDIDATES))


def _first_named(field: PlanField, pairs: list[tuple[str, Column]]) -> Column:
    """The value whose fixed key is or contains a name of the field, in order."""
    for key, value in pairs:
        if any(n in key for n in field.names()):
            return value
    return F.lit(None).cast("string")


def _named_entries(field: PlanField, entries: Column) -> Column:
    return F.filter(entries, lambda e: _any_name(field, F.replace(F.lower(e["key"]), F.lit("@"), F.lit(""))))


def detail_candidate(plan: Plan, document: Column, page_url: Column) -> Column:
    """The page as one record: OpenGraph values, then its url and text."""
    graph = F.filter(F.map_entries(document["open_graph"]), lambda e: ~e["key"].isin("url", "text"))
    given = []
    for f in plan.fields:
        named = _named_entries(f, graph)
        own = _first_named(f, [("url", page_url), ("text", document["page_text"])])
        given.append(F.coalesce(F.get(named, F.lit(0))["value"], own))
    return F.array(_candidate("detail_page", F.lit("document"), _raw_columns(plan, given, document["page_text"], page_url)))


def extract(parsed: DataFrame, plan: Plan, page_id: str = "page_id", page_url: str = "url", capped: bool = True) -> DataFrame:
    """One row per record of each parsed page; if `capped`, up to the plan's number of records a page.

    Columns: page_id, page_url, record_index, strategy, location, confidence, plan_version,
    record_identity, malformed_json_ld, truncated and fields, a struct with a struct of raw,
    value, type, missing, confidence, source_text and location per plan field.
    """
    rows = parsed.select(
        F.col(page_id).cast("string").alias("page_id"),
        F.col(page_url).alias("page_url"),
        # The scripts themselves are no longer asked for: rows wait for the Arrow function without them.
        F.struct(*[f"document.{n}" for n in ("page_text", "open_graph", "tables", "blocks", "truncated")]).alias("document"),
        script_values(plan)(scripts_to_read(F.col("document.json_ld"))).alias("_scripts"),
    ).select("page_id", "page_url", "document", F.col("_scripts.entities").alias("_entities"), F.col("_scripts.malformed").alias("malformed_json_ld"))
    rows, base = urls.Base.add(rows, F.col("page_url"))
    url, document = F.col("page_url"), F.col("document")
    found = F.concat(
        structured_candidates(plan, document, F.col("_entities")),
        table_candidates(plan, document),
        block_candidates(plan, document, url),
        detail_candidate(plan, document, url),
    )

    def typed(c: Column) -> Column:
        values_ = [values.normalised(F.get(c["raws"], F.lit(i)), f.type, base).alias(f"_v{i}") for i, f in enumerate(plan.fields)]
        return F.struct(c["strategy"].alias("strategy"), c["location"].alias("location"), c["raws"].alias("raws"), *values_)

    def good(c: Column) -> Column:
        return (c["strategy"] == "detail_page") | has_value([c[f"_v{i}"] for i in range(len(plan.fields))])

    kept = rows.withColumn("_found", F.filter(F.transform(found, typed), good))
    of = lambda name: F.size(F.filter("_found", lambda c: c["strategy"] == name))
    least = {name: LEAST_BLOCKS if name == "repeated_block" else 1 for name in STRATEGIES}
    chosen = F.coalesce(*[F.when(of(name) >= least[name], name) for name in STRATEGIES])
    taken = F.filter("_found", lambda c: c["strategy"] == F.col("_chosen"))
    rows = kept.withColumn("_chosen", chosen).select(
        "page_id",
        "page_url",
        "malformed_json_ld",
        F.col("document.truncated").alias("truncated"),
        # There always is one. Without "outer" Spark would filter by the array's size first, and so make the array twice.
        F.posexplode_outer(F.slice(taken, 1, plan.limits.max_records) if capped else taken).alias("record_index", "_c"),
    )
    return _records(rows.select("*", *[F.col(f"_c._v{i}") for i in range(len(plan.fields))]), plan)


def _records(rows: DataFrame, plan: Plan) -> DataFrame:
    """Fields, identity and provenance of exploded candidates with their typed values in _v0, _v1, ..."""
    url, strategy = F.col("page_url"), F.col("_c.strategy")
    fields = []
    for i, f in enumerate(plan.fields):
        raw, value = F.get(F.col("_c.raws"), F.lit(i)), F.col(f"_v{i}")
        clean = F.when(raw.isNotNull(), txt.collapse(raw))
        fields.append(
            F.struct(
                clean.alias("raw"),
                value.alias("value"),
                F.lit(f.type).alias("type"),
                value.isNull().alias("missing"),
                F.when(strategy == "structured_data", "high").otherwise("medium").alias("confidence"),
                F.left(clean, F.lit(EVIDENCE_CHARS)).alias("source_text"),
                F.when(raw.isNotNull(), F.col("_c.location")).alias("location"),
            ).alias(f.name)
        )
    identity = values.record_identity(F.col("page_id"), url, [(F.col(f"_v{i}"), f.type) for i, f in enumerate(plan.fields)])
    return rows.select(
        "page_id",
        "page_url",
        F.col("record_index").cast("long").alias("record_index"),
        strategy.alias("strategy"),
        F.col("_c.location").alias("location"),
        F.when(strategy == "structured_data", 0.95).otherwise(0.7).alias("confidence"),
        F.lit(plan.plan_version).alias("plan_version"),
        identity.alias("record_identity"),
        "malformed_json_ld",
        "truncated",
        F.struct(*fields).alias("fields"),
    )


def records_from_table(df: DataFrame, plan: Plan, key: Column, source: dict[str, Column], url: Column | None = None) -> DataFrame:
    """Rows of a flat table as records: `source` gives the raw text of each plan field by name."""
    where = url if url is not None else F.lit(plan.source_url)
    raws = F.array(*[source[f.name].cast("string") if f.name in source else F.lit(None).cast("string") for f in plan.fields])
    rows = df.select(
        key.cast("string").alias("page_id"),
        where.alias("page_url"),
        F.lit(0).alias("malformed_json_ld"),
        F.lit(False).alias("truncated"),
        F.lit(0).alias("record_index"),
        _candidate("table", F.lit("table[0]"), raws).alias("_c"),
    )
    rows, base = urls.Base.add(rows, F.col("page_url"))
    typed = [values.normalised(F.get(F.col("_c.raws"), F.lit(i)), f.type, base).alias(f"_v{i}") for i, f in enumerate(plan.fields)]
    return _records(rows.select("*", *typed), plan)


def flat(records: DataFrame, plan: Plan, *keep: str) -> DataFrame:
    """The wide table of values: one typed column per plan field."""
    return records.select(*keep, *[F.col(f"fields.{f.name}.value").alias(f.name) for f in plan.fields])


def long_fields(records: DataFrame, plan: Plan) -> DataFrame:
    """One row per record and field: record_identity, field, type, raw, value as text, missing."""
    entries = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.lit(f.type).alias("type"),
            F.col(f"fields.{f.name}.raw").alias("raw"),
            (values.number_text(F.col(f"fields.{f.name}.value")) if f.type in values.NUMERIC else F.col(f"fields.{f.name}.value").cast("string")).alias("value"),
            F.col(f"fields.{f.name}.missing").alias("missing"),
        )
        for f in plan.fields
    ]
    return records.select("record_identity", F.inline(F.array(*entries)))


def envelope(records: DataFrame, plan: Plan) -> DataFrame:
    """record_identity and the records.v1 payload as JSON text, with its content hash."""
    payload = F.struct(
        F.lit("records.v1").alias("schema_version"),
        F.col("record_identity").alias("record_id"),
        "plan_version",
        "fields",
        F.struct(
            F.col("page_url").alias("source_url"),
            F.col("page_url").alias("canonical_url"),
            "page_id",
            F.col("plan_version").cast("string").alias("plan_version"),
        ).alias("provenance"),
    )
    return records.select("record_identity", F.to_json(payload).alias("payload"), values.content_hash(payload).alias("content_hash"))
