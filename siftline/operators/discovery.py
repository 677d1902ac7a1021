"""Discovery: signals to candidate decisions, inventory with a cap, and breadth-first levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import text as txt
from siftline.functions import urls
from siftline.plans.plan import Plan
from siftline.sources.structured import SITEMAP_URLS, sitemap_locations
from siftline.workspace import work_path

MAX_DEPTH = 2
MAX_LEVELS = 100


def exploded(pages: DataFrame, signals: str = "signals") -> DataFrame:
    """One row per anchor, in page order: the page's columns plus position, href, text, rel, aria_label."""
    rest = [c for c in pages.columns if c != signals]
    return pages.select(*rest, F.posexplode(signals).alias("position", "_s")).select(*rest, "position", "_s.*")


def classified(plan: Plan, text: Column, rel: Column, aria: Column, url: Column) -> Column:
    """struct(discovered_via, relevance_score, relevance_reason) of a link."""
    said = [F.coalesce(c, F.lit("")) for c in (text, aria, url)]
    corpus = F.lower(F.concat_ws(" ", *said, F.lit(plan.summary)))
    matched = txt.matched_tokens(corpus, txt.key_tokens(plan.summary))
    paging = txt.is_pagination(text, rel, url)
    return F.struct(
        F.when(paging, "PAGINATION").otherwise("RELEVANT_LINK").alias("discovered_via"),
        F.when(~paging, txt.relevance(matched)).alias("relevance_score"),
        F.when(paging, "pagination signal").when(F.size(matched) > 0, "keyword overlap").otherwise("same-scope navigation link").alias("relevance_reason"),
    )


def decide(
    links: DataFrame,
    plan: Plan,
    *,
    key: str,
    canonical: Column,
    policy: str = "SAME_ORIGIN",
    source: Column | None = None,
    seen: DataFrame | None = None,
    max_depth: int = MAX_DEPTH,
    allowed_domains: tuple[str, ...] = (),
) -> DataFrame:
    """A decision for each link of exploded(): candidate, rejected, duplicate, ignored or unsupported.

    `key` names the column of the page that holds the links; depth is that page's. A URL is
    a duplicate if it is in `seen` (canonical_url) or was a candidate earlier on its page;
    rejected links don't make later ones duplicates. Pages at the depth limit yield no rows.
    """
    source = F.lit(plan.source_url) if source is None else source
    depth = F.col("depth") if "depth" in links.columns else F.lit(0)
    inside = links.where((depth < min(plan.limits.max_pages, max_depth)))
    made = inside.withColumn("canonical_url", canonical)
    kind = classified(plan, F.col("text"), F.col("rel"), F.col("aria_label"), F.col("canonical_url"))
    made = made.withColumn("policy_decision", urls.scope_decision(F.col("canonical_url"), source, policy, allowed_domains))
    made = made.select("*", kind.alias("_k")).select("*", "_k.*").drop("_k")
    if seen is not None:
        known = seen.select(F.col("canonical_url").alias("_known")).distinct()
        made = made.join(known, made["canonical_url"] == known["_known"], "left")
    else:
        made = made.withColumn("_known", F.lit(None).cast("string"))
    followed = ((F.col("discovered_via") == "PAGINATION") & F.lit(plan.navigation.follow_pagination)) | (
        (F.col("discovered_via") == "RELEVANT_LINK") & F.lit(plan.navigation.follow_relevant_links)
    )
    wanted = F.col("canonical_url").isNotNull() & F.col("_known").isNull() & (F.col("policy_decision") == "ALLOWED") & followed
    first = Window.partitionBy(key, "canonical_url").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(wanted.cast("int")).over(first), F.lit(0)) == 1
    decision = (
        F.when(F.col("canonical_url").isNull(), "unsupported")
        .when(F.col("_known").isNotNull() | earlier, "duplicate")
        .when(F.col("policy_decision") != "ALLOWED", "rejected")
        .when(wanted, "candidate")
        .otherwise("ignored")
    )
    return made.withColumn("decision", decision).withColumn("link_depth", (depth + 1).cast("int")).drop("_known")


def sitemap_links(pages: DataFrame, xml: str) -> DataFrame:
    """Sitemap locations in the shape of exploded(), one row per location."""
    rest = [c for c in pages.columns if c != xml]
    found = pages.select(*rest, F.posexplode(F.slice(sitemap_locations(F.col(xml)), 1, SITEMAP_URLS)).alias("position", "href"))
    return found.select(*rest, "position", "href", *[F.lit("").alias(c) for c in ("text", "rel", "aria_label")])


def inventory(candidates: DataFrame, cap: int, *, job: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Candidates with status: DUPLICATE, REJECTED, DISCOVERED up to the cap of a job, SKIPPED beyond it.

    `existing` (job, canonical_url, status) holds pages already there: its URLs are
    duplicates, and those that aren't rejected count towards the cap.
    """
    rows = candidates
    if existing is not None:
        known = existing.select(F.col(job).alias("_job"), F.col("canonical_url").alias("_url")).distinct()
        rows = rows.join(known, (rows[job] == known["_job"]) & (rows["canonical_url"] == known["_url"]), "left")
        held = existing.where(~F.col("status").isin("REJECTED", "DUPLICATE")).groupBy(F.col(job).alias("_held_job")).agg(F.count("*").alias("_held"))
        rows = rows.join(held, rows[job] == held["_held_job"], "left").drop("_held_job", "_job")
    else:
        rows = rows.withColumn("_url", F.lit(None).cast("string")).withColumn("_held", F.lit(0))
    again = F.row_number().over(Window.partitionBy(job, "canonical_url").orderBy(*order)) > 1
    rows = rows.withColumn("_duplicate", F.col("_url").isNotNull() | again)
    open_ = ~F.col("_duplicate") & (F.col("decision") == "candidate")
    running = F.sum(open_.cast("int")).over(Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    status = (
        F.when(F.col("_duplicate"), "DUPLICATE")
        .when(F.col("decision") == "rejected", "REJECTED")
        .when(open_ & (F.coalesce("_held", F.lit(0)) + running <= cap), "DISCOVERED")
        .otherwise("SKIPPED")
    )
    return rows.withColumn("status", status).drop("_url", "_held", "_duplicate")


def levels(edges: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """url, depth of all pages reached breadth-first over edges (parent, child) from roots (url).

    Each level is written once, as a partition of one table in the work folder, so that it
    costs a scan of edges, of the last level and of what is reached, whatever the depth. Ends with
    the first level that is empty.
    """
    if max_depth > MAX_LEVELS:
        raise ValueError("too many levels")
    spark = edges.sparkSession
    table = work_path(spark, "levels")
    schema = T.StructType([roots.schema["url"], T.StructField("depth", T.IntegerType())])
    found = roots.select("url").distinct()
    for depth in range(max_depth + 1):
        found.write.option("compression", "zstd").parquet(f"{table}/depth={depth}")
        reached = spark.read.schema(schema).parquet(table)
        frontier = reached.where(F.col("depth") == depth)
        if depth == max_depth or frontier.isEmpty():
            break
        children = edges.join(frontier, edges["parent"] == frontier["url"], "left_semi").select(F.col("child").alias("url")).distinct()
        found = children.where("url is not null").join(reached, "url", "left_anti")
    return reached


def sitemap_requests(pages: DataFrame, seen: DataFrame, enabled: bool = True) -> DataFrame:
    """page_id, sitemap_url of the pages whose sitemap is to be read: depth 0, enabled, not seen yet."""
    asked = pages.where((F.col("depth") == 0) & F.lit(enabled)).select("page_id", urls.sitemap_url(F.col("url")).alias("sitemap_url"))
    known = seen.select(F.col("canonical_url").alias("sitemap_url"))
    return asked.where("sitemap_url is not null").join(known, "sitemap_url", "left_anti").select("page_id", "sitemap_url")
