import json

import pytest
from pyspark.sql import functions as F

from siftline.operators import discovery, extraction, validation
from siftline.plans.plan import Limits, Navigation, Plan, PlanField
from siftline.sources.pages import parse_page, parse_pages
from siftline.sources.structured import entities, find_value, locations

PLAN = Plan(
    "https://shop.example.com/",
    "Products with prices",
    (PlanField("name", "string", "Name", required=True), PlanField("price", "currency", "Price", required=True), PlanField("url", "url", "URL")),
)
URL = "https://shop.example.com/list/"


def run(spark, html, plan=PLAN):
    pages = spark.createDataFrame([(1, URL, html)], "page_id long, url string, html string")
    return [r.asDict(recursive=True) for r in extraction.extract(parse_pages(pages), plan).orderBy("record_index").collect()]


def values(record):
    return {k: v["value"] for k, v in record["fields"].items()}


def test_json_ld_first(spark):
    data = {"@type": "Product", "name": "Lamp", "brand": "x", "offers": {"price": "$12.50"}, "url": "/lamp"}
    html = f'<script type="application/ld+json">{json.dumps(data)}</script><script type="application/ld+json">{{bad</script><table><tr><th>Name</th></tr><tr><td>t</td></tr></table>'
    (r,) = run(spark, html)
    assert values(r) == {"name": "Lamp", "price": 12.5, "url": "https://shop.example.com/lamp"}
    assert (r["strategy"], r["location"], r["confidence"], r["malformed_json_ld"]) == ("structured_data", "json_ld[0]", 0.95, 1)


def test_graph_then_root():
    found, bad = entities([json.dumps({"@graph": [{"name": "a"}, 3], "name": "r"}), json.dumps([{"name": "b"}, 1]), "{"])
    assert [p for p, _ in found] == ["json_ld[0].@graph", "json_ld[0]", "json_ld[1]"] and bad == 1


def test_lookup_order():
    assert find_value(["price"], {"lowPrice": 3, "price": 5}) == 3
    assert find_value(["price"], {"offers": [{"x": 1}, {"price": {"value": 7}}]}) == 7
    assert find_value(["name"], {"@name": {"other": 1}}) == {"other": 1}
    assert find_value(["zzz"], {"a": 1}) is None


def test_tables(spark):
    html = (
        "<table><tr><th>Product name</th><th>Stock</th><th>Price</th></tr><tr><td>A</td><td>3</td><td>$1,000</td></tr><tr><td>B</td></tr><tr></tr></table>"
        "<table><tr><th>Other</th></tr><tr><td>z</td></tr></table>"
    )
    a, b = run(spark, html)
    assert values(a) == {"name": "A", "price": 1000.0, "url": None} and a["location"] == "table[0].row[0]"
    assert values(b) == {"name": "B", "price": None, "url": None} and b["strategy"] == "table"


def test_blocks(spark):
    html = '<article>Lamp $5 <a href="/l">x</a></article><article>Desk $7</article><li>no</li>'
    a, b = run(spark, html)
    assert values(a) == {"name": "Lamp $5 x", "price": None, "url": "https://shop.example.com/l"}
    assert values(b)["url"] == URL and b["strategy"] == "repeated_block" and b["location"] == "block[1]"


@pytest.mark.parametrize("html", ["<article>Only one block</article>", "<p>Just text</p>", "<li>ok</li><li>x</li>"])
def test_detail(spark, html):
    (r,) = run(spark, '<meta property="og:price" content="9.99"><meta property="og:title" content="t">' + html)
    assert r["strategy"] == "detail_page" and values(r)["price"] == 9.99 and values(r)["url"] == URL


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([(1, URL, None), (2, None, ""), (3, URL, "<")], "page_id long, url string, html string")
    got = extraction.extract(parse_pages(pages), PLAN).collect()
    assert sorted(r.page_id for r in got) == ["1", "2", "3"]


def test_record_cap(spark):
    plan = Plan(PLAN.source_url, PLAN.summary, PLAN.fields, limits=Limits(20, 2))
    assert len(run(spark, "<li>aaa</li>" * 5, plan)) == 2


def test_identity_is_stable_and_depends_on_values(spark):
    a, b = run(spark, "<li>aaa</li><li>bbb</li>")
    assert a["record_identity"] != b["record_identity"] and len(a["record_identity"]) == 64


def test_parser_details():
    got = parse_page('<title> T </title><p>a<p>b<script>var x="</p>"</script><style>p{}</style><a href="x y" rel="next" aria-label="L"> go <b>on</b></a>', URL)
    assert got["title"] == "T" and got["document"]["page_text"] == "a b go on"
    assert got["signals"] == [{"href": URL + "x y", "text": "go on", "rel": "next", "aria_label": "L"}]


def test_validation_vectors(spark):
    plan = Plan(
        "https://e.com/",
        "x",
        (
            PlanField("n", "integer", "N", required=True),
            PlanField("d", "date", "D"),
            PlanField("start_date", "date", "S"),
            PlanField("end_date", "date", "E"),
            PlanField("mail", "email", "M"),
        ),
    )
    rows = spark.createDataFrame(
        [(1, "4.5", "2024-01-01", "2024-02-01", "2024-01-01", "a@b.co"), (2, None, None, None, None, "x"), (3, "7", "2024-01-01", "2024-01-01", "2024-01-02", "a@b.co")],
        "id long, n string, d string, s string, e string, m string",
    )
    src = {"n": F.col("n"), "d": F.col("d"), "start_date": F.col("s"), "end_date": F.col("e"), "mail": F.col("m")}
    checked = validation.validate(extraction.records_from_table(rows, plan, F.col("id"), src), plan)
    got = {r.page_id: r for r in checked.collect()}
    fails = lambda i: {(o.field, o.rule_id) for o in got[i].outcomes if o.status == "FAIL"}
    assert fails("1") == {("n", "type.integer.v1"), ("", "cross_field.start_date.end_date.v1")}
    assert fails("2") == {("n", "required.v1")} and got["2"].quality == "INVALID"
    assert got["3"].status == "PASS" and got["3"].quality == "HIGH" and fails("3") == set()
    assert [o.rule_id for o in got["3"].outcomes if o.field == "n"] == ["required.v1", "type.integer.v1", "format.skipped.v1", "normalization.v1", "evidence.v1"]
    total = validation.run_summary(checked).first()
    assert total.records == 3 and total.fail == 3 and total.unresolved == 0
    assert validation.run_summary(checked.limit(0)).first().records == 0


def test_evidence_and_provenance(spark):
    plan = Plan("https://e.com/", "x", (PlanField("t", "text", "T"),))
    base = extraction.records_from_table(spark.createDataFrame([(1, "v")], "id long, t string"), plan, F.col("id"), {"t": F.col("t")})

    def status(**changed):
        cell = F.struct(*[changed.get(c, F.col(f"fields.t.{c}")).alias(c) for c in ("raw", "value", "type", "missing", "confidence", "source_text", "location")])
        rows = base.withColumn("fields", F.struct(cell.alias("t")))
        if "page" in changed:
            rows = rows.withColumn("page_id", changed["page"])
        return {o.rule_id: o.status for o in validation.validate(rows, plan).first().outcomes}

    nothing = F.lit(None).cast("string")
    assert status()["evidence.v1"] == "PASS"
    assert status(source_text=F.repeat(F.lit("x"), 501))["evidence.v1"] == "FAIL"
    assert status(location=nothing)["evidence.v1"] == "FAIL"
    assert status(location=nothing, source_text=nothing)["evidence.v1"] == "WARN"
    assert status(raw=F.lit("other"))["normalization.v1"] == "FAIL"
    assert status(page=F.lit(""))["provenance.v1"] == "FAIL"


DISCOVER = Plan("https://e.com/", "find great lamps", PLAN.fields, navigation=Navigation(5, follow_pagination=True, follow_relevant_links=True), limits=Limits(5, 10))


def decisions(spark, plan=DISCOVER, depth=0, seen=None, html=None):
    html = html or '<a href="/p?page=2" rel="next">Next</a><a href="/lamps#a">great lamps</a><a href="/lamps#b">again</a><a href="https://x.org/">out</a><a href="https://x.org/">out</a><a href="mailto:x">m</a>'
    pages = spark.createDataFrame([(1, "https://e.com/", depth, html)], "page_id long, url string, depth int, html string")
    links = discovery.exploded(parse_pages(pages).select("page_id", "url", "depth", "signals"))
    from siftline.functions import urls

    known = None if seen is None else spark.createDataFrame([(s,) for s in seen], "canonical_url string")
    got = discovery.decide(links, plan, key="page_id", canonical=urls.canonical_url("href", "url"), seen=known).orderBy("position").collect()
    return [(r.decision, r.discovered_via, r.relevance_score) for r in got]


def test_decisions(spark):
    got = decisions(spark)
    assert [d for d, _, _ in got] == ["candidate", "candidate", "duplicate", "rejected", "rejected", "unsupported"]
    assert got[0][1:] == ("PAGINATION", None) and got[1][1] == "RELEVANT_LINK"
    assert decisions(spark, seen=["https://e.com/lamps"])[1][0] == "duplicate"
    assert decisions(spark, depth=2) == []
    quiet = Plan("https://e.com/", "x", PLAN.fields)
    assert [d for d, _, _ in decisions(spark, quiet)][:3] == ["ignored", "ignored", "ignored"]


def test_inventory_cap(spark):
    rows = spark.createDataFrame(
        [(1, "a", "candidate", 1), (1, "b", "candidate", 2), (1, "known", "candidate", 3), (1, "c", "rejected", 4), (1, "d", "candidate", 5), (1, "a", "candidate", 6)],
        "job long, canonical_url string, decision string, seq int",
    )
    held = spark.createDataFrame([(1, "known", "DISCOVERED"), (1, "old", "REJECTED")], "job long, canonical_url string, status string")
    got = {r.seq: r.status for r in discovery.inventory(rows, 2, job="job", order=["seq"], existing=held).collect()}
    assert got == {1: "DISCOVERED", 2: "SKIPPED", 3: "DUPLICATE", 4: "REJECTED", 5: "SKIPPED", 6: "DUPLICATE"}


def test_sitemap():
    assert locations('<urlset xmlns="http://x"><url><loc> https://a/ </loc></url><url><image:loc xmlns:image="y">b</image:loc></url></urlset>') == ["https://a/", "b"]
    assert locations("<urlset><loc>") == [] and locations(None) == [] and locations("<loc>x</loc>", max_bytes=3) == []
    assert locations("<a><loc>1</loc><loc>2</loc></a>", max_urls=1) == ["1"]


def test_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "parent string, child string")
    got = {r.url: r.depth for r in discovery.levels(edges, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_levels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(60)] + [("3", None)], "parent string, child string")
    roots = spark.createDataFrame([("0",), ("0",)], "url string")
    reached = discovery.levels(edges, roots, 30)
    assert {r.url: r.depth for r in reached.collect()} == {str(i): i for i in range(31)}
    assert reached._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
    ended = discovery.levels(edges.where("parent < '2'"), roots, 100)
    assert {r.url: r.depth for r in ended.collect()} == {"0": 0, "1": 1, "2": 2}


def test_deeply_nested_json_ld_is_malformed(spark):
    import json

    from siftline.sources.structured import entities

    deep = "[" * 100_000
    closed = '{"name":' * 50_000 + "1" + "}" * 50_000
    found, malformed = entities([deep, '{"name": "a"}', closed, "{x", '[{"name": "b"}, 3, [{"name": "c"}]]', '{"@graph": [{"name": "d"}, 4], "name": "e"}', '"text"', "null"])
    assert [(place, e["name"]) for place, e in found] == [("json_ld[1]", "a"), ("json_ld[4]", "b"), ("json_ld[5].@graph", "d"), ("json_ld[5]", "e")] and malformed == 3
    html = f'<script type="application/ld+json">{deep}</script><script type="application/ld+json">{json.dumps({"title": "kept", "name": "kept"})}</script>'
    pages = spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")
    record = extraction.extract(parse_pages(pages), PLAN).first()
    assert record.malformed_json_ld == 1 and record.strategy == "structured_data"


def test_cut_off_scripts_do_not_reach_python(spark):
    from siftline.sources.structured import entities, scripts_to_read

    texts = ["[" * 100_000, "{broken", '[{"name": "a"}', '{"name": "b"}', '[{"name": "c"}]\n', '{"a": 1]', " [1", "[1 ", "7", "[", "x", ""]
    read = spark.createDataFrame([(texts,)], "s array<string>").select(scripts_to_read(F.col("s")).alias("s")).first().s
    assert read == ["", "", "", '{"name": "b"}', '[{"name": "c"}]\n', "", " [1", "[1 ", "7", "", "x", ""]
    assert entities(read) == entities(texts)


def test_compact_tables_are_spread(spark, tmp_path):
    from siftline import queries as engine

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert engine.QUERIES["extract_jsonld"](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_part_records_are_spread(spark, tmp_path):
    from siftline import queries as engine

    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert engine.QUERIES["record_findings"](spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() >= 4
