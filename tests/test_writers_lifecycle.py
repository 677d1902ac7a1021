import csv
import io
import json
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from siftline.operators import dataset as ds
from siftline.operators import lifecycle as lc
from siftline.operators import reads
from siftline.plans.plan import Plan, PlanField
from siftline.plans.schemas import TABLES, UNIQUE, schema
from siftline.sinks import artifacts, writers
from siftline.streaming import jobs

PLAN = Plan("https://e.com/", "x", (PlanField("name", "string", "N"), PlanField("price", "number", "P")))
ROWS = [("b", "PASS", "HIGH", "=1+1", 0.0), ("a", "WARN", "MEDIUM", "pi|pe\nx", None), ("c", "FAIL", "INVALID", "ü, \"q\"", 2.5), (None, "PASS", "HIGH", "<b>", 1.0)]


def validated(spark, rows=ROWS):
    return spark.createDataFrame(rows, "record_identity string, status string, quality string, name string, price double")


def made(spark, **options):
    return ds.build_dataset(validated(spark), PLAN, "run-1", ds.Options(**options))


def test_policies_and_order(spark):
    assert [r.name for r in made(spark).rows.collect()] == ["<b>", "pi|pe\nx", "=1+1", 'ü, "q"']
    assert [r.name for r in made(spark, record_policy="VALID_ONLY").rows.collect()] == ["<b>", "=1+1"]
    assert len(made(spark, record_policy="VALID_AND_WARNINGS").rows.collect()) == 3
    assert made(spark, include_validation_metadata=True, include_provenance_metadata=True).fields == ("name", "price", "validation_status", "quality", "record_identity")
    with pytest.raises(ds.ExportTooLarge):
        ds.build_dataset(validated(spark), PLAN, "r", ds.Options("VALID_ONLY"), 3)
    with pytest.raises(KeyError):
        made(spark, record_policy="SOME")


def test_load_dataset(spark):
    records = spark.createDataFrame([(1, "x", "n1", 1.0), (2, None, "n2", 2.0), (3, "z", "n3", 3.0)], "id long, record_identity string, name string, price double")
    results = spark.createDataFrame([(1, "r", "PASS", "HIGH"), (2, "r", "PASS", "HIGH"), (3, "old", "PASS", "HIGH")], "record_id long, validation_run_id string, status string, quality string")
    assert [r.name for r in ds.load_dataset(records, results, PLAN, "r").rows.collect()] == ["n2", "n1"]


def test_csv(spark):
    rows = list(csv.reader(io.StringIO(writers.render(made(spark), "csv").decode())))
    assert rows == [["name", "price"], ["<b>", "1.0"], ["pi|pe\nx", ""], ["'=1+1", "0.0"], ['ü, "q"', "2.5"]]
    assert b"'=1+1,\n" in writers._csv(made(spark), [r.asDict() for r in made(spark).rows.collect()], blank_falsy=True)


def test_distributed_csv_and_json(spark, tmp_path):
    writers.write_csv(made(spark).rows, f"file://{tmp_path}/c")
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"file://{tmp_path}/c")
    assert {r.name for r in back.collect()} == {"<b>", "pi|pe\nx", "'=1+1", 'ü, "q"'}
    writers.write_json_lines(made(spark).rows, f"file://{tmp_path}/j")
    assert spark.read.json(f"file://{tmp_path}/j").count() == 4


def test_json(spark):
    body = json.loads(writers.render(made(spark), "json"))
    assert body["record_count"] == 4 and body["fields"] == ["name", "price"] and body["records"][1] == {"name": "pi|pe\nx", "price": None}


def test_text_forms(spark):
    md = writers.render(made(spark), "md").decode()
    assert "| pi\\|pe<br>x | — |" in md and md.startswith("# Extraction results\n\n## Summary\n- Records: 4\n")
    txt = writers.render(made(spark), "txt").decode()
    assert "#" not in txt and "|" not in txt
    rows = [r.asDict() for r in made(spark).rows.collect()]
    assert "#Summary" in writers._txt(made(spark), rows, legacy=True).decode()
    html = writers.render(made(spark), "html").decode()
    assert "<td>&lt;b&gt;</td>" in html and "<td>ü, &quot;q&quot;</td>" in html
    empty = ds.Dataset(made(spark).rows.limit(0), ("name", "price"), "r", 1, ds.Options())
    assert "No records found." in writers.render(empty, "md").decode()
    for name in writers.WRITERS:
        assert writers.render(empty, name)


def test_xlsx(spark):
    z = zipfile.ZipFile(io.BytesIO(writers.render(made(spark, include_validation_metadata=True), "xlsx")))
    assert z.testzip() is None
    for name in z.namelist():
        ET.fromstring(z.read(name))
    ns = {"s": writers.SHEET}
    sheet = ET.fromstring(z.read("xl/worksheets/sheet1.xml"))
    cells = [[(c.find(".//s:t", ns).text if c.get("t") == "inlineStr" else c.find("s:v", ns).text) for c in row] for row in sheet.findall(".//s:row", ns)]
    assert cells[0] == ["name", "price", "validation_status", "quality"] and cells[3][:2] == ["'=1+1", "0.0"]
    assert sheet.find(".//s:pane", ns).get("topLeftCell") == "A2" and sheet.find("s:autoFilter", ns).get("ref") == "A1:D5"
    assert "Validation Summary" in z.read("xl/workbook.xml").decode()


def test_docx_and_pdf(spark):
    z = zipfile.ZipFile(io.BytesIO(writers.render(made(spark), "docx")))
    assert "ü, \"q\"" in "".join(ET.fromstring(z.read("word/document.xml")).itertext())
    pdf = writers.render(made(spark), "pdf")
    assert pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n") and b"/MediaBox [0 0 595 842]" in pdf
    start = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[start:].startswith(b"xref")
    for line in pdf[start:].split(b"\n")[3:6]:
        assert pdf[int(line[:10]) :].split(b" ", 2)[1:2] == [b"0"]
    wide = ds.Dataset(spark.range(300).select(*[F.col("id").alias(f"f{i}") for i in range(6)]), tuple(f"f{i}" for i in range(6)), "r", 1, ds.Options())
    many = writers.render(wide, "pdf")
    assert b"/MediaBox [0 0 842 595]" in many and many.count(b"/Type /Page ") > 3


def test_limits(spark):
    with pytest.raises(writers.UnsupportedFormat):
        writers.render(made(spark), "exe")
    with pytest.raises(ds.ExportTooLarge):
        writers.render(made(spark), "csv", max_records=3)
    with pytest.raises(ds.ExportTooLarge):
        writers.render(made(spark), "csv", max_bytes=10)


def test_artifacts(spark, tmp_path):
    store = artifacts.LocalArtifacts(tmp_path, max_bytes=5000)
    a = artifacts.store_export(store, made(spark), "csv")
    assert b"".join(store.open(a)) == writers.render(made(spark), "csv") and store.head(a).byte_size == a.byte_size
    assert store.read_all(spark).count() == 1
    store.delete(a)
    store.delete(a)
    for bad in ("../x", "export/zz", "/etc/passwd"):
        with pytest.raises(artifacts.ArtifactError):
            store.head(artifacts.Artifact(bad, "text/csv", 0, ""))
    with pytest.raises(artifacts.ArtifactError):
        store.put("export", [b"x" * 6000], "text/csv")
    with pytest.raises(artifacts.ArtifactError):
        store.put("export", [b"x"], "application/x-evil")
    assert list(tmp_path.rglob("*.*")) == []


def test_schemas():
    assert len(TABLES) == 15
    for name in TABLES:
        assert schema(name).names
    for name, keys in UNIQUE.items():
        assert all(set(k) <= set(schema(name).names) for k in keys)


# ---------------------------------------------------------------- lifecycle


def test_transitions(spark):
    pairs = spark.createDataFrame([(a, b) for a in lc.STATES for b in lc.STATES], "a string, b string")
    got = {(r.a, r.b) for r in pairs.where(lc.is_allowed(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, bs in lc.TRANSITIONS.items() for b in bs}


def test_retries(spark):
    rows = spark.createDataFrame([("PLANNER_TIMEOUT", 0, 3), ("PLANNER_TIMEOUT", 3, 3), ("EXPORT_TOO_LARGE", 0, 3), ("?", 0, 3)], "code string, attempt int, max_attempts int")
    got = [(r.action, r.delay_seconds) for r in lc.retry_failures(rows).orderBy("code", "attempt").collect()]
    assert sorted(got, key=str) == sorted([("FAIL", None), ("FAIL", None), ("RESCHEDULE", 1.0), ("FAIL", None)], key=str)


def test_limiter_edges(spark):
    t0 = datetime(2024, 1, 1)
    times = [0, 1, 2, 10, 11, 12]
    hits = spark.createDataFrame([(i, "k", t0 + timedelta(seconds=s)) for i, s in enumerate(times)], "id int, key string, ts timestamp")
    got = {r.id: r.allowed for r in lc.admitted(hits, "key", "ts", 2, 10).collect()}
    # The hit at 10 comes as the one at 0 leaves; the rejected one at 2 was never held.
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False}
    counts = {r.id: r.n for r in hits.select("id", lc.trailing_hits(hits, "key", "ts", 10).alias("n")).collect()}
    assert counts == {0: 1, 1: 2, 2: 3, 3: 3, 4: 3, 5: 3}


def test_idempotency_without_key(spark):
    rows = spark.createDataFrame([(1, 1, None, "a", 1), (2, 1, None, "b", 2), (3, 1, "k", "a", 3), (4, 1, "k", "b", 4), (5, 1, "k", "a", 5)], "id int, project_id int, key string, request_hash string, received_at int")
    assert {r.id: r.outcome for r in lc.idempotent(rows).collect()} == {1: "NEW", 2: "NEW", 3: "NEW", 4: "CONFLICT", 5: "REPLAY"}


def test_owned_files(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    files = spark.createDataFrame([("f1", "e1", None), ("f2", "e1", datetime(2024, 1, 1)), ("f3", "e2", None)], "id string, export_job_id string, expires_at timestamp").withColumn("created_at", F.lit(1))
    exports = spark.createDataFrame([("e1", "j1", "csv"), ("e2", "j2", "csv")], "id string, job_id string, format string")
    job_rows = spark.createDataFrame([("j1", "p1"), ("j2", "p2")], "id string, project_id string")
    projects = spark.createDataFrame([("p1", "me"), ("p2", "you")], "id string, owner_id string")
    assert [r.id for r in reads.owned_files(files, exports, job_rows, projects, F.lit("me"), now).collect()] == ["f1"]


def test_job_status(spark):
    rows = spark.createDataFrame([("j1", "FAILED", "X", "m", True), ("j2", "QUEUED", None, None, None)], "id string, status string, last_error_code string, last_error_message string, retryable boolean")
    plans = spark.createDataFrame([("j1", 1, "h1"), ("j1", 2, "h2")], "job_id string, version int, plan_hash string")
    got = {r.id: r for r in reads.job_status(rows, plans).collect()}
    assert got["j1"].plan.version == 2 and got["j1"].error.last_error_code == "X" and got["j2"].plan is None and got["j2"].error is None


def test_paging_bounds():
    assert reads.page_bounds(0, 1000) == (0, 100) and reads.page_bounds(3, 0) == (2, 1)


def test_summary_defaults(spark):
    row = spark.createDataFrame([('{"pass": 3, "fail": "x", "other": 9}',)], "s string").select(reads.summary_with_defaults(F.col("s")).alias("v")).first().v
    assert row.asDict() == {"pass": 3, "fail": 0, "warn": 0, "unresolved": 0, "records": 0}


def test_values_only(spark):
    df = spark.sql("select map('a', named_struct('value', 1, 'raw', 'x')) as fields")
    assert df.select(reads.values_only().alias("v")).first().v == {"a": 1}


# ---------------------------------------------------------------- streaming


def test_streamed_numbers_go_on_across_batches(spark, tmp_path):
    kinds = "id long, job_id string, occurred_at timestamp"
    t0 = datetime(2024, 1, 1)
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    for batch in ([(1, "a", t0), (2, "b", t0)], [(3, "a", t0), (4, "a", t0 + timedelta(1))]):
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(source)
        jobs.write_available(jobs.numbered(jobs.read_table(spark, source, spark.createDataFrame([], kinds).schema)), out, check)
    assert {(r.job_id, r.id, r.sequence_no) for r in spark.read.parquet(out).collect()} == {("a", 1, 1), ("b", 2, 1), ("a", 3, 2), ("a", 4, 3)}


def test_leases_expire(spark, tmp_path):
    kinds = "job_id string, at timestamp, lease_expires_at timestamp"
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    source, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    batches = [[("a", at(0), at(60)), ("b", at(0), at(60)), ("c", at(0), at(60))], [("b", at(50), at(500)), ("c", at(50), None)], [("z", at(200), None)], [("z", at(201), None)]]
    for batch in batches:
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(source)
        jobs.write_available(jobs.expiring_leases(jobs.read_table(spark, source, spark.createDataFrame([], kinds).schema)), out, check)
    assert [r.job_id for r in spark.read.parquet(out).collect()] == ["a"]


@pytest.mark.parametrize("name", ["csv", "json", "md", "txt"])
def test_document_lines_are_the_file(spark, name):
    rows = spark.createDataFrame([(i % 7, f'n{i} "q", | é=\\' if i % 3 else None, i * 1.5) for i in range(40)], "a long, b string, c double")
    rows = rows.withColumn("k", F.monotonically_increasing_id())
    for some in (rows, rows.where("a > 100")):
        fields = ("a", "b", "c", "k")
        want = writers.render(ds.Dataset(some.orderBy("k"), fields, "run-9", 3, ds.Options(), "T"), name).decode().split("\n")
        got = writers.document_lines(ds.Dataset(some.repartition(3), fields, "run-9", 3, ds.Options(), "T"), name, ["k"]).orderBy("n").collect()
        assert [r.n for r in got] == list(range(len(want))) and [r.line for r in got] == want


def test_parts_of_an_export(spark):
    rows = spark.range(25).selectExpr("id as k", "concat('n', id) as name").repartition(4)
    made = ds.Dataset(rows, ("k", "name"), "run-9", 3, ds.Options())
    for name in writers.WRITERS:
        got = writers.render_parts(made, name, ["k"], per_file=10).orderBy("part").collect()
        assert [(r.part, r.records) for r in got] == [(0, 10), (1, 10), (2, 5)]
        for r in got:
            part = ds.Dataset(rows.where(f"k >= {r.part * 10} and k < {r.part * 10 + 10}").orderBy("k"), made.fields, "run-9", 3, ds.Options())
            assert bytes(r.content) == writers.render(part, name) and r.byte_size == len(r.content)


def test_positions(spark):
    from siftline import workspace

    rows = spark.range(1000).selectExpr("id", "id % 10 as x").repartition(7)
    got = workspace.positioned(rows, ["x", "id"]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == sorted(range(1000), key=lambda i: (i % 10, i)) and {r.n for r in got} == set(range(1000))
    assert workspace.positioned(rows.limit(0), ["x"]).collect() == []


def test_follow_stops_at_the_end_of_a_job(spark, tmp_path):
    kinds = "job_id string, sequence_no long, event_type string"
    source, out, check = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    for i, kind in enumerate(["job_queued", "planning_started", "job_completed"]):
        spark.createDataFrame([("j", i, kind)], kinds).coalesce(1).write.mode("append").parquet(source)
    events = jobs.tail(spark, source, spark.createDataFrame([], kinds).schema, cursor=0)
    jobs.follow(events, out, check, F.col("event_type").isin("job_completed", "job_failed", "job_cancelled"))
    assert sorted(r.sequence_no for r in spark.read.parquet(out).collect()) == [1, 2]


def test_captured_page_record(spark):
    from siftline.sources import pages

    rows = [(1, ["http://a/", "http://b/", "http://c/"], 200, "text/html; charset=utf-8", "<TITLE lang=x> A\n  b </TITLE><title>z</title>"), (2, None, None, None, None), (3, ["http://a/"], 404, "text/plain", "<p>")]
    captures = spark.createDataFrame(rows, "page_id long, chain array<string>, status int, content_type string, html string")
    got = {r.page_id: r for r in pages.navigation_record(captures).collect()}
    assert (got[1].requested_url, got[1].final_url, got[1].redirect_count, got[1].title) == ("http://a/", "http://c/", 2, "A b")
    assert (got[2].requested_url, got[2].final_url, got[2].status, got[2].title, got[2].redirect_count) == (None, None, None, None, 0)
    assert (got[3].status, got[3].content_type, got[3].title, got[3].viewport.width) == (404, "text/plain", None, 1440)
