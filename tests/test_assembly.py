import io
import random
import tracemalloc
import zipfile
import zlib
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.operators.dataset import Dataset, Options
from siftline.sinks import assembly, writers

WORDS = ["plain", "=formula", "a|b", "<b>&\"'", "line\nbreak", "(paren)\\", "é😀", "", None, "x" * 130, "  spaced   out  "]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300), st.binary(max_size=300))
def test_crcs_combine_and_fragments_join(a, b, c):
    both = assembly.combined_crc32(zlib.crc32(a), zlib.crc32(b), len(b))
    assert both == zlib.crc32(a + b)
    assert assembly.combined_crc32(both, zlib.crc32(c), len(c)) == zlib.crc32(a + b + c)
    stream = b"".join(map(assembly.deflated, (a, b, c))) + assembly.LAST_FRAGMENT
    assert zlib.decompress(stream, -15) == a + b + c


def dataset(spark, rows, fields=("k", "word", "n", "flag", "list"), **options):
    kinds = {"k": "long", "word": "string", "n": "double", "flag": "boolean", "list": "array<string>"}
    df = spark.createDataFrame([r[: len(fields)] for r in rows], ", ".join(f"{f} {kinds[f]}" for f in fields)).repartition(3)
    return Dataset(df, tuple(fields), "run-1", 3, Options(**options))


def some(n, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(WORDS), rng.choice([None, 0.0, 1.5, float("inf")]), rng.choice([None, True, False]), rng.choice([None, [], ["a", "b"]])) for i in range(n)]


def unpacked(content):
    if content[:2] != b"PK":
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        assert z.testzip() is None
        return [(x.filename, z.read(x)) for x in z.infolist()]


@pytest.mark.parametrize("parallel", [True, False])
@pytest.mark.parametrize("name", sorted(writers.WRITERS))
def test_whole_file_is_what_render_makes(spark, tmp_path, monkeypatch, name, parallel):
    monkeypatch.setattr(assembly, "PART_ROWS", 30)
    monkeypatch.setattr(assembly, "PART_PAGES", 2)
    made = dataset(spark, some(250), include_validation_metadata=True)
    uri = f"file://{tmp_path}/out.{name}"
    size = assembly.assemble(made, name, ["k"], uri, parallel)
    content = (tmp_path / f"out.{name}").read_bytes()
    assert len(content) == size
    want = writers.render(replace(made, rows=made.rows.orderBy("k")), name)
    assert unpacked(content) == unpacked(want)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == [f"out.{name}"]


@pytest.mark.parametrize("name", sorted(writers.WRITERS))
def test_no_rows(spark, tmp_path, name):
    made = dataset(spark, some(3))
    made = replace(made, rows=made.rows.limit(0))
    assembly.assemble(made, name, ["k"], f"file://{tmp_path}/out")
    assert unpacked((tmp_path / "out").read_bytes()) == unpacked(writers.render(made, name))


def test_a_header_longer_than_the_first_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "PART_ROWS", 3)
    monkeypatch.setattr(assembly, "PART_PAGES", 1)
    for n in (10, 4000, 5200):
        rows = spark.range(8).select("id", F.col("id").cast("string").alias("t" * n))
        made = Dataset(rows, tuple(rows.columns), "r", 1, Options())
        assembly.assemble(made, "pdf", ["id"], f"file://{tmp_path}/{n}")
        assert (tmp_path / str(n)).read_bytes() == writers.render(replace(made, rows=rows.orderBy("id")), "pdf")


def test_order_that_is_no_field_and_equal_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(assembly, "PART_ROWS", 7)
    rows = spark.range(100).select((F.col("id") % 2).alias("same"), (100 - F.col("id")).alias("back"), F.col("id").cast("string").alias("name"))
    made = Dataset(rows, ("name",), "r", 1, Options())
    assembly.assemble(made, "csv", ["back"], f"file://{tmp_path}/a")
    assert (tmp_path / "a").read_text().split() == ["name", *(str(i) for i in range(99, -1, -1))]
    assembly.assemble(made, "csv", ["same"], f"file://{tmp_path}/b")
    got = list(map(int, (tmp_path / "b").read_text().split()[1:]))
    assert sorted(got) == list(range(100)) and [i % 2 for i in got] == [0] * 50 + [1] * 50


def test_a_failed_task_leaves_no_file(spark, tmp_path, monkeypatch):
    made = dataset(spark, some(20))
    broken = replace(made, rows=made.rows.withColumn("word", F.when(F.col("k") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("word"))))
    with pytest.raises(Exception, match="no"):
        assembly.assemble(broken, "csv", ["k"], f"file://{tmp_path}/out")
    monkeypatch.setattr(assembly, "_write_places", lambda batches, path: iter(()))
    with pytest.raises(OSError):
        assembly.assemble(made, "csv", ["k"], f"file://{tmp_path}/out")
    assert [p for p in tmp_path.iterdir() if not p.name.startswith(".")] == []


def test_large_members_are_in_64_bits():
    m = assembly.Member("a.xml", 1, 5 << 32, 3 << 32)
    assert assembly.local_header(m)[18:26] == b"\xff" * 8 and len(assembly.local_header(m)) == 30 + 5 + 20
    tail = assembly.directory([(assembly.Member("b", 0, 0, 2), 0), (m, 6 << 32)], 9 << 32)
    assert b"PK\x06\x06" in tail and b"PK\x06\x07" in tail
    archive = io.BytesIO(assembly.local_header(assembly.Member("b", 0, 0, 2)) + assembly.LAST_FRAGMENT)
    at = archive.seek(0, 2)
    archive.write(assembly.directory([(assembly.Member("b", 0, 0, 2), 0)], at))
    assert zipfile.ZipFile(archive).read("b") == b""


def test_many_rows_in_flat_driver_memory(spark, tmp_path):
    rows = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("k"), F.concat(F.lit("value "), F.col("id")).alias("word"))
    made = Dataset(rows, ("k", "word"), "r", 1, Options())
    tracemalloc.start()
    size = assembly.assemble(made, "xlsx", ["k"], f"file://{tmp_path}/out.xlsx")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 2_000_000 and most < 2_000_000
    with open(tmp_path / "out.xlsx", "rb") as f:
        lines = list(assembly.read_lines("xlsx", f))
    assert lines[0] == "k|word" and lines[1:] == [f"{i}|value {i}" for i in range(300_000)]


def test_packed_files_are_read_one_at_a_time(spark, monkeypatch):
    """Many files may come in one batch: their contents are not copied out of it together."""
    import pyarrow as pa

    from siftline.sinks import assembly

    made = {}
    monkeypatch.setattr(assembly, "read_lines", lambda name, stream: [name, stream.read().decode()])

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):
            made["read"] = f
            return self

    class Batch:
        """A batch whose rows can't be had as Python objects all at once."""

        def __init__(self):
            self.of = pa.RecordBatch.from_pydict({"format": ["xlsx", "pdf"], "part": [0, 1], "content": [b"a", b"b"]})

        def column(self, name):
            return self.of.column(name)

    assembly.part_lines(Files())
    rows = [r for b in made["read"](iter([Batch()])) for r in b.to_pylist()]
    assert [(r["format"], r["part"], r["n"], r["line"]) for r in rows] == [("xlsx", 0, 0, "xlsx"), ("xlsx", 0, 1, "a"), ("pdf", 1, 0, "pdf"), ("pdf", 1, 1, "b")]
