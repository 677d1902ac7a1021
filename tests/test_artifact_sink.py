import hashlib

import pytest
from pyspark.sql import functions as F

from siftline.sinks import artifact_sink as a


def files(tmp_path):
    return sorted(p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_what_is_stored_is_read_back(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 7 > 0, F.repeat(F.col("id").cast("string"), 9)).cast("binary").alias("content")).repartition(3)
    uri = f"file://{tmp_path}"
    a.store(rows, uri)
    a.store(rows.limit(1), uri)
    got = sorted((r["name"], r.byte_size, r.checksum) for r in a.stored(spark, uri).collect())
    want = [(r["name"], len(r.content or b""), "sha256:" + hashlib.sha256(r.content or b"").hexdigest()) for r in rows.collect()]
    assert len(got) == 41 and sorted(set(got)) == sorted(want)
    assert a.unreadable(spark, uri).collect() == []
    key = a.stored(spark, uri).where("byte_size > 0").first().key
    (tmp_path / key).write_bytes(b"other")
    assert [r.key for r in a.unreadable(spark, uri).collect()] == [key]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").cast("string").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content")).repartition(4)
    a.store(rows.where("id < 10"), f"file://{tmp_path}", max_bytes=20)
    before = files(tmp_path)
    with pytest.raises(Exception, match="more than 20 bytes"):
        a.store(rows, f"file://{tmp_path}", max_bytes=20)
    assert files(tmp_path) == before and a.stored(spark, f"file://{tmp_path}").count() == 10


def test_attempts_that_the_commit_does_not_name_are_removed(tmp_path):
    import pyarrow as pa

    writer = a.ArtifactWriter(f"file://{tmp_path}", 100)
    batch = pa.record_batch({"name": ["x"], "content": [b"y"]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, None])
    assert {p.parent.name for p in files(tmp_path)} == {kept.folder.split("/")[1], a.MANIFESTS} and lost.folder != kept.folder
    other = a.ArtifactWriter(f"file://{tmp_path}", 100)
    other.write(iter([batch]))
    other.abort([None])
    assert not (tmp_path / other.job).exists()
