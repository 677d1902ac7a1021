"""Artifacts as a sink of Spark: the write side of a Python data source.

    spark.dataSource.register(ArtifactSink)
    df.select("name", "content").write.format("artifacts").mode("append").option("max_bytes", n).save(uri)

Each task writes its rows' contents as files with opaque keys into a folder of its attempt,
with a list of name, key, size and SHA-256. Nothing counts before the job commits: then one
manifest names the attempts that did it, and what other attempts have left is removed. A task
that fails removes its own folder, a job that fails all of them. No file is moved, so any
store will do. The driver holds a line for each task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql import functions as F

from siftline import workspace
from siftline.deploy import ship

ENTRIES, MANIFESTS = "entries.json", "manifests"
#: Largest artifact, unless the option max_bytes says otherwise.
MAX_BYTES = 25_165_824


class ArtifactTooLarge(ValueError):
    code = "EXPORT_TOO_LARGE"


@dataclass
class Written(WriterCommitMessage):
    """What one task has done: its folder, and how many artifacts and bytes are there."""

    folder: str
    artifacts: int
    byte_size: int


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, max_bytes: int):
        self.uri, self.max_bytes, self.job = uri.rstrip("/"), max_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = f"{self.job}/{uuid.uuid4().hex}"
        system, path = workspace.filesystem(f"{self.uri}/{folder}")
        system.create_dir(path, recursive=True)
        done, size = 0, 0
        try:
            with system.open_output_stream(f"{path}/{ENTRIES}") as entries:
                for batch in iterator:
                    for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                        content = content.as_py() or b""
                        if len(content) > self.max_bytes:
                            raise ArtifactTooLarge(f"{name!r} has more than {self.max_bytes} bytes")
                        key = uuid.uuid4().hex
                        with system.open_output_stream(f"{path}/{key}") as out:
                            out.write(content)
                        entry = {"name": name, "key": f"{folder}/{key}", "byte_size": len(content), "checksum": "sha256:" + hashlib.sha256(content).hexdigest()}
                        entries.write(json.dumps(entry).encode() + b"\n")
                        done, size = done + 1, size + len(content)
        except BaseException:
            system.delete_dir(path)
            raise
        return Written(folder, done, size)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        system, path = workspace.filesystem(self.uri)
        self._sweep({m.folder.split("/")[1] for m in done})
        lines = [json.dumps({"folder": m.folder, "artifacts": m.artifacts, "byte_size": m.byte_size}) + "\n" for m in done]
        system.create_dir(f"{path}/{MANIFESTS}", recursive=True)
        with system.open_output_stream(f"{path}/{MANIFESTS}/{self.job}.json") as out:
            out.write("".join(lines).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(set())

    def _sweep(self, kept: set[str]) -> None:
        """Remove the job's attempts but for some; with none left its folder too."""
        from pyarrow import fs

        system, path = workspace.filesystem(f"{self.uri}/{self.job}")
        if system.get_file_info(path).type == fs.FileType.NotFound:
            return
        for x in system.get_file_info(fs.FileSelector(path)):
            if x.base_name not in kept:
                system.delete_dir(x.path)
        if not kept:
            system.delete_dir(path)


class ArtifactSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifacts"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        if overwrite:
            raise ValueError("artifacts are only appended")
        return ArtifactWriter(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)))


def store(files: DataFrame, uri: str, max_bytes: int = MAX_BYTES) -> None:
    """Write the rows (name, content) of files as artifacts below a URI that driver and executors share."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(ArtifactSink)
    files.select("name", "content").write.format(ArtifactSink.name()).mode("append").option("max_bytes", max_bytes).save(uri)


def stored(spark: SparkSession, uri: str) -> DataFrame:
    """name, key, byte_size, checksum of all committed artifacts below a URI."""
    manifests = spark.read.schema("folder string").json(f"{uri}/{MANIFESTS}")
    entries = spark.read.schema("name string, key string, byte_size long, checksum string").json(f"{uri}/*/*/{ENTRIES}")
    of = F.substring_index(F.col("key"), "/", 2)
    return entries.join(manifests, of == manifests["folder"], "left_semi")


def unreadable(spark: SparkSession, uri: str) -> DataFrame:
    """The committed artifacts whose bytes aren't those of their checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = workspace.filesystem(uri)
        for batch in batches:
            bad = []
            for r in batch.to_pylist():
                digest = hashlib.sha256()
                with system.open_input_stream(f"{path}/{r['key']}") as stream:
                    while chunk := stream.read(1 << 16):
                        digest.update(chunk)
                bad.append("sha256:" + digest.hexdigest() != r["checksum"])
            yield batch.filter(pa.array(bad, pa.bool_()))

    rows = stored(spark, uri)
    return rows.mapInArrow(read, rows.schema)
