"""WARC archives: a JVM-side writer and a PySpark Python data source.

Writing: each record is one string column, written by Spark's text writer with CRLF as the
line separator. It goes through Spark's commit protocol to any file system Spark writes to,
and a lost task leaves nothing half-written.

Reading (`spark.read.format("warc")`): the planner packs files into partitions by size,
takes predicates on record type and header columns from Spark, and hands both to the
tasks. A task parses a record's headers first; a record that the predicates reject, or
whose payload is not asked for, is skipped by seeking over its block without decoding it.
Gzip archives with a member per record are read as well.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from . import shared

#: A payload from this many bytes on is written once; equal ones revisit it.
REVISIT_BYTES = 1000
PARTITION_BYTES = 32 << 20

#: Fixed values of the format: column and the header it comes from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
}
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in HEADERS]
    + [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha1", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(None)
        self.files = files


def _lines(f) -> list[bytes] | None:
    """The header lines of the next record; None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    out = []
    while line not in (b"\r\n", b"\n", b""):
        out.append(line.rstrip(b"\r\n"))
        line = f.readline()
    return out


def _fields(lines: Sequence[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def _skip(f, n: int) -> None:
    if n and f.seekable():
        f.seek(n, io.SEEK_CUR)
        return
    while n > 0 and (got := f.read(min(n, 1 << 20))):
        n -= len(got)


def read_records(f, name: str, wanted: dict[str, list[str] | None], payload: bool, digest: bool) -> Iterator[tuple]:
    """Records of one open archive as rows of SCHEMA; wanted: accepted values by column, None for any but null."""
    while True:
        offset = f.tell()
        lines = _lines(f)
        if lines is None:
            return
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{name}: no record at {offset}")
        head = _fields(lines[1:])
        length = int(head.get("content-length", "0"))
        values = {c: head.get(h.lower()) for c, h in HEADERS.items()}
        if any(values[c] is None or accepted is not None and values[c] not in accepted for c, accepted in wanted.items()):
            _skip(f, length)
            continue
        size, sha1, data = length, None, None
        http = (values["content_type"] or "").startswith("application/http")
        if http:
            start = f.tell()
            inner = _fields(_lines(f) or [])
            body = length - (f.tell() - start)
            size = int(inner.get("content-length", body)) if values["record_type"] == "revisit" else body
            length = body
        if (payload or digest) and values["record_type"] != "revisit":
            data = f.read(length)
            if len(data) != length:
                raise ValueError(f"{name}: record at {offset} is cut short")
            sha1 = hashlib.sha1(data).hexdigest() if digest else None
        else:
            _skip(f, length)
        yield (*values.values(), size, sha1, data if payload else None, name, offset)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files: list[tuple[str, int]] = json.loads(options["files"])
        self.payload = options.get("payload", "true") == "true"
        self.digest = options.get("digest", "true") == "true"
        self.partition_bytes = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.wanted: dict[str, list[str] | None] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality, membership and presence of record type and header columns are decided on headers; the rest stays with Spark."""
        for x in filters:
            if not isinstance(x, (EqualTo, In, IsNotNull)) or len(x.attribute) != 1 or x.attribute[0] not in HEADERS:
                yield x
                continue
            before = self.wanted.get(x.attribute[0])
            if isinstance(x, IsNotNull):
                self.wanted[x.attribute[0]] = before
                continue
            values = [v for v in ([x.value] if isinstance(x, EqualTo) else x.value) if v is not None]
            self.wanted[x.attribute[0]] = values if before is None else [v for v in values if v in before]

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for name, n in sorted(self.files):
            if held and size + n > self.partition_bytes:
                out.append(_Files(held))
                held, size = [], 0
            held.append(name)
            size += n
        return [*out, *([_Files(held)] if held else [])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for name in partition.files:
            system, path = shared.filesystem(name)
            with system.open_input_file(path) as raw:
                f = gzip.open(raw, "rb") if path.endswith(".gz") else io.BufferedReader(raw, 1 << 18)
                for row in read_records(f, name, self.wanted, self.payload, self.digest):
                    rows.append(row)
                    size += len(row[9] or b"")
                    if len(rows) >= 4000 or size >= 16 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "offset": pa.int64(), "payload": pa.binary()}
    arrays = [pa.array(c, kinds.get(f.name, pa.string())) for c, f in zip(zip(*rows), SCHEMA)]
    return pa.RecordBatch.from_arrays(arrays, SCHEMA.names)


class WarcSource(DataSource):
    """Options: files (JSON list of [uri, bytes]), payload, digest ("true"/"false"), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Data files below a folder, through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listFiles(p, True)
    out = []
    while found.hasNext():
        x = found.next()
        if not x.getPath().getName().startswith(("_", ".")):
            out.append((x.getPath().toString(), x.getLen()))
    return out


def read_warc(spark: SparkSession, path: str, payload: bool = True, digest: bool = True) -> DataFrame:
    """Every record of the archives below path (SCHEMA). Filters on header columns are pushed into the reader.

    Without `payload` the payload column is null; without `digest` as well, blocks are
    skipped unread. A header that a record lacks is null, its type included. An empty folder
    gives no rows. Files are the units of work (a record's end is known only from its
    start): one task reads a file, so archives should be of the usual size, about 1 GB.
    """
    shared.ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    reader = spark.read.format("warc").option("files", json.dumps(list_files(spark, path)))
    return reader.option("payload", str(payload).lower()).option("digest", str(digest).lower()).load()


def write_warc(pages: DataFrame, path: str) -> None:
    """One record per row of page_id, url, html: the payload is the html in UTF-8 (null: empty).

    Of rows with equal payloads of at least REVISIT_BYTES bytes the one with the largest
    page_id is a response record and the others are revisit records that refer to it; all
    smaller payloads are responses. Null page_ids come before all others; of repeated rows
    with the largest page_id one is the response. A null url is an empty header. Other
    columns are ignored; an empty table makes no records.
    """
    rows = shared.numbered(shared.pick(pages, "page_id", "url", "html"), "warc-rows").withColumnsRenamed(
        {"_c0": "page_id", "_c1": "url", "_c2": "html", "_rid": "_row"}
    )
    rows = rows.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("_size", F.octet_length("html"))
    payload = F.concat_ws(":", F.sha2("html", 256), "_size").alias("_payload")
    large = shared.materialise(rows.where(F.col("_size") >= REVISIT_BYTES).select("page_id", "_row", payload), "warc-keys")
    first = large.groupBy("_payload").agg(
        F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "_row")).alias("top"), F.count("*").alias("n")
    )
    first = first.where("n > 1").select("_payload", "n", F.col("top.page_id").alias("_of"), F.col("top._row").alias("_keeper"))
    first = shared.materialise(first, "warc-first")
    found = shared.join_skewed(large, first, "_payload").where("_row <> _keeper")
    revisits = found.select("_row", "_of", F.lit(True).alias("_revisit"))
    # As a table its size is known when the join is planned: a small one is broadcast under
    # Spark's own threshold, so payloads aren't shuffled; a large one is a shuffled join.
    revisits = shared.materialise(revisits, "warc-revisits")
    tagged = rows.withColumn("_sha1", F.sha1("html")).join(revisits, "_row", "left")
    record(tagged).write.option("lineSep", "\r\n").text(path)


def record(tagged: DataFrame) -> DataFrame:
    """The text of each record, without the CRLF that the writer adds."""
    kind = F.when(F.col("_revisit"), "revisit").otherwise("response")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit("\r\n\r\n")
    )
    block = F.when(F.col("_revisit"), http).otherwise(F.concat(http, F.col("html")))
    ident = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ")
    refers = F.when(
        F.col("_revisit"),
        F.concat(
            line("WARC-Refers-To", ident(F.col("_of"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", ident(F.col("page_id"))),
        line("WARC-Target-URI", url),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        refers,
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n"),
    )
    return tagged.select(text.alias("value"))


def page_id(column: str):
    return F.try_element_at(F.split(F.regexp_replace(F.col(column), "[<>]", ""), ":"), F.lit(3)).try_cast("long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    One row per page: page_id, payload_bytes, payload_digest (hex SHA-1), record_type,
    refers_to. Two reads, each with its record type pushed into the reader: responses with
    size and digest of the payload bytes read, revisits, which carry those of the full
    payload in their headers, without a look at any block. Cases are as for write_warc.
    """
    spark = pages.sparkSession
    path = shared.work_path(spark, "warc")
    write_warc(pages, path)
    responses = read_warc(spark, path, payload=False).where(F.col("record_type") == "response")
    revisits = read_warc(spark, path, payload=False, digest=False).where(F.col("record_type") == "revisit")
    declared = F.regexp_replace("payload_digest", "^sha1:", "")
    return responses.unionByName(revisits).select(
        page_id("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce("payload_sha1", declared).alias("payload_digest"),
        "record_type",
        page_id("refers_to").alias("refers_to"),
    )
