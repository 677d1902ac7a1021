"""One whole file of any format from parts that are made in parallel, without render's limit.

The rows are numbered once and dealt into parts of PART_ROWS. Each part becomes the bytes of
its rows where they are; a part of a zip member is a deflate fragment that ends at a byte,
with the CRC-32 and size of what it unpacks to. From the small table of parts come the
places of all bytes (prefix sums), the member's CRC-32 (combined algebraically) and what
frames the rows: directory, column widths, counts. PDF rows are dealt again by page, as a
page's lines depend on all rows before it, and the cross-reference table is made part by
part from the places.

The parts are a table in the work folder. On a file system with places (file:) tasks write
them into the file in parallel; elsewhere one task streams them in order, holding one at a
time. The file gets its name when it is complete; a failed attempt leaves none.
"""

from __future__ import annotations

import html
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import replace
from functools import partial, reduce
from itertools import groupby, islice
from typing import Any, BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline import workspace
from siftline.deploy import ship
from siftline.operators.dataset import Dataset
from siftline.sinks import writers

PART_ROWS = 10_000
#: Pages of a PDF in a part.
PART_PAGES = 100
BATCH_BYTES = 32 << 20

_MARK = "\x00rows\x00"
_POLYNOMIAL = 0xEDB88320


# ---------------------------------------------------------------- checksums


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo CRC-32's, lowest power in the highest bit."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def combined_crc32(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings one after the other, from those of each and the length of the second."""
    shift, square = 1 << 31, 1 << 23  # one, and x^8
    while second_bytes:
        if second_bytes & 1:
            shift = _times(shift, square)
        square = _times(square, square)
        second_bytes >>= 1
    return _times(shift, first) ^ second


def deflated(raw: bytes) -> bytes:
    """A fragment of a deflate stream: it ends at a byte and refers to nothing before it. LAST_FRAGMENT ends the stream."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_SYNC_FLUSH)


LAST_FRAGMENT = b"\x03\x00"


# ---------------------------------------------------------------- zip


class Member(NamedTuple):
    """A member of an archive: its name, what it unpacks to, and the size of its deflate stream."""

    name: str
    crc: int
    raw_bytes: int
    packed_bytes: int


_FULL = 0xFFFFFFFF


def _extra(*values: int) -> bytes:
    """The 64-bit forms of those values that don't fit 32 bits."""
    wide = b"".join(struct.pack("<Q", v) for v in values if v >= _FULL)
    return struct.pack("<HH", 1, len(wide)) + wide if wide else b""


def local_header(m: Member) -> bytes:
    # A local header holds both sizes in 64 bits if one of them needs it.
    wide = max(m.raw_bytes, m.packed_bytes) >= _FULL
    extra = struct.pack("<HHQQ", 1, 16, m.raw_bytes, m.packed_bytes) if wide else b""
    sizes = (_FULL, _FULL) if wide else (m.packed_bytes, m.raw_bytes)
    name = m.name.encode()
    return struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 8, 0, 0x21, m.crc, *sizes, len(name), len(extra)) + name + extra


def directory(members: list[tuple[Member, int]], at: int) -> bytes:
    """The central directory, which begins at a place, of members and where their local headers begin."""
    out = b""
    for m, start in members:
        extra, name = _extra(m.raw_bytes, m.packed_bytes, start), m.name.encode()
        small = [min(v, _FULL) for v in (m.packed_bytes, m.raw_bytes)]
        out += struct.pack(
            "<IHHHHHHIIIHHHHHII", 0x02014B50, 45 if extra else 20, 45 if extra else 20, 0x800, 8, 0, 0x21, m.crc, *small, len(name), len(extra), 0, 0, 0, 0, min(start, _FULL)
        ) + name + extra
    end = at + len(out)
    tail = b""
    if end >= _FULL or len(members) >= 0xFFFF:
        tail = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(out), at) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    count = min(len(members), 0xFFFF)
    return out + tail + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, min(len(out), _FULL), min(at, _FULL), 0)


# ---------------------------------------------------------------- parts


def _row_bytes(dataset: Dataset, name: str, first: int, rows: list[dict[str, Any]]) -> bytes:
    """Rows as they stand in the file, the first of them number `first`."""
    fields = dataset.fields
    if name == "json":
        texts = (json.dumps(r, ensure_ascii=False, indent=2, default=str).replace("\n", "\n    ") for r in rows)
        return "".join(("" if first + i == 0 else ",") + "\n    " + t for i, t in enumerate(texts)).encode()
    line = {
        "csv": lambda i, r: writers.csv_line(dataset, r) + "\n",
        "md": lambda i, r: "\n" + writers.markdown_line(dataset, r),
        "txt": lambda i, r: "\n" + writers.markdown_line(dataset, r).replace("|", " "),
        "html": lambda i, r: writers.html_line(dataset, r),
        "xlsx": lambda i, r: writers.sheet_row(i + 2, [writers.guarded(r[f]) for f in fields]),
        "docx": lambda i, r: writers.word_row([writers.shown(r[f]) for f in fields]),
    }[name]
    return "".join(line(first + i, r) for i, r in enumerate(rows)).encode()


_PARTS = "part long, records long, size long, raw_size long, crc long, widths array<long>, content binary"


def _part(key, table: pa.Table, dataset: Dataset, name: str, packed: bool) -> pa.Table:
    rows = table.sort_by("_n").drop(["_part"])
    first = rows["_n"][0].as_py()
    records = rows.drop(["_n"]).to_pylist()
    raw = _row_bytes(dataset, name, first, records)
    content = deflated(raw) if packed else raw
    widths = [max(len(str(writers.guarded(r[f]) or "")) for r in records) for f in dataset.fields]
    columns = [[key[0].as_py()], [len(records)], [len(content)], [len(raw)], [zlib.crc32(raw)], pa.array([widths], pa.list_(pa.int64())), [content]]
    return pa.table(dict(zip(("part", "records", "size", "raw_size", "crc", "widths", "content"), columns)))


class _Piece(NamedTuple):
    """A stretch of the file: bytes of its own, or those of a part."""

    size: int
    content: bytes | None = None
    part: int | None = None


def _own(content: bytes) -> _Piece:
    return _Piece(len(content), content)


def _zip_pieces(files: dict[str, str], sized: list, crc: int, raw: int, packed: int) -> list[_Piece]:
    """The pieces of an archive whose member with _MARK holds the parts there."""
    pieces, members, at = [], [], 0
    for name, text in files.items():
        whole = (writers.XML_HEAD + text).encode()
        if _MARK in text:
            head, tail = whole.split(_MARK.encode())
            for own, is_tail in ((head, False), (tail, True)):
                crc = combined_crc32(crc, zlib.crc32(own), len(own)) if is_tail else combined_crc32(zlib.crc32(own), crc, raw)
            front, back = deflated(head), deflated(tail) + LAST_FRAGMENT
            member = Member(name, crc, raw + len(head) + len(tail), packed + len(front) + len(back))
            added = [_own(front), *(_Piece(r["size"], part=r["part"]) for r in sized), _own(back)]
        else:
            stream = deflated(whole) + LAST_FRAGMENT
            member, added = Member(name, zlib.crc32(whole), len(whole), len(stream)), [_own(stream)]
        header = local_header(member)
        members.append((member, at))
        pieces += [_own(header), *added]
        at += len(header) + member.packed_bytes
    return [*pieces, _own(directory(members, at))]


def _framed(dataset: Dataset, name: str, total: int, widths: list[int]) -> str | dict[str, str]:
    """The file around its rows, which stand at _MARK; of an archive, its files."""
    if name == "xlsx":
        return writers.sheet_files(dataset, total, widths, _MARK)
    if name == "docx":
        return writers.word_files(dataset, total, _MARK)
    if name == "html":
        return writers.html_page(dataset, total, _MARK)
    if name == "csv":
        return writers.csv_head(dataset) + "\n" + _MARK
    if name == "json":
        return writers.json_frame(dataset, total, _MARK)
    page = writers.markdown_page(dataset, total, _MARK)
    return page if name == "md" else "\n".join(map(writers.without_marks, page.split("\n")))


# ---------------------------------------------------------------- PDF


_PAGES = "part long, size long, lengths array<long>, content binary"


def _pdf_lines(batches: Iterator[pa.RecordBatch], layout: writers.PdfLayout, dataset: Dataset) -> Iterator[pa.RecordBatch]:
    """Each row's number and how many lines it takes on paper."""
    for batch in batches:
        counts = [len(layout.wrapped([writers.shown(r[f]) for f in dataset.fields])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "_lines"])


def _pdf_part(key, table: pa.Table, layout: writers.PdfLayout, dataset: Dataset, total: int, per_part: int) -> pa.Table:
    """The page objects of one part: rows (each with its first line's number) that have lines on its pages."""
    part, pages = key[0].as_py(), {}
    for r in table.sort_by("_n").to_pylist():
        for i, cells in enumerate(layout.wrapped([writers.shown(r[f]) for f in dataset.fields])):
            page, place = layout.place(r["_line"] + i)
            if page // per_part == part:
                pages.setdefault(page, []).append((place, cells))
    if part == 0:
        pages.setdefault(0, [])
    objects = [x for p in sorted(pages) for x in layout.page(p, pages[p], dataset, total)]
    content = b"".join(objects)
    return pa.table({"part": [part], "size": [len(content)], "lengths": pa.array([list(map(len, objects))], pa.list_(pa.int64())), "content": [content]})


def _cross_references(batches: Iterator[pa.RecordBatch], offsets: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts, contents = [], []
        for r in batch.to_pylist():
            at, lines = offsets[r["part"]], []
            for n in r["lengths"]:
                lines.append(b"%010d 00000 n \n" % at)
                at += n
            parts.append(r["part"])
            contents.append(b"".join(lines))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(contents, pa.binary())], ["part", "content"])


def _pdf(dataset: Dataset, rows: DataFrame, total: int) -> tuple[DataFrame, list[_Piece]]:
    layout = writers.PdfLayout.of(dataset)
    lined = workspace.materialise(rows.mapInArrow(partial(_pdf_lines, layout=layout, dataset=replace(dataset, rows=None)), _with(rows, "_lines long")), "pdf-rows")
    chunk = F.floor(F.col("_n") / PART_ROWS)
    before, base = 0, []
    for r in lined.groupBy(chunk.alias("chunk")).agg(F.sum("_lines").alias("lines")).orderBy("chunk").collect():
        base.append((r["chunk"], before))
        before += r["lines"]
    starts = F.broadcast(rows.sparkSession.createDataFrame(base, "_chunk long, _before long"))
    window = Window.partitionBy("_chunk").orderBy("_n")
    placed = lined.withColumn("_chunk", chunk).join(starts, "_chunk").withColumn("_line", F.col("_before") + F.sum("_lines").over(window) - F.col("_lines"))
    first, last = (layout.page_column(F.col("_line") + x) for x in (F.lit(0), F.col("_lines") - 1))
    first = F.when(F.col("_line") == 0, 0).otherwise(first)  # the first page is there, lines on it or not
    dealt = placed.withColumn("_part", F.explode(F.sequence(F.floor(first / PART_PAGES), F.floor(last / PART_PAGES))))
    bare, per_part = replace(dataset, rows=None), PART_PAGES
    make = lambda key, table: _pdf_part(key, table, layout, bare, total, per_part)
    parts = workspace.materialise(dealt.groupBy("_part").applyInArrow(make, _PAGES), "pdf-parts")
    pages = layout.place(before - 1)[0] + 1
    head = layout.head(pages)
    sized = parts.select("part", "size").orderBy("part").collect()
    offsets, at = {}, sum(map(len, head))
    for r in sized:
        offsets[r["part"]] = at
        at += r["size"]
    table = parts.select("part", "lengths").mapInArrow(partial(_cross_references, offsets=offsets), "part long, content binary")
    both = parts.select((F.col("part") * 2).alias("part"), "content").unionByName(table.select((F.col("part") * 2 + 1).alias("part"), "content"))
    entries = lambda part: 40 * min(PART_PAGES, pages - part * PART_PAGES)
    start, own = len(head[0]), []
    for x in head[1:]:
        own.append(b"%010d 00000 n \n" % start)
        start += len(x)
    count = 4 + 2 * pages
    pieces = [_own(b"".join(head)), *(_Piece(r["size"], part=2 * r["part"]) for r in sized)]
    pieces += [_own(b"xref\n0 %d\n0000000000 65535 f \n%s" % (count, b"".join(own))), *(_Piece(entries(r["part"]), part=2 * r["part"] + 1) for r in sized)]
    return both, [*pieces, _own(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (count, at))]


def _with(df: DataFrame, column: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), column])


# ---------------------------------------------------------------- the file


def _write_places(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    written = 0
    for batch in batches:
        for r in batch.to_pylist():
            with open(path, "r+b") as out:
                out.seek(r["place"])
                out.write(r["content"])
            written += len(r["content"])
    yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])


def _write_stream(batches: Iterator[pa.RecordBatch], uri: str, own: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
    """All pieces in order; `own` are those before each part, and last the end."""
    system, path = workspace.filesystem(uri)
    written = 0
    with system.open_output_stream(path) as out:
        for r in (r for batch in batches for r in batch.to_pylist()):
            out.write(own.get(r["place"], b"") + r["content"])
            written += len(r["content"])
        out.write(own.get(-1, b""))
    yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["written"])


def _stitched(pieces: list[_Piece], parts: DataFrame, uri: str, parallel: bool | None = None) -> int:
    """Write the pieces as one file; its size."""
    spark = parts.sparkSession
    places, own, at = [], [], 0
    for x in pieces:
        (own if x.part is None else places).append((at, x))
        at += x.size
    where = F.broadcast(spark.createDataFrame([(x.part, place) for place, x in places], "part long, place long"))
    placed = parts.join(where, "part").select("place", "content")
    local = uri.startswith("file:") or "://" not in uri
    target = uri + "." + uuid.uuid4().hex
    if local if parallel is None else parallel:
        path = "/" + target.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with open(path, "wb") as out:
                out.truncate(at)
                for place, x in own:
                    out.seek(place)
                    out.write(x.content)
            written = placed.mapInArrow(partial(_write_places, path=path), "written long").agg(F.sum("written")).first()[0] if places else 0
            if (written or 0) + sum(x.size for _, x in own) != at:
                raise OSError("parts are missing")
            os.replace(path, "/" + uri.removeprefix("file:").lstrip("/"))
        except BaseException:
            if os.path.exists(path):
                os.remove(path)
            raise
        return at
    before: dict[int, bytes] = {}
    starts = [place for place, _ in places]
    for place, x in own:
        key = next((s for s in starts if s > place), -1)
        before[key] = before.get(key, b"") + x.content
    one = placed.repartition(1).sortWithinPartitions("place").mapInArrow(partial(_write_stream, uri=uri, own=before), "written long")
    if not places:
        system, path = workspace.filesystem(uri)
        with system.open_output_stream(path) as out:
            out.write(before[-1])
    elif one.first()["written"] + sum(x.size for _, x in own) != at:
        raise OSError("parts are missing")
    return at


def assemble(dataset: Dataset, name: str, order: list[str], uri: str, parallel: bool | None = None) -> int:
    """Write the whole dataset as one file that unpacks to what render would make; the size of the file.

    `order` are the columns whose order the records come in; equal rows have none of their
    own. `uri` is on a file system that driver and executors share. Nothing that grows with
    the rows is held: a task holds a part, the driver the sizes of the parts (and of a PDF ten
    bytes for each page).
    """
    writers.writer_for(name)
    spark = dataset.rows.sparkSession
    ship(spark)
    blank = replace(dataset, rows=None)
    # A batch holds the bytes of some parts.
    with workspace.temporary(spark), workspace.session_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH_BYTES)):
        rows = workspace.positioned(dataset.rows.select(*dataset.fields, *[c for c in order if c not in dataset.fields]), order, "_n")
        rows = rows.select("_n", *dataset.fields)
        total = rows.count()
        if not total:
            return _stitched([_own(writers.writer_for(name)(blank, []))], spark.createDataFrame([], "part long, content binary"), uri, parallel)
        if name == "pdf":
            parts, pieces = _pdf(dataset, rows, total)
            return _stitched(pieces, parts, uri, parallel)
        packed = name in ("xlsx", "docx")
        make = lambda key, table: _part(key, table, blank, name, packed)
        parts = rows.withColumn("_part", F.floor(F.col("_n") / PART_ROWS)).groupBy("_part").applyInArrow(make, _PARTS)
        parts = workspace.materialise(parts, "file-parts")
        sized = parts.drop("content").orderBy("part").collect()
        widths = [max(r["widths"][i] for r in sized) for i in range(len(dataset.fields))]
        frame = _framed(blank, name, total, widths)
        if packed:
            crc, raw = reduce(lambda a, r: (combined_crc32(a[0], r["crc"], r["raw_size"]), a[1] + r["raw_size"]), sized, (0, 0))
            pieces = _zip_pieces(frame, sized, crc, raw, sum(r["size"] for r in sized))
        else:
            head, tail = frame.split(_MARK)
            pieces = [_own(head.encode()), *(_Piece(r["size"], part=r["part"]) for r in sized), _own(tail.encode())]
        return _stitched(pieces, parts.select("part", "content"), uri, parallel)


# ---------------------------------------------------------------- reading back

#: What ends a row, and what holds a cell.
_READ = {
    "html": (b"</tr>", re.compile(r"<t[hd]>(.*?)</t[hd]>", re.S)),
    "xlsx": (b"</row>", re.compile(r"<c [^>]*>(?:<is><t [^>]*>|<v>)(.*?)</", re.S)),
    "docx": (b"</w:tr>", re.compile(r"<w:tc>.*?<w:t [^>]*>(.*?)</w:t>", re.S)),
    "pdf": (b"ET\n", re.compile(r" Tf [0-9.]+ ([0-9.]+) Td \((.*)\) Tj ", re.S)),
}
_MEMBER = {"xlsx": "xl/worksheets/sheet1.xml", "docx": "word/document.xml"}


def _ended(stream: BinaryIO, end: bytes) -> Iterator[str]:
    """The pieces of a stream that an end mark closes, one chunk of it held at a time."""
    held = b""
    while chunk := stream.read(1 << 20):
        *whole, held = (held + chunk).split(end)
        yield from (x.decode("cp1252" if end == b"ET\n" else "utf-8") for x in whole)


def read_lines(name: str, stream: BinaryIO) -> Iterator[str]:
    """The rows of an html, xlsx, docx or pdf file as made here, cells joined by bars; of a PDF all lines of all pages."""
    end, cell = _READ[name]
    if name in _MEMBER:
        with zipfile.ZipFile(stream) as archive, archive.open(_MEMBER[name]) as member:
            yield from ("|".join(map(html.unescape, cell.findall(x))) for x in _ended(member, end))
    elif name == "html":
        yield from ("|".join(map(html.unescape, cell.findall(x))) for x in _ended(stream, end))
    else:
        drawn = (m.groups() for x in _ended(stream, end) if (m := cell.search(x)))
        for _, line in groupby(drawn, key=lambda x: x[0]):
            yield "|".join(re.sub(r"\\(.)", r"\1", text) for _, text in line)


def file_lines(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """format, n, line of some files (URI by format), read in a task for each."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            system, path = workspace.filesystem(r["uri"])
            with system.open_input_file(path) as stream:
                lines = enumerate(read_lines(r["format"], stream))
                while some := list(islice(lines, 10_000)):
                    n, text = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([r["format"]] * len(n)), pa.array(n, pa.int64()), pa.array(text)], ["format", "n", "line"])

    rows = spark.createDataFrame(list(files.items()), "format string, uri string").repartition(len(files), "format")
    return rows.mapInArrow(read, "format string, n long, line string")


def part_lines(files: DataFrame) -> DataFrame:
    """format, part, n, line of the files of render_parts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One file's content and lines at a time, whatever the number of files in a batch.
        for name, part, content in (x for batch in batches for x in zip(*(batch.column(c) for c in ("format", "part", "content")))):
            lines = list(read_lines(name.as_py(), pa.BufferReader(content.as_buffer())))
            columns = [[name.as_py()] * len(lines), [part.as_py()] * len(lines), list(range(len(lines))), lines]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["format", "part", "n", "line"])

    return files.select("format", "part", "content").mapInArrow(read, "format string, part long, n long, line string")
