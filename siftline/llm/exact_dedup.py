"""Exact dedup with Patricia-trie owners.

Each map task folds its own copies first: over a bounded window of rows it keeps one
representative per distinct normalised text with a count and the smallest identifier, so a
text held by a third of all rows is shuffled once per window, not once per row. The
representatives are dealt by (byte length, content hash); the owner of a partition inserts
the full byte strings into a compressed radix trie whose terminal nodes hold the smallest
identifier. A text that over HOT_REPS windows hold goes through a tree of owners: parts of
about HOT_REPS representatives each return one, and only those meet. Equality is decided by
the bytes alone; the hash only deals. A trie that grows over its budget spills whole
subtrees to unnamed files of the task, which are gone with it however it ends, and works
them off one by one. The owners return one small row per representative, which is joined back.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import tempfile
from collections.abc import Iterator
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Bytes of rows that a map task folds at once, and bytes that an owner's trie holds.
WINDOW_BYTES = 32 << 20
TRIE_BYTES = 64 << 20
#: What a node of a trie takes beside its label and the values of its entry, roughly.
NODE_BYTES = 500
#: Representatives of one text that an owner takes from the windows themselves; texts with more are at most HOT_TEXTS.
HOT_REPS, HOT_TEXTS = 1000, 1_000_000

#: Every run of white space that is not already one plain space.
_RUNS = re.compile(rb"[\x09-\x0d][\x20\x09-\x0d]*|\x20[\x20\x09-\x0d]+")


def normalise(text: str | None) -> bytes:
    """UTF-8 of text with each run of ASCII white space replaced by one space; None is empty."""
    return _RUNS.sub(b" ", text.encode("utf-8", "surrogatepass")) if text else b""


class _Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry=None):
        self.label, self.children, self.entry = label, {}, entry


def _shared_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to merged entries, in bounded memory.

    `merge(old, new)` folds two entries of one string, `weigh(entry)` are the bytes of its
    values. When nodes, labels and entries exceed `budget` bytes, the root's largest subtree
    goes to a file, and later strings below it follow; a spilled subtree is read again as a
    trie of its own when the items are listed.
    """

    def __init__(self, merge, budget: int = TRIE_BYTES, folder: str | None = None, weigh=None):
        self.merge, self.budget, self.folder, self.weigh = merge, budget, folder, weigh or (lambda _: 0)
        self.root, self.held = _Node(b""), 0
        self.spilled: dict[int, BinaryIO] = {}

    def insert(self, key: bytes, entry) -> None:
        if key and key[0] in self.spilled:
            self._append(key[0], [(key, entry)])
            return
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.entry = entry if node.entry is None else self.merge(node.entry, entry)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], entry)
                self.held += len(key) - at + NODE_BYTES + self.weigh(entry)
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = _shared_length(child.label, key[at : at + len(child.label)])
            middle = _Node(child.label[:n])
            child.label = child.label[n:]
            middle.children[child.label[0]] = child
            node.children[middle.label[0]] = middle
            self.held += NODE_BYTES
            node, at = middle, at + n
        while self.held > self.budget and len(self.root.children) > 0:
            self._spill()

    def _spill(self) -> None:
        sizes = {b: self._size(c) for b, c in self.root.children.items()}
        first = max(sizes, key=sizes.get)
        child = self.root.children.pop(first)
        self.spilled[first] = tempfile.TemporaryFile(prefix="subtree-", dir=self.folder)
        self._append(first, self._walk(child, b""))
        self.held -= sizes[first]

    def _append(self, first: int, items) -> None:
        for item in items:
            pickle.dump(item, self.spilled[first])

    def _size(self, node: _Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE_BYTES + (self.weigh(x.entry) if x.entry is not None else 0)
            todo += x.children.values()
        return total

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        todo = [(node, prefix)]
        while todo:
            x, before = todo.pop()
            key = before + x.label
            if x.entry is not None:
                yield key, x.entry
            todo += [(c, key) for c in x.children.values()]

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every (string, entry), in no order; ends the trie."""
        yield from self._walk(self.root, b"")
        self.root = _Node(b"")
        while self.spilled:
            with self.spilled.popitem()[1] as file:
                yield from self._reread(file)

    def _reread(self, file: BinaryIO) -> Iterator[tuple[bytes, object]]:
        """A spilled subtree, read as a trie without the prefix that all its strings share."""
        prefix = None
        for key, _ in self._load(file):
            prefix = key if prefix is None else prefix[: _shared_length(prefix, key)]
        below = PatriciaTrie(self.merge, self.budget, self.folder, self.weigh)
        for key, entry in self._load(file):
            below.insert(key[len(prefix) :], entry)
        for rest, entry in below.items():
            yield prefix + rest, entry

    @staticmethod
    def _load(file: BinaryIO) -> Iterator[tuple[bytes, object]]:
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


# ---------------------------------------------------------------- map side


def _order(doc_id, row) -> tuple:
    return (doc_id is None, doc_id or 0, row)


def _windows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _fold(batches: Iterator[pa.RecordBatch], limit: int, report: bool) -> Iterator[pa.RecordBatch]:
    """Representatives (with their whole row) and, with `report`, for every row which representative it has."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for table in _windows(batches, limit):
        ids, texts = table.column(0).to_pylist(), table.column(1)
        best: dict[bytes, list] = {}
        of = []
        for i, text in enumerate(texts):
            key = hashlib.sha256(norm := normalise(text.as_py())).digest() + len(norm).to_bytes(8, "big")
            if (e := best.get(key)) is None:
                best[key] = [i, 1, norm]
            elif norm == e[2]:
                if _order(ids[i], i) < _order(ids[e[0]], e[0]):
                    e[0] = i
                e[1] += 1
            else:  # a hash collision: left to the owner's trie
                best[key + i.to_bytes(8, "big")] = [i, 1, norm]
                key += i.to_bytes(8, "big")
            of.append(key)
        n = len(ids)
        kept = list(best)
        yield _rows(
            table.take(pa.array([best[k][0] for k in kept], pa.int64())),
            [row + best[k][0] for k in kept],
            [row + best[k][0] for k in kept],
            [best[k][1] for k in kept],
            [int.from_bytes(k[32:40], "big") for k in kept],
            [int.from_bytes(k[:8], "little", signed=True) for k in kept],
        )
        if report:
            empty = [table.column(0)] + [pa.nulls(n, c.type) for c in table.columns[1:]]
            yield _rows(
                pa.Table.from_arrays(empty, names=table.column_names),
                list(range(row, row + n)),
                [row + best[k][0] for k in of],
                [0] * n,
                [None] * n,
                [None] * n,
            )
        row += n


def _rows(table: pa.Table, rid, rep, count, length, content) -> pa.RecordBatch:
    extra = [pa.array(x, pa.int64()) for x in (rid, rep, count, length, content)]
    columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    return pa.RecordBatch.from_arrays([*columns, *extra], [*table.column_names, *_OWN])


_OWN = ["_rid", "_rep", "_count", "_length", "_content"]


# ---------------------------------------------------------------- owners


def _merge(a: list, b: list) -> list:
    """Entries are [doc_id, row, rows, representatives]; the smaller identifier stays."""
    low = a if _order(a[0], a[1]) <= _order(b[0], b[1]) else b
    more, fewer = (a[3], b[3]) if len(a[3]) >= len(b[3]) else (b[3], a[3])
    more += fewer
    return [low[0], low[1], a[2] + b[2], more]


_OWNED = T.StructType(
    [
        T.StructField("_rep", T.LongType()),
        T.StructField("keep_id", T.LongType()),
        T.StructField("_keep_rid", T.LongType()),
        T.StructField("group_size", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
    ]
)


def _owner(batches: Iterator[pa.RecordBatch], budget: int) -> PatriciaTrie:
    """A trie of rows (doc_id, text, rep, count)."""
    trie = PatriciaTrie(_merge, budget)
    for batch in batches:
        for doc_id, text, rep, count in zip(
            batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        ):
            trie.insert(normalise(text.as_py()), [doc_id, rep, count, [rep]])
    return trie


_PART = T.StructType(
    [
        T.StructField("_c0", T.LongType()),
        T.StructField("_c1", T.StringType()),
        T.StructField("_rep", T.LongType()),
        T.StructField("_count", T.LongType()),
        T.StructField("_of", T.LongType()),
    ]
)


def _own_part(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One representative per text, and for every representative that came in which one that is (_of)."""
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    for key, (doc_id, row, count, reps) in _owner(batches, budget).items():
        rows = [(doc_id, key.decode("utf-8", "surrogatepass"), row, count, None), *((None, None, rep, 0, row) for rep in reps)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _PART.names)


def _own(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for key, (doc_id, row, count, reps) in _owner(batches, budget).items():
        digest = hashlib.sha256(key).hexdigest()
        out += [(rep, doc_id, row, count, digest) for rep in reps]
        if len(out) >= 20_000:
            yield _owned(out)
            out = []
    yield _owned(out)


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], _OWNED.names)


def _merge_rows(a: list, b: list) -> list:
    """Entries are [doc_id, row, values]; the smaller identifier stays with its row."""
    return a if _order(a[0], a[1]) <= _order(b[0], b[1]) else b


def _row_bytes(entry: list) -> int:
    return sum(64 + (len(v) if isinstance(v, (str, bytes)) else 0) for v in entry[2])


def _own_rows(batches: Iterator[pa.RecordBatch], budget: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The row with the smallest identifier of each text, with the columns of schema."""
    trie = PatriciaTrie(_merge_rows, budget, weigh=_row_bytes)
    for batch in batches:
        ids, texts, rows = batch.column(0).to_pylist(), batch.column(1), batch.column("_rep").to_pylist()
        columns = [batch.column(n).to_pylist() for n in schema.names]
        for i, values in enumerate(zip(*columns)):
            trie.insert(normalise(texts[i].as_py()), [ids[i], rows[i], values])
    out, size = [], 0
    for key, (_, _, values) in trie.items():
        out.append(values)
        size += len(key)
        if size >= WINDOW_BYTES // 4:
            yield _batch(out, schema)
            out, size = [], 0
    yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _positional(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs as _c0 (doc_id as long), _c1 (text), then the other columns, and their names in that order: no name can clash."""
    shared.ship(docs.sparkSession)
    shared.pick(docs, "doc_id", "text")
    lead = [docs.columns.index(n) for n in ("doc_id", "text")]
    order = [*lead, *(i for i in range(len(docs.columns)) if i not in lead)]
    flat = docs.toDF(*[f"_p{i}" for i in range(len(docs.columns))])
    flat = flat.select(*[(F.col(f"_p{i}").cast("long") if n == 0 else F.col(f"_p{i}")).alias(f"_c{n}") for n, i in enumerate(order)])
    return flat, [docs.columns[i] for i in order]


def _folded(flat: DataFrame, window_bytes: int, report: bool) -> DataFrame:
    fields = [T.StructField(f.name, f.dataType, True) for f in flat.schema] + [T.StructField(n, T.LongType()) for n in _OWN]
    return flat.mapInArrow(partial(_fold, limit=window_bytes, report=report), T.StructType(fields))


_DEALT = ("_length", "_content")


def _hot_texts(reps: DataFrame) -> DataFrame | None:
    """_length, _content and _parts of the texts that more windows hold than one owner should take, if there are any."""
    per = reps.groupBy(*_DEALT).agg(F.count("*").alias("n"))
    least = max(HOT_REPS, reps.count() // HOT_TEXTS)
    hot = shared.materialise(per.where(F.col("n") > least).select(*_DEALT, F.ceil(F.col("n") / least).cast("int").alias("_parts")), "hot-texts")
    return None if hot.isEmpty() else F.broadcast(hot)


def _in_parts(reps: DataFrame, hot: DataFrame) -> DataFrame:
    """The representatives of hot texts, dealt in parts."""
    part = F.pmod(F.xxhash64("_rep"), F.col("_parts")).alias("_part")
    return reps.join(hot, list(_DEALT)).select(*reps.columns, part).repartition(*_DEALT, "_part").drop("_part")


def exact_dedup(docs: DataFrame, window_bytes: int = WINDOW_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Input: doc_id, text (other columns are ignored). Texts are equal when identical after
    replacing each run of ASCII white space by one space; null counts as empty. The row with
    the smallest doc_id stays; null doc_ids come last; of repeated rows with the smallest
    doc_id exactly one is kept. An empty table gives no rows.
    """
    flat, _ = _positional(shared.pick(docs, "doc_id", "text"))
    folded = shared.materialise(_folded(flat, window_bytes, True), "folded")
    reps = folded.where("_length is not null").select("_c0", "_c1", "_rep", "_count", *_DEALT)
    entry = ["_c0", "_c1", "_rep", "_count"]

    def owned(rows: DataFrame, f, schema: T.StructType) -> DataFrame:
        return rows.select(*entry).mapInArrow(partial(f, budget=trie_bytes), schema)

    if (hot := _hot_texts(reps)) is None:
        found = owned(reps.repartition(*_DEALT), _own, _OWNED)
    else:
        parts = shared.materialise(owned(_in_parts(reps, hot), _own_part, _PART), "hot-parts")
        of = parts.where("_of is not null").select("_rep", F.col("_of").alias("_top"))
        # Dealt by the text's own digest: a hot text's parts are few by now.
        tops = owned(parts.where("_of is null").repartition(F.sha2("_c1", 256)), _own, _OWNED).withColumnRenamed("_rep", "_top")
        cold = owned(reps.join(hot, list(_DEALT), "left_anti").repartition(*_DEALT), _own, _OWNED)
        found = cold.unionByName(of.join(tops, "_top").drop("_top"))
    rows = folded.where("_length is null").select(F.col("_c0").alias("doc_id"), "_rid", "_rep")
    return rows.join(found, "_rep").select(
        "doc_id", "keep_id", "group_size", (F.col("_rid") == F.col("_keep_rid")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, window_bytes: int = WINDOW_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows that exact_dedup keeps, whole, with the columns of docs in their order.

    The representatives go to their owners with all their columns, and an owner returns the
    row of each terminal node.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    flat, names = _positional(docs)
    kinds = {f.name: f.dataType for f in docs.schema}
    reps = shared.materialise(_folded(flat, window_bytes, False), "folded")

    def owned(rows: DataFrame, schema: T.StructType) -> DataFrame:
        out = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        return rows.mapInArrow(partial(_own_rows, budget=trie_bytes, schema=to_arrow_schema(out)), out)

    if (hot := _hot_texts(reps)) is not None:
        cold = reps.join(hot, list(_DEALT), "left_anti").select(*reps.columns)
        reps = cold.unionByName(owned(_in_parts(reps, hot), reps.schema))
    kept = owned(reps.repartition(*_DEALT), flat.schema)
    return kept.select(*[F.col(f"_c{names.index(n)}").cast(kinds[n]).alias(n) for n in docs.columns])
