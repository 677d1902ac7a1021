"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of PERCENT or more.

Which documents meet. Two alike sets differ in few shingles, at most D for sets of their
sizes. If the space of shingle hashes is cut into D + 1 segments, one holds no difference:
both sets are the same there. So each set has a key for each segment (its hash range's own
content), under the segmentation of its band of sizes and of the bands whose larger partners
it may be. Every alike pair shares a key, and sets that share one are alike on a random
share of their shingles: neither common words nor passages that many texts share bring
documents together. Sets that are linked by shared keys form blocks.

How they are searched. A block's sets, each shipped once, become inverted lists that are
searched by T-occurrence with DivideSkip, in parts where they are many: see linking.

Equal sets are one class from the start, whatever their number. Sets are told apart by 128
bits of digest; shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .linking import block_links, components

SHINGLE, PERCENT = 3, 90
SEED = 42
#: The largest size of a band over its smallest: wide bands have longer segmentations, narrow ones more.
BAND = 1.3
#: Rows and shingles of a part of a block.
PART_ROWS, PART_SHINGLES = 4096, 4 << 20
#: Row ids that are broadcast to read their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hash a task keeps.
WORDS_HELD = 1 << 19

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number spread over all bits, one to one."""
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[0]
    return h ^ (h >> np.uint64(32))


class _Words(dict):
    """XXH64 of words."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= WORDS_HELD:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: bytes, held: _Words, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of `shingle` words; fewer words are one run, none are no run."""
    parts = [np.fromiter(map(held.__getitem__, w), np.uint64, len(w)) for w in shared.word_slices(text.lower())]
    words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    if not len(words):
        return words
    size = min(shingle, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mixed(h) + words[i : i + n] * _ODD[i % 3]
    return np.unique(mixed(h))


def bands(largest: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(smallest, largest partner, segments) of each band of sizes up to a size.

    A segmentation serves pairs whose smaller set is of the band; they differ in at most
    (100 - percent) * (a + b) / (100 + percent) shingles.
    """
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND))
        partner = high * 100 // percent
        out.append((low, partner, (100 - percent) * (high + partner) // (100 + percent) + 1))
        low = high + 1
    return out


def segment_keys(h: np.ndarray, table: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The keys of a set, given as sorted hashes: one for each segment of each segmentation that it takes part in.

    Where no difference is allowed there's one segment, the set itself: its class says as much, so it has no key.
    """
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h))])
    for band, (low, partner, segments) in enumerate(table):
        if low <= len(h) <= partner and segments > 1:
            step = (1 << 64) // segments + 1
            ends = np.searchsorted(h, np.array([step * i for i in range(1, segments)], np.uint64))
            ends = np.concatenate([[0], ends, [len(h)]])
            own = sums[ends[1:]] - sums[ends[:-1]]
            place = np.arange(segments, dtype=np.uint64) * _ODD[1] + np.uint64((band + 1) * int(_ODD[2]) % (1 << 64))
            out.append(mixed(mixed(own) + place))
    return out


_SETS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
    ]
)
_TEXT_SETS = T.StructType([*_SETS.fields[1:4], T.StructField("shingles", T.ArrayType(T.LongType()))])


def _hashed(batch: pa.RecordBatch, column: int, held: _Words, shingle: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each text's set and its digest of two words."""
    for scalar in batch.column(column).cast(pa.large_binary()):
        h = shingle_set(scalar.as_py() or b"", held, shingle)
        yield h, *(int(mixed(h ^ x).sum(dtype=np.uint64).view(np.int64)) for x in _ODD[:2])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int, percent: int) -> Iterator[pa.RecordBatch]:
    held, table = _Words(), bands(1 << 10, percent)
    for batch in batches:
        sizes, digests, keys = [], [], []
        for h, *digest in _hashed(batch, 1, held, shingle):
            if len(h) > table[-1][0]:
                table = bands(2 * len(h), percent)
            sizes.append(len(h))
            digests.append(digest)
            keys.append(segment_keys(h, table))
        ends = np.cumsum([0, *(sum(map(len, x)) for x in keys)])
        flat = np.concatenate([np.empty(0, np.uint64), *(x for own in keys for x in own)]).view(np.int64)
        d1, d2 = zip(*digests) if digests else ((), ())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists], _SETS.names)


def _text_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    held = _Words()
    for batch in batches:
        rows = [(len(h), d1, d2, h.view(np.int64)) for h, d1, d2 in _hashed(batch, 0, held, shingle)]
        columns = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_TEXT_SETS)], _TEXT_SETS.names)


_ARROW_TEXT_SETS = [pa.field("n", pa.int64()), pa.field("d1", pa.int64()), pa.field("d2", pa.int64()), pa.field("shingles", pa.list_(pa.int64()))]


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Input: doc_id, text (other columns are ignored). Null and wordless texts have an empty
    set, no links and are their own component. Repeated rows keep their rows; rows of equal
    sets are linked. Null doc_ids count as no identifier: a component of nothing else has a
    null component_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    rows = shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    digests = ["d1", "d2", "n"]
    features = shared.materialise(rows.mapInArrow(partial(_sets, shingle=shingle, percent=percent), _SETS), "shingle-sets", keep=True)
    with shared.temporary(spark):
        classes = features.where("n > 0").groupBy(*digests).agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
        classes = shared.materialise(classes, "classes")
        keyed = features.select("d1", F.explode("keys").alias("key"))
        held = keyed.groupBy("key").agg(F.min("d1").alias("b"), F.max("d1").alias("last"), F.count("*").alias("n")).where("b < last")
        held = shared.materialise(held.select("key", "b", "n"), "shared-keys")
        edges = shared.join_skewed(keyed, held, "key").where("d1 <> b").select(F.col("d1").alias("a"), "b").distinct()
        block = components(edges)
        blocks = classes.join(block, classes["d1"] == block["node"]).select(*digests, "first", F.col("root").alias("block"))
        blocks = shared.materialise(blocks.withColumn("cid", F.monotonically_increasing_id()), "members")
        # The texts of the blocks' sets are read again by doc_id; rows of other texts under that id fall out by their digest.
        ids = blocks.select(F.col("first").alias("wanted")).distinct()
        ids = shared.materialise(ids, "wanted")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
        texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["wanted"]), "left_semi").select("text")
        sets = texts.mapInArrow(partial(_text_sets, shingle=shingle), _TEXT_SETS).join(blocks.select(*digests, "cid"), digests)
        sets = shared.materialise(sets.groupBy("cid").agg(F.first("shingles").alias("shingles")), "sets")
        found = components(reduce(DataFrame.unionByName, block_links(blocks.select("block", "cid", "n"), sets, percent, PART_ROWS, PART_SHINGLES)))
        rooted = blocks.join(found, blocks["cid"] == found["node"]).select(*digests, "first", "root")
        lowest = shared.materialise(rooted.groupBy("root").agg(F.min("first").alias("component")), "lowest")
        member = rooted.join(lowest, "root").select(*digests, "component")
        named = classes.join(member, digests, "left").select(F.struct(*digests).alias("set"), F.col("rows").alias("held"), F.coalesce("component", "first").alias("component_id"))
        named = shared.materialise(named, "components", keep=True)
    slim = features.where("n > 0").select("doc_id", F.col("n").alias("n_shingles"), F.struct(*digests).alias("set"))
    linked = shared.join_skewed(slim, named, "set", "held").select("doc_id", "n_shingles", "component_id")
    alone = features.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


#: The same in DuckDB SQL: all pairs that share a shingle are counted, and the least doc_id is carried along the links.
SQL = rf"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM documents
    ), s AS MATERIALIZED (
      SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(1, len(words) - {SHINGLE - 1})), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' '))) AS x
      FROM w WHERE len(words) > 0
    ), n AS MATERIALIZED (
      SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), o AS MATERIALIZED (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    ), l AS MATERIALIZED (
      SELECT o.a, o.b FROM o JOIN n na ON na.doc_id = o.a JOIN n nb ON nb.doc_id = o.b
      WHERE 100 * o.both >= {PERCENT} * (na.n + nb.n - o.both)
    ), r AS (
      SELECT a AS doc_id, b AS reached FROM l
      UNION
      SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a
    ), c AS (
      SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id
    )
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""
