"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints within `radius` bits are linked. Every bit position i gets a vector m(i) of
radius + 1 bits; for each nonzero vector v a table masks the fingerprint to the bits with
<m(i), v> = 1. The at most `radius` differing bits of a pair always leave a nonzero v
orthogonal to all their vectors, so every such pair agrees on some table's masked bits:
recall is 1 by construction, with 2^(radius+1) - 1 tables.

Equal fingerprints are folded first. Only fingerprints whose bucket holds another one go
on. A small bucket is compared within itself and returns a spanning forest, not its pairs.
A bucket over BUCKET is never gathered: its fingerprints are exploded to the points at most
radius / 2 bits away, which two fingerprints share exactly if they are within the radius
(even radii), and a point has a bounded number of neighbours. Components come from
alternating large-star and small-star rounds on tables in the shared folder.

`drop_near_copies` is the stage form: one document stays of each group of texts whose
five-word shingles have a Jaccard similarity of 0.8 or more. Such pairs differ in about ten
of 64 SimHash bits (measured: 5 to 14), far over any radius that covering tables reach, so
the stage adds fingerprints of min-wise samples of the shingles to the covering tables, and
verifies every candidate link on the full shingle sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .linking import EDGES, block_links, components, forest_links

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of one masked bucket that are compared with each other in one go.
BUCKET = 128
#: Shingles hashed at once.
CHUNK = 200_000

_BIT = 1 << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half of the shingles' XXH64 values have it.

    Words are runs of characters that aren't ASCII white space, A-Z in lower case; shingles
    are runs of `shingle` words joined by spaces, repeats included. Fewer words make one
    shingle, none make 0.
    """
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, CHUNK):
        part = words[a : a + CHUNK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if n > 1 or len(words) == shingle else [b" ".join(words)]
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((_BIT * (2 * ones > n).astype(np.uint64)).sum())


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """2^(radius+1) - 1 masks such that any `radius` bit positions are all unmasked in one of them.

    Positions get the nonzero vectors in turn, shuffled, so that every mask keeps about
    half of the bits or more.
    """
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_PRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], _PRINTS.names)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""
    shared.ship(docs.sparkSession)
    rows = shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), _PRINTS)


def _forest(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """For each bucket the edges of a spanning forest over its fingerprints within the radius."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for members in batch.column(0):
            own = np.array(sorted(members.as_py()), np.int64)
            near = np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= radius
            open_ = np.ones(len(own), bool)
            for start in range(len(own)):
                if not open_[start]:
                    continue
                open_[start], todo = False, [start]
                while todo:
                    i = todo.pop()
                    for j in np.flatnonzero(near[i] & open_).tolist():
                        open_[j] = False
                        found.append((int(own[j]), int(own[start])))
                        todo.append(j)
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], EDGES.names)


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges a, b over the distinct fingerprints in column fp whose components are those of all pairs within the radius."""
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(
        *[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))]
    )
    keyed = nodes.select("fp", F.inline(tables))
    held = shared.materialise(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    together = keyed.join(held.where(F.col("n") <= bucket), ["t", "key"])
    small = (
        together.groupBy("t", "key").agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(partial(_forest, radius=radius), EDGES)
    )
    # Points near the fingerprints of large buckets; those that share a point are linked to its smallest.
    large = keyed.join(held.where(F.col("n") > bucket), ["t", "key"], "left_semi").select("fp").distinct()
    flips = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    points = large.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in flips])).alias("flip"))
    around = points.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point")).agg(F.collect_list("fp").alias("members"))
    stars = around.where(F.size("members") > 1).select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    return small.unionByName(stars.where("a <> b"))


def near_copies(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Input: doc_id, text (other columns are ignored). Null, empty and wordless texts have
    fingerprint zero and are linked like any other. Repeated rows keep their rows. Null
    doc_ids count as no identifier: a component of nothing else has a null component_id. An
    empty table gives no rows.
    """
    prints = shared.materialise(fingerprints(docs, shingle), "fingerprints")
    nodes = shared.materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.select("fp"), radius, bucket))
    rooted = shared.materialise(nodes.join(found, nodes["fp"] == found["node"]).select("fp", "root", "first"), "rooted")
    lowest = shared.materialise(rooted.groupBy("root").agg(F.min("first").alias("component")), "lowest")
    member = shared.materialise(rooted.join(lowest, "root").select("fp", "component"), "members")
    named = nodes.join(member, "fp", "left").select("fp", "n", F.coalesce("component", "first").alias("component_id"))
    named = shared.materialise(named, "components")
    return shared.join_skewed(prints, named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------- the stage form

STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: Sampled fingerprints, and minima in each: a pair of similarity 0.8 shares one with probability 0.998.
SAMPLES, MINIMA = 16, 5
#: Rows, and shingles in all, that are compared with each other in one go.
REST, GROUP_SHINGLES = 1024, 4 << 20
_SALT = np.random.default_rng(SEED).integers(1, 1 << 63, (2, SAMPLES * MINIMA), dtype=np.uint64)
_FEATURES = T.StructType(
    [
        T.StructField("rid", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("shingles", T.ArrayType(T.IntegerType())),
    ]
)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words (fewer words: one run), as in fingerprint."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def bucket_keys(hashes: np.ndarray, table_masks: list[int]) -> tuple[list[int], np.ndarray]:
    """Signed keys of the covering tables and of the sampled fingerprints, and the samples' minima; texts with no word have none."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return [], np.empty(0, np.int32)
    ones = np.zeros(64, np.int64)
    low = np.full(SAMPLES * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 8192):
        h = hashes[a : a + 8192]
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        mixed = (h[None, :] ^ _SALT[0][:, None]) * (_SALT[1][:, None] | np.uint64(1))
        np.minimum(low, (mixed ^ (mixed >> np.uint64(29))).min(axis=1), out=low)
    fp = int((_BIT * (2 * ones > len(hashes)).astype(np.uint64)).sum())
    parts = [b"c%d:%d" % (t, fp & m) for t, m in enumerate(table_masks)]
    parts += [b"s%d:" % t + low[t * MINIMA : (t + 1) * MINIMA].tobytes() for t in range(SAMPLES)]
    return [_signed(xxh64_intdigest(x, SEED)) for x in parts], (low >> np.uint64(8)).astype(np.uint32).view(np.int32)


def _features(batches: Iterator[pa.RecordBatch], shingle: int, table_masks: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sets = [], []
        for text in batch.column(2):
            h = shingle_hashes(text.as_py(), shingle)
            keys.append(bucket_keys(h, table_masks)[0])
            sets.append(np.unique((h >> np.uint64(32)).astype(np.uint32)).view(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(sets, pa.list_(pa.int32())),
            ],
            _FEATURES.names,
        )


def _parts(rows: str, shingles: str) -> Column:
    """The number of groups of about REST rows and GROUP_SHINGLES shingles at most."""
    return F.ceil(F.greatest(F.col(rows) / REST, F.col(shingles) / GROUP_SHINGLES)).cast("int")


def _sized(keyed: DataFrame) -> DataFrame:
    """Rows (rid, size, key) whose key another row has, with the number of parts of their bucket."""
    per = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    per = shared.materialise(per.select("key", "n", _parts("n", "shingles").alias("parts")), "buckets")
    return shared.materialise(shared.join_skewed(keyed, per, "key").select("rid", "size", "key", "parts"), "bucketed")


def _within(rows: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """Links within buckets of one part; buckets of the same rows count once."""
    same = rows.groupBy("key").agg(F.sort_array(F.collect_list("rid")).alias("rids")).select("rids").distinct()
    groups = shared.materialise(same.withColumn("block", F.monotonically_increasing_id()), "groups")
    return forest_links(groups.select("block", F.explode("rids").alias("cid")), sets, ["block"], percent)


def similar_links(features: DataFrame, similarity: float) -> DataFrame:
    """Edges a, b (row ids) of texts at least `similarity` alike, enough to connect what is alike.

    All rows that share a bucket are compared, on their sets of 32-bit shingle hashes: buckets of
    one part (REST rows) whole, larger ones part by part as far as the links so far leave
    anything to tell (see linking.block_links). Nothing that shares a bucket is left out.
    """
    shared_rows = _sized(features.select("rid", F.size("shingles").alias("size"), F.explode("keys").alias("key")))
    # The rows that share a key are a share of all rows: a shuffled join, at every size.
    sets = features.select(F.col("rid").alias("cid"), "shingles").join(shared_rows.select(F.col("rid").alias("cid")).distinct().hint("merge"), "cid", "left_semi")
    sets, percent = shared.materialise(sets, "sets"), round(similarity * 100, 9)
    found = [_within(shared_rows.where("parts = 1"), sets, percent)]
    large = shared_rows.where("parts > 1")
    if not large.isEmpty():
        found = block_links(large.select(F.col("key").alias("block"), F.col("rid").alias("cid"), F.col("size").alias("n")), sets, percent, REST, GROUP_SHINGLES, tuple(found))
    return reduce(DataFrame.unionByName, found)


def drop_near_copies(docs: DataFrame, similarity: float = STAGE_SIMILARITY, shingle: int = STAGE_SHINGLE) -> DataFrame:
    """The rows of docs, whole, less all but one of each group of near copies.

    Texts are near copies if the Jaccard similarity of their sets of `shingle`-word runs is
    at least `similarity`; groups are connected components. The smallest doc_id stays, null
    doc_ids only if there is no other; of repeated rows one. Texts without a word are left
    alone. Columns and their order are those of docs; an empty table gives no rows.
    """
    shared.ship(docs.sparkSession)
    flat = shared.numbered(docs, "near-rows")
    doc_id, text = (F.col(f"_c{docs.columns.index(n)}") for n in ("doc_id", "text"))
    rows = flat.select("_rid", doc_id.cast("long").alias("doc_id"), text.alias("text"))
    f = partial(_features, shingle=shingle, table_masks=masks(RADIUS))
    with shared.temporary(docs.sparkSession):
        features = shared.materialise(rows.mapInArrow(f, _FEATURES), "features")
        found = components(similar_links(features, similarity))
        ids = features.select("rid", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid").alias("who"))
        grouped = shared.materialise(found.join(ids, found["node"] == ids["rid"]).select("root", "who"), "grouped")
        stays = shared.materialise(grouped.groupBy("root").agg(F.min("who").alias("first")), "stays")
        goes = grouped.join(stays, "root").where(F.col("who.rid") != F.col("first.rid")).select(F.col("who.rid").alias("_rid"))
        goes = shared.materialise(goes, "goes", keep=True)
    return flat.join(goes, "_rid", "left_anti").drop("_rid").toDF(*docs.columns)
