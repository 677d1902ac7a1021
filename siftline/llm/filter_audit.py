"""Filter interaction audit by lattice-edge aggregation.

With k filters a document meets a filter after some subset of the others: k * 2^(k-1)
(subset, next filter) edges of the lattice of subsets, 80 for five filters, whatever the
order inside the subset. What a document adds to an edge depends only on the set of filters
that it fails, so documents of a part are first counted by that set and the counts
contribute to all edges. An order of the filters is a path of k edges from the empty to the
full subset; the k! orders (600 steps of five filters) are joined with the edges and never
replayed on documents. The Shapley count of a filter weighs each edge by the orders through it.

A text is read once. What is kept of a row is its part, its failures and the SHA-256 of its
text, by which copies are told; texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: The filters in the order of their bits.
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")

LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
MARKS = b"#$%&*|"

_CAPITALS = bytes(range(65, 91))
_LATER_BYTES = bytes(range(0x80, 0xC0))  # of a code point in UTF-8

_FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.StringType()),
        T.StructField("mask", T.IntegerType()),
        T.StructField("digest", T.BinaryType()),
    ]
)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words, distinct = 0, set()
    for part in shared.word_slices(text):
        words += len(part)
        distinct.update(part)
    code_points = len(text.translate(None, _LATER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (
        words < LEAST_WORDS,
        100 * len(distinct) < LEAST_DISTINCT_PERCENT * words,
        100 * capitals > MOST_CAPITALS_PERCENT * code_points,
        len(text) != len(text.translate(None, MARKS)),
    )
    return sum(f << i for i, f in enumerate(failed))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for scalar in batch.column(2).cast(pa.large_binary()):
            text = scalar.as_py() or b""
            masks.append(failures(text))
            digests.append(hashlib.sha256(text).digest())
        columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, _FEATURES.names)


def failure_classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the documents, good documents and toxic documents that fail just the filters of mask.

    Every part has at most 2^5 rows. Only rows of repeated texts are looked up by digest, and
    only small columns meet the labels.
    """
    shared.ship(docs.sparkSession)
    flat = shared.pick(docs, "doc_id", "source", "text")
    flat = flat.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary"))
    rows = shared.materialise(flat.mapInArrow(_features, _FEATURES), "audit-rows")
    repeated = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = shared.materialise(repeated, "audit-texts")
    copies = shared.join_skewed(rows, repeated, "digest").where("doc_id > first").select("doc_id", "part", "mask")
    # A copy is taken out of the class that it was counted in and put in the one with the copy filter.
    signed = (
        rows.select("doc_id", "part", "mask", F.lit(1).alias("sign"))
        .unionByName(copies.withColumn("sign", F.lit(-1)))
        .unionByName(copies.withColumn("mask", F.col("mask").bitwiseOR(COPY)).withColumn("sign", F.lit(1)))
    )
    told = shared.pick(labels, "doc_id", "quality", "toxic").where("quality = 1 OR toxic = 1")
    told = told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    total = lambda x: F.coalesce(F.sum(F.col("sign") * x), F.lit(0)).cast("long")
    return signed.join(told, "doc_id", "left").groupBy("part", "mask").agg(
        total(F.lit(1)).alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic")
    )


def lattice(k: int) -> list[tuple[int, int]]:
    """All (subset, filter) edges over k filters; the subset as bits, the filter as its bit."""
    return [(s, 1 << f) for f in range(k) for s in range(1 << k) if not s >> f & 1]


def edge_counts(classes: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """part, subset, filter and COUNTS of every lattice edge, with zeros, and `shapley` of its filter."""
    edges = F.array(*[F.struct(F.lit(s).alias("subset"), F.lit(f).alias("filter")) for s, f in lattice(k)])
    fails = F.col("mask").bitwiseAND(F.col("filter")) != 0
    gone = F.col("mask").bitwiseAND(F.col("subset")) != 0
    tally = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    per = classes.select("part", "mask", "n", "good", "toxic", F.inline(edges)).groupBy("part", "subset", "filter")
    counted = per.agg(
        tally(~fails & ~gone).alias("kept"),
        tally(fails & ~gone).alias("removed"),
        tally(fails & gone).alias("redundant"),
        tally(F.col("mask") == F.col("filter")).alias("unique_fails"),
        tally(fails & ~gone, "good").alias("good_lost"),
        tally(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    # Orders through an edge: those of the subset, then those of what is left.
    orders = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.bit_count("subset") + 1)
    shapley = counted.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    return counted.join(shapley, ["part", "filter"])


def paths(letters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, subset, filter) of every step of every order: k * k! rows."""
    bit = {x: 1 << i for i, x in enumerate(letters)}
    return [("".join(p), i + 1, sum(bit[x] for x in p[:i]), bit[p[i]]) for p in permutations(letters) for i in range(len(p))]


def audit_orders(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Input: doc_id, source, text of docs and doc_id, quality, toxic of labels (other columns
    are ignored). A null text is empty (and equal to other empty ones), a null source is the
    part of the empty string. Repeated rows count each; rows of one doc_id are no copies of each
    other, and a row without doc_id is neither a copy nor has copies. A document is good (toxic)
    if any label row of its doc_id says so. No documents, no parts: an empty table gives no rows.
    """
    spark = docs.sparkSession
    edges = edge_counts(failure_classes(docs, labels))
    steps = spark.createDataFrame(paths(), "filter_order string, step int, subset int, filter int")
    long: list[Column] = [F.col(c).cast("long").alias(c) for c in (*COUNTS, "shapley")]
    return edges.join(F.broadcast(steps), ["subset", "filter"]).select("part", "filter_order", "step", *long)


#: The same in DuckDB SQL.
SQL = r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
    ), w AS (
      SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY text) AS first
      FROM d
    ), l AS (
      SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id
    ), f AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * capitals > 2 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id
    ), letters AS (
      SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
    ), orders AS (
      SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
    ), steps AS (
      SELECT filter_order, step, bits[step] AS filter, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS subset
      FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
    ), c AS (
      SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
    ), r AS (
      SELECT part, filter_order, step, filter,
        sum(CASE WHEN mask & (subset | filter) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & filter <> 0 AND mask & subset = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & filter <> 0 AND mask & subset <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = filter THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & filter <> 0 AND mask & subset = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & filter <> 0 AND mask & subset = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c, steps GROUP BY part, filter_order, step, filter
    )
    SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      sum(removed) OVER (PARTITION BY part, filter)::BIGINT AS shapley
    FROM r
"""
