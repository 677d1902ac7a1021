"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Word
capacity flows from patterns to source quotas; each further copy of a pattern's words costs
more than the one before (a convex cost), so repetition is spread as thinly as the quotas
allow. Only the pattern table reaches the driver: one row per distinct set of sources, no
rows per document. Whole documents are then selected in a seeded order: prefix sums over
hash buckets and within a bucket find the documents before a pattern's cut, and the gap
that whole documents leave is closed from the next few in line, then by further prefix sums
down the whole line until no document fits.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from fractions import Fraction
from math import lcm

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Words wanted of all sources by position in code point order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
MAX_COPIES = 2
SEED = 20240229
#: More distinct membership patterns than this are refused: they would not be a small table.
MAX_PATTERNS = 500_000
ROWS_PER_BUCKET = 20_000
#: Tables with a row for each pattern are broadcast up to this many.
BROADCAST_PATTERNS = 5000
#: Documents after the cut among which the gap is closed first.
NEXT_IN_LINE = 256


def source_order(name: str | None) -> tuple:
    """Code point order, null last."""
    return (name is None, [ord(c) for c in name or ""])


def targets(sizes: dict[str | None, int], total: int, weights: Sequence[int], share: Fraction, copies: int) -> dict:
    """Words wanted per source: shares of share * total by weight, at most copies * size, excess shared anew."""
    names = sorted(sizes, key=source_order)
    weight = {n: Fraction(weights[i % len(weights)]) for i, n in enumerate(names)}
    out, open_, rest = {}, list(names), share * total
    while open_:
        unit = rest / sum(weight[n] for n in open_)
        over = [n for n in open_ if unit * weight[n] > copies * sizes[n]]
        if not over:
            out |= {n: unit * weight[n] for n in open_}
            break
        for n in over:
            out[n] = Fraction(copies * sizes[n])
            rest -= out[n]
        open_ = [n for n in open_ if n not in out]
    return out


def route(patterns: dict[frozenset, int], wanted: dict, copies: int) -> dict[frozenset, Fraction]:
    """Words to take of each pattern: a flow that meets the quotas as far as it can at least cost.

    The k-th copy of a pattern's words costs k a word. Sources that share no pattern are
    separate problems.
    """
    component: dict = {n: n for n in wanted}

    def root(n):
        while component[n] != n:
            component[n] = component[component[n]]
            n = component[n]
        return n

    for members in patterns:
        first, *more = members
        for m in more:
            component[root(m)] = root(first)
    parts: dict = {}
    for members in patterns:
        parts.setdefault(root(next(iter(members))), []).append(members)
    out: dict[frozenset, Fraction] = {}
    for part in parts.values():
        out |= _min_cost_flow(part, patterns, wanted, copies)
    return out


class _Network:
    """A flow network of whole capacities: arc i leads to `to[i]` with `room[i]` left, arc i ^ 1 back."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for node, end, n in ((a, b, room), (b, a, 0)):
            self.out[node].append(len(self.to))
            self.to.append(end)
            self.room.append(n)
        return len(self.to) - 2

    def augment(self, start: int, end: int) -> None:
        """As much more flow as there is room for: blocking flows along shortest paths until `end` is cut off."""
        while True:
            level, line = {start: 0}, [start]
            for a in line:
                for i in self.out[a]:
                    if self.room[i] and self.to[i] not in level:
                        level[self.to[i]] = level[a] + 1
                        line.append(self.to[i])
            if end not in level:
                return
            tried, path = dict.fromkeys(level, 0), []
            while True:
                a = self.to[path[-1]] if path else start
                if a == end:
                    amount = min(self.room[i] for i in path)
                    for i in path:
                        self.room[i] -= amount
                        self.room[i ^ 1] += amount
                    del path[next(k for k, i in enumerate(path) if not self.room[i]) :]
                    continue
                while tried[a] < len(self.out[a]):
                    i = self.out[a][tried[a]]
                    if self.room[i] and level.get(self.to[i]) == level[a] + 1:
                        path.append(i)
                        break
                    tried[a] += 1
                else:
                    if not path:
                        break
                    tried[self.to[path.pop() ^ 1]] += 1


def _min_cost_flow(part: list[frozenset], sizes: dict, wanted: dict, copies: int) -> dict[frozenset, Fraction]:
    """Cheapest paths first: every path costs what the copy at its start costs, so all paths of one copy are one augmentation."""
    part = sorted(part, key=lambda p: sorted(map(source_order, p)))
    names = sorted({n for p in part for n in p}, key=source_order)
    unit = lcm(*(Fraction(wanted[n]).denominator for n in names))
    net, end = _Network(len(part) + len(names) + 2), len(part) + len(names) + 1
    at = {n: 1 + len(part) + i for i, n in enumerate(names)}
    supply = [net.arc(0, 1 + i, 0) for i in range(len(part))]
    for i, p in enumerate(part):
        for n in sorted(p, key=source_order):
            net.arc(1 + i, at[n], copies * sizes[p] * unit)
    for n in names:
        net.arc(at[n], end, int(wanted[n] * unit))
    for _ in range(copies):
        for i, p in zip(supply, part):
            net.room[i] += sizes[p] * unit
        net.augment(0, end)
    return {p: Fraction(net.room[i ^ 1], unit) for i, p in zip(supply, part)}


_TOPPED = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("size", T.LongType())])


def _close_gap(group: pa.Table) -> pa.Table:
    """Of the next documents in line those that fill the gap, largest first."""
    gap, chosen, sizes = group["gap"][0].as_py(), [], []
    line = zip(group["size"].to_pylist(), group["ordinal"].to_pylist())
    for size, ordinal in sorted(line, key=lambda x: (-x[0], x[1])):
        if 0 < size <= gap:
            chosen.append(ordinal)
            sizes.append(size)
            gap -= size
    pattern = pa.array([group["pattern"][0].as_py()] * len(chosen), pa.string())
    return pa.table({"pattern": pattern, "ordinal": pa.array(chosen, pa.int64()), "size": pa.array(sizes, pa.int64())})


def _bucket_and_order(n_buckets: int, seed: int) -> tuple[Column, Column]:
    """The seeded order of a row with doc_id and tie: its bucket, then its hash within the bucket."""
    order = F.xxhash64(F.lit(seed), "doc_id", "tie")
    return F.pmod(F.shiftright(order, 8), F.lit(n_buckets)).cast("int"), order


class Selection:
    """Which documents of a table (doc_id, tie, size, pattern) are taken how often.

    `rows` numbers them within their pattern: whole copies, and whether one more (`_in`) as
    the running sum in seeded order stays within the rest. `topped` (pattern, ordinal, size)
    are those taken once more to close the gap that whole documents leave.
    """

    def __init__(self, sized: DataFrame, words: dict[str, Fraction], sizes: dict[str, int], seed: int):
        spark = sized.sparkSession
        cuts = []
        for key, amount in words.items():
            whole = int(amount // sizes[key]) if sizes[key] else 0
            cuts.append((key, whole, float(amount - whole * sizes[key])))
        self.small = len(cuts) <= BROADCAST_PATTERNS
        self.cuts = self.bounded(spark.createDataFrame(cuts, "pattern string, whole long, rest double"))
        self.buckets, self.seed = max(64, sized.count() // ROWS_PER_BUCKET), seed
        bucket, order = _bucket_and_order(self.buckets, seed)
        dealt = sized.withColumn("_bucket", bucket).withColumn("_order", order)
        sums = dealt.groupBy("pattern", "_bucket").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.select(
            "pattern",
            "_bucket",
            F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_words"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows"),
        )
        within = Window.partitionBy("pattern", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        rows = (
            dealt.join(base, ["pattern", "_bucket"])
            .join(self.cuts, "pattern")
            .withColumn("_end", F.col("_words") + F.sum("size").over(within))
            .withColumn("ordinal", F.col("_rows") + F.count("*").over(within) - 1)
            .withColumn("_in", F.col("_end") <= F.col("rest"))
            .select("doc_id", "size", "pattern", "ordinal", "whole", "rest", "_bucket", "_order", "_end", "_in")
        )
        self.rows = shared.materialise(rows, "mix-order")
        last = F.struct("ordinal", "_end", "_bucket", "_order", "doc_id")
        #: The last row within the rest of each pattern that has one.
        self.last = self.rows.where("_in").groupBy("pattern").agg(F.max(last).alias("last"))
        first = F.coalesce(F.col("last.ordinal") + 1, F.lit(0))
        after = (
            self.rows.join(self.bounded(self.last), "pattern", "left")
            .where(F.col("ordinal") >= first)
            .select("pattern", "_bucket", "ordinal", "size", first.alias("first"), (F.col("rest") - F.coalesce("last._end", F.lit(0))).alias("gap"))
        )
        line = after.where(F.col("ordinal") < F.col("first") + NEXT_IN_LINE).select("pattern", "ordinal", "size", "gap")
        topped = line.groupBy("pattern").applyInArrow(_close_gap, _TOPPED)
        self.topped = self._down_the_line(after.drop("first"), shared.materialise(topped, "mix-topped"))

    def _down_the_line(self, after: DataFrame, topped: DataFrame) -> DataFrame:
        """topped and what else of the rows after the cut fits the gap that it leaves, until nothing does.

        A round takes the rows of at most half the gap in order while they fit: the first
        that doesn't shows that over half the gap is filled. If there are none, one row of
        over half the gap fits, the largest. So the rounds grow with the logarithm of the gap.
        """

        def remaining(line: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
            used = self.bounded(chosen.groupBy("pattern").agg(F.sum("size").alias("used")))
            left = (
                line.join(used, "pattern", how)
                .withColumn("gap", F.col("gap") - F.coalesce("used", F.lit(0)))
                .where((F.col("size") > 0) & (F.col("size") <= F.col("gap")))
                .drop("used")
            )
            return shared.materialise(left.join(chosen, ["pattern", "ordinal"], "left_anti"), "mix-line")

        line = remaining(after, topped, "left")
        while not line.isEmpty():
            half = line.where(2 * F.col("size") <= F.col("gap"))
            before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            sums = half.groupBy("pattern", "_bucket").agg(F.sum("size").alias("words"))
            base = sums.select("pattern", "_bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("_words"))
            within = Window.partitionBy("pattern", "_bucket").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
            run = half.join(base, ["pattern", "_bucket"]).withColumn("_end", F.col("_words") + F.sum("size").over(within)).where("_end <= gap")
            largest = line.groupBy("pattern").agg(
                F.max(F.struct("size", (-F.col("ordinal")).alias("back"))).alias("top"), F.min(2 * F.col("size") - F.col("gap")).alias("over")
            )
            one = largest.where("over > 0").select("pattern", (-F.col("top.back")).alias("ordinal"), F.col("top.size").alias("size"))
            chosen = shared.materialise(run.select("pattern", "ordinal", "size").unionByName(one), "mix-topped")
            topped = topped.unionByName(chosen)
            line = remaining(line, chosen, "inner")
        return topped

    def bounded(self, per_pattern: DataFrame) -> DataFrame:
        """A table of a row per pattern: broadcast if there are few patterns, else joined by shuffle."""
        return F.broadcast(per_pattern) if self.small else per_pattern

    def taken(self) -> DataFrame:
        """doc_id, size, pattern, ordinal, taken of every row."""
        top = self.topped.select("pattern", "ordinal", F.lit(True).alias("_top"))
        extra = F.when(F.col("_in") | F.col("_top"), 1).otherwise(0)
        return self.rows.join(top, ["pattern", "ordinal"], "left").select(
            "doc_id", "size", "pattern", "ordinal", (F.col("size") * (F.col("whole") + extra)).cast("long").alias("taken")
        )


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(shared.WORD)).cast("long")


def pattern(sources: Column) -> Column:
    """The set of sources as JSON text."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Sequence[int] = WEIGHTS,
    share: Fraction = SHARE,
    copies: int = MAX_COPIES,
    seed: int = SEED,
    tie: Column | None = None,
) -> tuple[Selection, dict, dict, dict]:
    """(what is taken; source sizes; source targets; pattern by set of sources).

    Input: doc_id, text, and `sources`, an array<string> of the sources a document belongs
    to (one null element: the null source). Null and empty texts have size 0 and are never
    taken. A document is taken 0 to `copies` times, whole. Repeated rows are documents
    each, in a defined order up to rows that are equal in every column used; so are rows
    without a doc_id. `tie` tells rows of one doc_id apart, a hash of the text if it isn't
    given, so that many such rows are no hot bucket. An empty table gives no rows. The same
    input and seed give the same rows.
    """
    shared.ship(docs.sparkSession)
    tie = F.xxhash64("text") if tie is None else tie
    sized = docs.select(F.col("doc_id"), tie.alias("tie"), word_count(F.col("text")).alias("size"), pattern(sources).alias("pattern"))
    sized = shared.materialise(sized, "mix-sizes")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    keys = {frozenset(json.loads(r["pattern"])): r["pattern"] for r in found}
    patterns = {frozenset(json.loads(r["pattern"])): r["words"] for r in found}
    sizes: dict[str | None, int] = {}
    for names, words in patterns.items():
        for n in names:
            sizes[n] = sizes.get(n, 0) + words
    wanted = targets(sizes, sum(patterns.values()), weights, share, copies)
    flow = route(patterns, wanted, copies)
    words = {keys[p]: amount for p, amount in flow.items()}
    return Selection(sized, words, {keys[p]: n for p, n in patterns.items()}, seed), sizes, wanted, keys


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (see mix); source is a plain column here."""
    spark = docs.sparkSession
    selection, sizes, wanted, keys = mix(shared.pick(docs, "doc_id", "text", "source"), F.array("source"), **options)
    rows = [(keys[frozenset([n])], int(sizes[n]), float(wanted[n])) for n in sizes]
    per = selection.bounded(spark.createDataFrame(rows, "pattern string, source_size long, target double"))
    return selection.taken().join(per, "pattern").select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, whole, each as often as mix takes it; source is a plain column here.

    Rows without a word are never taken. Columns and their order are those of docs. The
    rows themselves aren't shuffled: a row is within its pattern's cut or not, and only
    those that close a gap are looked up.
    """
    flat = shared.numbered(docs, "mix-rows")
    at = {n: F.col(f"_c{docs.columns.index(n)}") for n in ("text", "source")}
    # The row's number stands for the doc_id, so that repeated doc_ids stay apart.
    keyed = flat.select("*", F.col("_rid").alias("doc_id"), F.lit(0).alias("tie"), pattern(F.array(at["source"])).alias("pattern"))
    chosen, *_ = mix(keyed.select("doc_id", at["text"].alias("text"), at["source"].alias("source")), F.array("source"), tie=F.lit(0), **options)
    top = chosen.rows.join(chosen.topped, ["pattern", "ordinal"], "left_semi").select(F.col("doc_id").alias("_top"))
    top = shared.materialise(top, "mix-topped-rows")
    bucket, order = _bucket_and_order(chosen.buckets, chosen.seed)
    cut = F.struct(F.col("last._bucket"), F.col("last._order"), F.col("last.doc_id"))
    within = F.coalesce(F.struct(bucket.alias("_bucket"), order.alias("_order"), "doc_id") <= cut, F.lit(False))
    times = F.col("whole") + F.when(within | F.col("_top").isNotNull(), 1).otherwise(0)
    cuts = shared.materialise(chosen.last, "mix-cuts")
    repeated = (
        keyed.where(at["text"].rlike(shared.WORD))
        .join(chosen.cuts, "pattern")
        .join(chosen.bounded(cuts), "pattern", "left")
        .join(top, keyed["doc_id"] == top["_top"], "left")
        .withColumn("_times", times.cast("int"))
        .where("_times > 0")
        .select(*flat.columns[:-1], F.explode(F.sequence(F.lit(1), "_times")))
    )
    return repeated.select(*flat.columns[:-1]).toDF(*docs.columns)
