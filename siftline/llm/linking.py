"""Sets of numbers that are alike: how they are searched inside groups, and connected components of links.

The sets of a group become inverted lists. A set is a query with the least overlap T that a
partner of any size needs; DivideSkip leaves out the L longest lists, merges the short ones on
a heap, skipping what can't reach T - L occurrences, and probes the long lists for the
candidates that do by binary search. What is found is checked exactly, leaves the lists and
is a query in turn: a spanning forest of all links, never the pairs.

A group of more than one part is dealt. Its parts are searched alone first; then the sets
with the most links of some parts are queries in all parts; then all sets that aren't in the
group's largest component yet are, in the parts where their rarest elements lie in other
components. Two sets that are in different components can't both be in the largest one, and
alike sets share one of those elements, so no link between components is lost.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial, reduce
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

MAX_ROUNDS = 60
#: DivideSkip's weight of a probe against a merge.
PROBE_WEIGHT = 0.0085
#: Entries of the short lists up to which a heap merges them; more are merged as sorted runs.
HEAP_ENTRIES = 256
#: Long lists that are probed before what can't reach the least overlap is left out.
PROBED = 64
#: Parts whose best-linked set is a query in all parts of its group.
HUBS = 8

EDGES = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for all nodes that have an edge.

    Alternates large-star and small-star rounds; each round's edges are a table in the
    shared folder, at most as many as before, and the rounds grow with the logarithm of the
    longest chain: more than MAX_ROUNDS, which no table can need, are an error.
    """
    directed = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = shared.materialise(directed(edges), "edges"), None
    for _ in range(MAX_ROUNDS):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = shared.materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = shared.materialise(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        low = shared.materialise(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        current = shared.materialise(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state = tuple(current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
    raise RuntimeError("components did not settle")


def merged(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries that at least `least` of some sorted lists hold, and in how many they are.

    A heap of the lists' heads. If the smallest head is in too few lists, the least - 1
    smallest heads are popped and their lists skip to the next head: what lies between
    can't be in enough lists.
    """
    lists = [x for x in lists if len(x)]
    if len(lists) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if sum(map(len, lists)) > HEAP_ENTRIES:
        found, counts = np.unique(np.concatenate(lists), return_counts=True)
        return found[counts >= least], counts[counts >= least]
    own = [x.tolist() for x in lists]
    at = [0] * len(own)
    heap = [(x[0], i) for i, x in enumerate(own)]
    heapq.heapify(heap)
    found, counts = [], []
    while len(heap) >= least:
        smallest, popped = heap[0][0], []
        while heap and heap[0][0] == smallest:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append(smallest)
            counts.append(len(popped))
            target = smallest + 1
        else:
            while len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(own[i], target, at[i])
            if at[i] < len(own[i]):
                heapq.heappush(heap, (own[i][at[i]], i))
    return np.array(found, np.int64), np.array(counts, np.int64)


def divide_skip(
    lengths: np.ndarray, take: Callable[[int], np.ndarray], probe: Callable[[np.ndarray, np.ndarray], np.ndarray], least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Entries that at least `least` of some sorted lists hold, and in how many they are: the longest lists are only probed.

    take(i) is list i; probe(which, entries) says for some lists (rows) and entries (columns) whether they hold them.
    """
    if len(lengths) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(lengths, kind="stable")
    long = min(least - 1, int(least / (PROBE_WEIGHT * log2(int(lengths[order[-1]]) + 1) + 1)))
    found, counts = merged([take(i) for i in order[: len(order) - long].tolist()], least - long)
    for at in range(len(order) - long, len(order), PROBED):
        may = counts + (len(order) - at) >= least
        found, counts = found[may], counts[may]
        if not len(found):
            break
        counts = counts + probe(order[at : at + PROBED], found).sum(axis=0)
    return found[counts >= least], counts[counts >= least]


class InvertedLists:
    """Inverted lists of some sets; rows are in the order of their sizes, so that the sizes that may be alike are a range of rows."""

    def __init__(self, sets: list[np.ndarray], percent: float):
        self.percent = percent
        self.order = np.argsort([len(x) for x in sets], kind="stable")
        self.sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        flat = np.concatenate([sets[i] for i in self.order])
        by = np.argsort(flat, kind="stable")
        self.rows = np.repeat(np.arange(len(sets)), self.sizes)[by]
        self.shingles, self.starts, self.lengths = np.unique(flat[by], return_index=True, return_counts=True)
        #: All lists end to end, each entry with its list: in ascending order.
        self.entries = np.repeat(np.arange(len(self.shingles)), self.lengths) * len(sets) + self.rows

    def alike(self, own: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Positions (in the list of sets) of the open ones that are alike to the set `own`."""
        least = int(-(-self.percent * len(own) // 100))
        a = np.searchsorted(self.sizes, least)
        b = np.searchsorted(self.sizes, len(own) * 100 // self.percent, "right")
        if not open_[self.order[a:b]].any():
            return np.empty(0, np.int64)
        at = np.searchsorted(self.shingles, own)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == own]
        starts, ends = self.starts[at], self.starts[at] + self.lengths[at]

        def take(i: int) -> np.ndarray:
            x = self.rows[starts[i] : ends[i]]
            return x[np.searchsorted(x, a) : np.searchsorted(x, b)] if a > 0 or b < len(self.sizes) else x

        def probe(which: np.ndarray, found: np.ndarray) -> np.ndarray:
            wanted = at[which][:, None] * len(self.order) + found[None, :]
            place = np.searchsorted(self.entries, wanted)
            place[place == len(self.entries)] = 0
            return self.entries[place] == wanted

        found, overlap = divide_skip(self.lengths[at], take, probe, least)
        enough = 100 * overlap >= self.percent * (len(own) + self.sizes[found] - overlap)
        where = self.order[found[enough]]
        return where[open_[where]]


def forest(sets: list[np.ndarray], percent: float) -> list[tuple[int, int]]:
    """(query, found) links that connect all alike sets: a found set leaves the lists and is a query in turn."""
    here, links, todo = np.arange(len(sets)), [], []
    lists, open_ = InvertedLists(sets, percent), np.ones(len(sets), bool)
    for start in range(len(sets)):
        todo = [start] if open_[start] else []
        open_[start] = False
        while todo:
            left = open_[here]
            if 2 * left.sum() < len(here):  # lists of what is left
                here = here[left]
                if not len(here):
                    break
                lists = InvertedLists([sets[i] for i in here], percent)
                left = open_[here]
            query = todo.pop()
            for i in here[lists.alike(sets[query], left)].tolist():
                open_[i] = False
                links.append((query, i))
                todo.append(i)
    return links


def _rows_of(members: pa.Scalar) -> tuple[pa.StructArray, list[np.ndarray]]:
    """The rows of a group, and their sets."""
    rows = members.values
    shingles = rows.field("shingles")
    flat, ends = shingles.flatten().to_numpy(zero_copy_only=False), np.cumsum(shingles.value_lengths().to_numpy(zero_copy_only=False))
    return rows, np.split(flat, ends[:-1])


def _numbers(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False)


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], EDGES.names)


def _within(batches: Iterator[pa.RecordBatch], percent: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links inside each group."""
    for batch in batches:
        for members in batch.column(0):
            rows, sets = _rows_of(members)
            ids = _numbers(rows, "cid").tolist()
            links = forest(sets, percent)
            yield _pairs([ids[q] for q, _ in links], [ids[f] for _, f in links])


def _across(batches: Iterator[pa.RecordBatch], percent: float) -> Iterator[pa.RecordBatch]:
    """For each query of a group a link to every other component (as far as known) that holds an alike set of the group's part."""
    for batch in batches:
        for members in batch.column(0):
            rows, sets = _rows_of(members)
            ids, component, asks = (_numbers(rows, c) for c in ("cid", "component", "asks"))
            part, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(part) or not len(queries):
                continue
            lists, a, b = InvertedLists([sets[i] for i in part], percent), [], []
            for q in queries:
                found = part[lists.alike(sets[q], component[part] != component[q])]
                for i in found[np.unique(component[found], return_index=True)[1]]:
                    a.append(ids[q])
                    b.append(ids[i])
            yield _pairs(a, b)


def _searched(members: DataFrame, sets: DataFrame, group: list[str], f: Callable, percent: float) -> DataFrame:
    """Links from members (group columns, cid, ...) of each group, with their sets."""
    carried = [c for c in members.columns if c not in group]
    gathered = members.join(sets, "cid").groupBy(*group).agg(F.collect_list(F.struct(*carried, "shingles")).alias("members"))
    return shared.materialise(gathered.select("members").mapInArrow(partial(f, percent=percent), EDGES), "links")


def forest_links(members: DataFrame, sets: DataFrame, group: list[str], percent: float) -> DataFrame:
    """A spanning forest of the links inside each group of members (group columns, cid); a group is held by one task."""
    return _searched(members, sets, group, _within, percent)


def _grown(blocks: DataFrame, links: list[DataFrame]) -> DataFrame:
    """blocks with each set's component by the links so far."""
    found = components(reduce(DataFrame.unionByName, links))
    return shared.materialise(
        blocks.join(found, blocks["cid"] == found["node"], "left").select(blocks["*"], F.coalesce("root", "cid").alias("component")), "grown"
    )


def block_links(
    blocks: DataFrame, sets: DataFrame, percent: float, part_rows: int, part_shingles: int, known: tuple[DataFrame, ...] = ()
) -> list[DataFrame]:
    """Links (a, b: cids) that connect all alike sets of each block, after those known.

    blocks: block, cid, n (its size), a set in any number of blocks; sets: cid, shingles. Parts
    hold about part_rows sets and part_shingles shingles.
    """
    parts: Column = F.ceil(F.greatest(F.count("*") / part_rows, F.sum("n") / part_shingles)).cast("int")
    per = shared.materialise(blocks.groupBy("block").agg(F.count("*").alias("n"), parts.alias("parts")), "blocks")
    dealt = shared.join_skewed(blocks.select("block", "cid"), per, "block")
    dealt = shared.materialise(dealt.select("block", "cid", "parts", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part")), "dealt")
    own = forest_links(dealt.select("block", "part", "cid"), sets, ["block", "part"], percent)
    links = [*known, own]
    large = dealt.where("parts > 1")
    if large.isEmpty():
        return links

    def ask(asked: DataFrame, grown: DataFrame) -> DataFrame:
        """Links from the queries (block, part, cid, component) to sets of other components in those parts."""
        members = grown.select("block", "part", "cid", "component", F.lit(False).alias("asks")).unionByName(asked.withColumn("asks", F.lit(True)))
        return _searched(members, sets, ["block", "part"], _across, percent)

    # A copy that isn't alike to other copies is alike to what it was copied from: that one has many links.
    degrees = own.groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("degree"))
    best = large.where(F.col("part") < HUBS).join(degrees, "cid").groupBy("block", "part").agg(F.max(F.struct("degree", "cid"))["cid"].alias("cid"))
    grown = _grown(large, links)
    hubs = grown.join(best.select("cid"), "cid", "left_semi")
    links.append(ask(hubs.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "component"), grown))
    grown = _grown(large, links)
    most = grown.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.sum("n").alias("n"))
    outside = shared.join_skewed(grown, shared.materialise(most, "largest"), "block").where("component <> largest")
    links.append(ask(_reachable(outside.select("block", "cid", "component"), grown, sets, percent), grown))
    return links


def _reachable(outside: DataFrame, grown: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    """block, part, cid, component: the parts in which a set of another component may be alike to a set outside.

    A partner shares at least T of a set's n elements, and so one of any n - T + 1 of them: of
    those in the fewest parts. Parts where only the set's own component holds these are left out.
    """
    held = grown.select("block", "part", "component", "cid").join(sets, "cid").select("block", "part", "component", F.explode("shingles").alias("s"))
    held = held.groupBy("block", "s", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    held = shared.materialise(held, "vocabulary")
    spread = held.groupBy("block", "s").agg(F.count("*").alias("spread"))
    own = outside.join(sets, "cid").select("block", "cid", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(spread, ["block", "s"])
    rank = F.row_number().over(Window.partitionBy("block", "cid").orderBy("spread", "s"))
    first = own.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    near = first.select("block", "cid", "component", "s").join(held, ["block", "s"]).where("lo <> component OR hi <> component")
    return near.select("block", "part", "cid", "component").distinct()
