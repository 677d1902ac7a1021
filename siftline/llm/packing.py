"""Best-fit packing with linear grouping.

The plan is made on the histogram of piece lengths, which has at most `capacity` rows
whatever the corpus size, so only that histogram reaches the driver:

1. large lengths are sorted and cut into groups of equal cardinality, each rounded up to
   its largest member (linear grouping);
2. the few rounded sizes are packed by configurations: a configuration linear programme,
   solved by column generation with a knapsack as the pricing step, rounded down;
3. actual lengths take the rounded slots, longest first in each group;
4. what rounding left over and all small pieces go in by best fit, longest first;
5. while sequences exceed total tokens / capacity, fewer of the combinations that came out
   full are kept, and the pieces of all other sequences are packed anew by best fit.

Pieces of one length are interchangeable, so the plan is a short list of runs "pieces
[a, b) of length L go to sequences s.. at offset o". Executors number the pieces of each
length (counts per hash bucket, prefix sums, row numbers within a bucket) and look their
place up. No row depends on another's place, and no task sees a whole length class.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, tokens

CAPACITY = 2048
#: Pieces numbered together within one length class.
ROWS_PER_BUCKET = 50_000
#: (a piece over capacity / this is large, number of groups), tried in turn until one reaches total tokens / capacity.
GROUPINGS = ((3, 64), (4, 64), (8, 32), (2, 32))
#: How often the kept combinations of a grouping are halved.
KEPT_HALVINGS = 7

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


# ---------------------------------------------------------------- plan on the histogram


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[float, list[int]]]:
    """The configuration LP: how often each combination of sizes is used, fractions allowed.

    Minimise the sum of x over combinations a with sum(a_i * sizes_i) <= capacity, such that
    every size's demand is met. Columns are generated while a knapsack on the dual prices
    finds one worth more than a bin. Large sizes are few to a bin, so the knapsack goes by
    the number of pieces: the most worth of at most k pieces in each room.
    """
    n, size, need = len(sizes), np.array(sizes), np.array(demand, float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    left = np.arange(capacity + 1) - size[:, None]  # room left by size and room
    most = capacity // int(size.min())
    for _ in range(40 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        worth, choices = np.zeros(capacity + 1), []
        for _ in range(most):
            value = np.where(left >= 0, worth[np.maximum(left, 0)] + price[:, None], -1.0)
            choice = value.argmax(axis=0)
            better = value[choice, np.arange(capacity + 1)]
            choices.append(np.where(better > worth + 1e-12, choice, -1))
            worth = np.maximum(worth, better)
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for choice in reversed(choices):
            if (i := int(choice[room])) >= 0:
                column[i] += 1
                room -= int(size[i])
        x, d = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, need)
    return [(float(v), [int(a) for a in basis[:, j]]) for j, v in enumerate(x) if v > 1e-9]


def _take(queue: list[list[int]], n: int) -> list[tuple[int, int, int]]:
    """Up to n pieces from the front of a queue of [length, first, count] runs."""
    out = []
    while n and queue:
        length, first, count = queue[-1]
        m = min(n, count)
        out.append((length, first, m))
        n -= m
        if m == count:
            queue.pop()
        else:
            queue[-1] = [length, first + m, count - m]
    return out


class _Bins:
    """Open sequences in runs of equal fill, by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.next = capacity, [[] for _ in range(capacity + 1)], 0
        self.combined: list[tuple[int, int]] = []  # (first, number) of sequences opened by configurations of several pieces
        self.runs: list[tuple[int, int, int, int, int, int]] = []  # length, first, count, per bin, sequence, offset

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n

    def leave(self, sequence: int, n: int, used: int) -> None:
        if n and used < self.capacity:
            self.free[self.capacity - used].append((sequence, n))

    def put(self, length: int, first: int, count: int, sequence: int, bins: int, used: int) -> int:
        """Fill a run of equal bins with pieces of one length, each to the brim in turn; returns how many went in."""
        per = (self.capacity - used) // length
        full = min(bins, count // per)
        if full:
            self.runs.append((length, first, full * per, per, sequence, used))
            self.leave(sequence, full, used + per * length)
        rest = count - full * per if full < bins else 0
        if rest:
            self.runs.append((length, first + full * per, rest, rest, sequence + full, used))
            self.leave(sequence + full, 1, used + rest * length)
        self.leave(sequence + full + bool(rest), bins - full - bool(rest), used)
        return full * per + rest

    def best_fit(self, length: int, first: int, count: int) -> None:
        r = length
        while count:
            while r <= self.capacity and not self.free[r]:
                r += 1
            if r > self.capacity:
                n = -(-count // (self.capacity // length))
                count -= self.put(length, first, count, self.open(n), n, 0)
                assert not count
                return
            sequence, n = self.free[r].pop()
            done = self.put(length, first, count, sequence, n, self.capacity - r)
            first, count, r = first + done, count - done, length


def _grouped(histogram: dict[int, int], capacity: int, share: int, groups: int) -> _Bins:
    bins = _Bins(capacity)
    if n := histogram.get(capacity):
        bins.put(capacity, 0, n, bins.open(n), n, 0)
    rest = {s: n for s, n in sorted(histogram.items(), reverse=True) if s < capacity and n}
    large = [[s, 0, n] for s, n in rest.items() if s * share > capacity]
    left = [[s, 0, n] for s, n in rest.items() if s * share <= capacity]
    total = sum(n for _, _, n in large)
    if total:
        each, queue, sizes, demand, members = -(-total // groups), large[::-1], [], [], []
        while queue:
            got = _take(queue, each)
            sizes.append(got[0][0])  # rounded up to the longest of the group
            demand.append(sum(n for _, _, n in got))
            members.append([list(x) for x in reversed(got)])
        for x, counts in sorted(configurations(sizes, demand, capacity), key=lambda c: -c[0]):
            times = int(x + 1e-6)
            slots = [_take(members[i], times) for i, a in enumerate(counts) for _ in range(a)] if times else []
            if not slots:
                continue
            sequence = bins.open(times)
            bins.combined += [(sequence, times)] * (sum(counts) > 1)
            cuts = sorted({0, times} | {sum(n for _, _, n in s[: j + 1]) for s in slots for j in range(len(s))})
            place = [(0, list(s)) for s in slots]
            for a, b in zip(cuts, cuts[1:]):
                used = 0
                for j, (at, segments) in enumerate(place):
                    if not segments:
                        continue
                    length, first, n = segments[0]
                    bins.runs.append((length, first + a - at, b - a, 1, sequence + a, used))
                    used += length
                    if at + n == b:
                        place[j] = (b, segments[1:])
                bins.leave(sequence + a, b - a, used)
        left += [x for m in members for x in m]
    for length, first, n in sorted(left, key=lambda x: (-x[0], x[1])):
        bins.best_fit(length, first, n)
    return bins


def _cover(spans: list[tuple[int, int]], first: int, n: int) -> Iterator[tuple[int, int, bool, int]]:
    """[first, first + n) cut at the ends of the disjoint sorted spans: (from, to, whether in one, how many before `from` are in one)."""
    at, end = first, first + n
    i = max(0, bisect_right(spans, (first, end)) - 1)
    before = sum(min(b, first) - a for a, b in spans[:i])
    while at < end:
        while i < len(spans) and spans[i][1] <= at:
            before += spans[i][1] - spans[i][0]
            i += 1
        inside = i < len(spans) and spans[i][0] <= at
        to = min(end, spans[i][inside] if i < len(spans) else end)
        yield at, to, inside, before + (at - spans[i][0] if inside else 0)
        at = to


def _full_combinations(bins: _Bins) -> list[tuple[int, int]]:
    """(first, number) of the sequences that configurations of several pieces opened and that came out full."""
    gaps = sorted((s, s + n) for runs in bins.free for s, n in runs)
    return [(a, b - a) for first, n in bins.combined for a, b, inside, _ in _cover(gaps, first, n) if not inside]


def _repacked(bins: _Bins, kept: list[tuple[int, int]]) -> _Bins:
    """The sequences in kept (first, number) as they are, and the pieces of all others packed anew by best fit, longest first."""
    out, spans = _Bins(bins.capacity), sorted((a, a + n) for a, n in kept)
    out.next, loose = sum(n for _, n in kept), []
    for length, first, count, per, sequence, offset in bins.runs:
        for a, b, inside, before in _cover(spans, sequence, -(-count // per)):
            start = first + (a - sequence) * per
            n = min(first + count, first + (b - sequence) * per) - start
            if inside:
                out.runs.append((length, start, n, per, before, offset))
            else:
                loose.append((length, start, n))
    out.combined = [(0, out.next)]
    for length, first, n in sorted(loose, key=lambda x: (-x[0], x[1])):
        out.best_fit(length, first, n)
    return out


def _attempts(histogram: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, int], _Bins]]:
    """(grouping, sequences): each grouping as it is, then with fewer and fewer of its combinations and best fit for the rest.

    Rounding leaves gaps, and combinations that are all kept use up the small pieces that
    fill them; with fewer kept, best fit finds them in longer ones' place.
    """
    for grouping in GROUPINGS:
        made = _grouped(histogram, capacity, *grouping)
        yield grouping, made
        full = _full_combinations(made)
        for halvings in range(KEPT_HALVINGS):
            if kept := [(a, n >> halvings) for a, n in full if n >> halvings]:
                yield grouping, _repacked(made, kept)


class Plan(NamedTuple):
    """runs: rows of (length, first piece, pieces, pieces per sequence, sequence, offset), sorted by length and first piece."""

    runs: np.ndarray
    sequences: int
    #: The grouping that made it, and how many sequences its configurations of several pieces opened.
    grouping: tuple[int, int]
    combined: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for counts by length (1..capacity): of all attempts the one with the fewest sequences, of equal ones the first.

    Attempts end only at the lower bound, which no plan can beat. The last grouping's
    configurations are single pieces, so that what is tried includes best fit, longest first.
    """
    total = sum(s * n for s, n in histogram.items())
    bound, best, made = -(-total // capacity), _Bins(capacity), GROUPINGS[0]
    for grouping, tried in _attempts(histogram, capacity) if total else ():
        if not best.runs or tried.next < best.next:
            best, made = tried, grouping
        if best.next == bound:
            break
    return Plan(np.array(sorted(best.runs), np.int64).reshape(-1, 6), best.next, made, sum(n for _, n in best.combined))


# ---------------------------------------------------------------- on the executors


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else the remainder first, then full pieces."""
    head = n if n <= capacity else n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def _tokenise(batches: Iterator[pa.RecordBatch], capacity: int, json_path: str, ranks_path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = tokens.encode(text.as_py(), True, json_path, ranks_path)
            raw = np.append(ids, np.uint32(0)).astype("<u4")
            out += [
                (doc_id, i, s, n, zlib.crc32(raw[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(len(raw), capacity))
            ]
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], PIECES.names)


def _lookup(batches: Iterator[pa.RecordBatch], runs) -> Iterator[pa.RecordBatch]:
    length, first, _, per, sequence, offset = runs.value.T
    key = length * (1 << 44) + first
    for batch in batches:
        own, ordinal = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "ordinal"))
        at = np.searchsorted(key, own * (1 << 44) + ordinal, "right") - 1
        j = ordinal - first[at]
        arrays = [batch.column(c) for c in PIECES.names]
        arrays += [pa.array(sequence[at] + j // per[at]), pa.array(offset[at] + j % per[at] * own)]
        yield pa.RecordBatch.from_arrays(arrays, [*PIECES.names, "sequence_id", "offset"])


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    shared.ship(docs.sparkSession)
    json_path, ranks_path = tokens.vocabulary_paths()
    f = partial(_tokenise, capacity=capacity, json_path=json_path, ranks_path=ranks_path)
    return shared.pick(docs, "doc_id", "text").mapInArrow(f, PIECES)


def place(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a materialised table of pieces."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    runs = plan(histogram, capacity).runs
    buckets = max(64, sum(histogram.values()) // ROWS_PER_BUCKET)
    tie = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cuts.withColumn("bucket", F.pmod(tie, F.lit(buckets)).cast("int"))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.join(base, ["length", "bucket"]).select(
        *PIECES.names, (F.col("base") + F.row_number().over(within) - 1).alias("ordinal")
    )
    schema = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(partial(_lookup, runs=spark.sparkContext.broadcast(runs)), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document's tokens plus a closing id 0 into sequences of at most `capacity`.

    Input: doc_id, text (other columns are ignored). Output, one row per piece: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are the
    closing id alone. A null doc_id is a document like any other. Repeated rows are packed
    each. An empty table gives no rows. Only texts over the capacity are cut.
    """
    return place(shared.materialise(pieces(docs, capacity), "pieces"), capacity)
