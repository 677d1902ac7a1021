import hashlib
import json
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import chat, mixing, shared, token_counts, tokens

TEXTS = [(1, "a b c"), (2, None), (3, ""), (None, "x"), (4, "a<|endoftext|>b"), (4, "a<|endoftext|>b"), (5, "long text " * 3000)]


# ---------------------------------------------------------------- token counts


@pytest.mark.parametrize("block", [1, 7, 1000, 1 << 22])
def test_counts_of_documents(spark, block):
    docs = spark.createDataFrame([(*t, "e") for t in TEXTS[: 6 if block < 1000 else 7]], "doc_id long, text string, file string").repartition(2)
    got = token_counts.document_token_counts(docs, block=block).collect()
    paths = tokens.vocabulary_paths()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(r.doc_id, len(tokens.encode(r.text, False, *paths))) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ids", [[], [9], [1, 2], [1, 9, 9, 2, 3, 9], [9, 9, 4], [1] * 50 + [9]])
@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_scan_is_a_split(spark, tmp_path, ids, block):
    path = tmp_path / "t.u16"
    path.write_bytes(np.array(ids, "<u2").tobytes())
    files = spark.createDataFrame([(f"file://{path}", len(ids))], "file string, n_ids long")
    got = sorted((r.ordinal, r.start, r.n_tokens) for r in token_counts.count_tokens(files, 9, block=block).collect())
    want, start = [], 0
    for i, x in enumerate(ids):
        if x == 9:
            want.append((len(want), start, i - start))
            start = i + 1
    if start < len(ids):
        want.append((len(want), start, len(ids) - start))
    assert got == want


def test_no_documents(spark):
    assert token_counts.document_token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---------------------------------------------------------------- chat

PIECES = [*chat._CONTROLS, "\\", " ", "a", "[", "<", "s>", "/INST]", "[\\/INST]", "<\\s>", "\n", "é"]
texts = st.lists(st.sampled_from(PIECES), max_size=8).map("".join)
turns = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]", "a [SEP] b"]), texts), max_size=6)


@settings(max_examples=600, deadline=None)
@given(turns)
def test_round_trip(source):
    rendered = chat.round_trip(source)
    assert [(r, t) for r, t, _, _ in chat.parse(rendered)] == source
    for role, text, a, b in chat.parse(rendered):
        if role == "assistant":
            assert chat.unescape(rendered[a:b]) == text


@settings(max_examples=300, deadline=None)
@given(texts)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


def test_plain_text_is_not_escaped():
    assert chat.round_trip([("user", "a \\ b"), ("assistant", "[x] <y>")]) == "[INST] a \\ b [/INST] [x] <y></s>"


def test_bad_renderings():
    for text in ("x", "[INST] a", "[INST] a</s>", " a", "[ROLE] a [/ROLE]", "[INST][/INST]"):
        with pytest.raises(chat.GrammarError):
            chat.parse(text)


CONV = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] x"), (1, 2, "system", None), (1, 2, "system", None), (2, 1, "assistant", "b"),
    (2, None, "user", "first"), (None, 0, None, "t"), (3, 0, "user", "long " * 50_000), (3, 1, "assistant", "é" * 70_000),
]


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_digests(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    df = spark.createDataFrame([(*r, 1) for r in CONV], "conv_id long, turn long, role string, text string, n_turns int").repartition(3)
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    groups = {}
    for conv, turn, role, text in sorted(CONV, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        said = "".join(t for r, t in rows if r == "assistant")
        assert got[conv].n_turns == len(rows)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[conv].formatted_chars == len("<s>" + chat.round_trip(rows))


def test_format_blocks_join_up(spark):
    df = spark.createDataFrame(CONV, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        assert r.formatted.startswith("<s>") == (r.block == 0)
        assert all(a <= b <= len(r.formatted) for a, b in r.loss_spans)
    assert chat.format_conversations(df.limit(0)).collect() == [] and chat.conversation_digests(df.limit(0)).collect() == []


# ---------------------------------------------------------------- mixing


def test_targets():
    sizes = {"a": 100, "b": 100, None: 100, "c": 1000}
    got = mixing.targets(sizes, 1300, (3, 1, 2), Fraction(3, 2), 2)
    # a weighs 3, b 1, c 2, null 3: a and null are over twice their size, then b is.
    assert got == {"a": 200, None: 200, "b": 200, "c": 1350}
    assert mixing.targets({"a": 0}, 0, (3,), Fraction(3, 2), 2) == {"a": 0}
    assert mixing.targets({"a": 10, "b": 10}, 20, (3, 1), Fraction(1), 2) == {"a": 15, "b": 5}


def test_flow_overlap():
    a, b, ab = frozenset("a"), frozenset("b"), frozenset("ab")
    got = mixing.route({a: 10, b: 10, ab: 10}, {"a": Fraction(15), "b": Fraction(15)}, 2)
    assert sum(got.values()) == 30 and all(x == 10 for x in got.values())
    got = mixing.route({a: 10, ab: 10}, {"a": Fraction(10), "b": Fraction(15)}, 2)
    assert got == {a: 10, ab: 15}
    got = mixing.route({ab: 10}, {"a": Fraction(30), "b": Fraction(30)}, 2)
    assert got == {ab: 20}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.frozensets(st.sampled_from("abcd"), min_size=1), st.integers(0, 20), min_size=1), st.lists(st.integers(0, 30), min_size=4, max_size=4))
def test_flow_is_feasible_and_full(patterns, quotas):
    wanted = {n: Fraction(q) for n, q in zip("abcd", quotas) if any(n in p for p in patterns)}
    got = mixing.route(patterns, wanted, 2)
    assert all(0 <= got[p] <= 2 * patterns[p] for p in patterns)
    # By max-flow min-cut the flow is the least over all sets of sources left on the sink's side.
    from itertools import combinations

    names = list(wanted)
    cuts = []
    for k in range(len(names) + 1):
        for cut in combinations(names, k):
            cuts.append(sum(wanted[n] for n in cut) + sum(2 * s for p, s in patterns.items() if p - set(cut)))
    assert sum(got.values()) == min(cuts)


@settings(max_examples=80, deadline=None)
@given(
    st.dictionaries(st.frozensets(st.sampled_from("abc"), min_size=1), st.integers(0, 3), min_size=1, max_size=4),
    st.lists(st.integers(0, 6), min_size=3, max_size=3),
    st.integers(1, 3),
)
def test_flow_has_least_cost(patterns, quotas, copies):
    from itertools import combinations, product

    wanted = {n: Fraction(q) for n, q in zip("abc", quotas) if any(n in p for p in patterns)}
    got = mixing.route(patterns, wanted, copies)
    sets = [set(c) for k in range(len(wanted) + 1) for c in combinations(wanted, k)]

    def cost(taken):
        # The k-th copy of a word costs k.
        return sum(k * min(max(taken[p] - (k - 1) * patterns[p], 0), patterns[p]) for p in patterns for k in range(1, copies + 1))

    def fits(taken):
        return all(sum(t for p, t in taken.items() if p <= s) <= sum(wanted[n] for n in s) for s in sets)

    every = [dict(zip(patterns, t)) for t in product(*(range(copies * n + 1) for n in patterns.values()))]
    fitting = [t for t in every if fits(t)]
    most = max(sum(t.values()) for t in fitting)
    assert fits(got) and sum(got.values()) == most
    assert cost(got) == min(cost(t) for t in fitting if sum(t.values()) == most)


def test_flow_of_many_patterns_and_of_fractions():
    from itertools import combinations
    from time import perf_counter

    names = [f"s{i}" for i in range(60)]
    patterns = {frozenset(c): 3 + len(c) for k in (1, 2, 3) for c in combinations(names, k)}
    wanted = {n: Fraction(10**6, 7) for n in names}
    start = perf_counter()
    got = mixing.route(patterns, wanted, 2)
    assert perf_counter() - start < 60 and len(got) == 36_050
    assert all(got[p] == 2 * n for p, n in patterns.items())
    assert mixing.route({frozenset("a"): 10}, {"a": Fraction(44, 3)}, 2) == {frozenset("a"): Fraction(44, 3)}


def test_single_sources_go_through_the_flow(spark, monkeypatch):
    parts = []
    flow = mixing._min_cost_flow
    monkeypatch.setattr(mixing, "_min_cost_flow", lambda part, *a: parts.append(part) or flow(part, *a))
    mixing.mix_sources(spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (3, "c", None)], "doc_id long, text string, source string"))
    assert len(parts) == 3


def test_overlapping_sources_on_a_table(spark):
    rows = [(i, words(1 + i % 5), [x for x, m in (("a", 2), ("b", 3), ("c", 5)) if i % m == 0] or ["d"]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sources array<string>")
    chosen, sizes, wanted, keys = mixing.mix(docs, F.col("sources"))
    patterns, taken = {}, {}
    for (_, t, s), r in zip(rows, sorted(chosen.taken().collect(), key=lambda r: r.doc_id)):
        patterns[frozenset(s)] = patterns.get(frozenset(s), 0) + r.size
        taken[frozenset(s)] = taken.get(frozenset(s), 0) + r.taken
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size
    flow = mixing.route(patterns, wanted, 2)
    assert set(keys) == set(patterns) and all(0 <= flow[p] - taken[p] < 5 for p in patterns)
    assert sizes == {n: sum(x for p, x in patterns.items() if n in p) for n in "abcd"}


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, words(1 + i % 9) + f" u{i}", "a") for i in range(400)] + [(7, words(2 + i % 9) + f" v{i}", "ab"[i % 2]) for i in range(400)]
    rows += [(8, words(500), "a"), (9, words(3), "b"), (9, words(3), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(str, mixing.mix_sources(docs.repartition(5)).collect()))
    assert first == sorted(map(str, mixing.mix_sources(docs.repartition(2)).collect())) and len(first) == len(rows)
    chosen, *_ = mixing.mix(docs, F.array("source"))
    # Rows without a doc_id and rows of one doc_id are dealt to many buckets.
    assert min(r.n for r in chosen.rows.groupBy("doc_id").agg(F.count_distinct("_bucket").alias("n")).where("doc_id is null or doc_id = 7").collect()) > 30
    want = {"a": 0, "b": 0}
    for r in chosen.taken().collect():
        want[json.loads(r.pattern)[0]] += r.taken
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    wanted = mixing.targets(sizes, sum(sizes.values()), (3, 1, 2), Fraction(3, 2), 2)
    assert all(0 <= wanted[s] - want[s] < 12 for s in "ab")


def words(n):
    return " ".join(["w"] * n)


MIX = [(i, words(1 + i % 7), "src%d" % (i % 3)) for i in range(300)] + [(900, None, "src0"), (901, "", None), (902, words(5), None), (903, words(5), None), (904, " \t", "only")]


def test_mix(spark):
    docs = spark.createDataFrame([(*r, 9) for r in MIX], "doc_id long, text string, source string, taken int").repartition(4)
    got = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(MIX)
    sizes = {}
    for _, t, s in MIX:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    wanted = mixing.targets(sizes, sum(sizes.values()), (3, 1, 2), Fraction(3, 2), 2)
    source_of = {i: s for i, _, s in MIX}
    taken = {}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(wanted[s])) < 1e-6
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0 and r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - float(wanted[s])) <= (5 if s is None else 1)


def test_mixed_rows(spark):
    docs = spark.createDataFrame(MIX, "doc_id long, text string, source string")
    out = mixing.mixed_rows(docs.repartition(3))

    assert out.columns == docs.columns
    sizes, got = {}, {}
    for _, t, x in MIX:
        sizes[x] = sizes.get(x, 0) + len((t or "").split())
    wanted = mixing.targets(sizes, sum(sizes.values()), (3, 1, 2), Fraction(3, 2), 2)
    rows = out.collect()
    for r in rows:
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    assert all(abs(got.get(x, 0) - float(wanted[x])) <= 5 for x in sizes)
    assert max(sum(r.doc_id == i for r in rows) for i, _, _ in MIX) == 2


@pytest.mark.parametrize("seed", [6, 7])
def test_mix_fills_the_gap_before_a_very_long_document(spark, seed):
    rows = [(i, words(40), "s") for i in range(1500)] + [(2000 + i, words(30_000), "s") for i in range(2)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), seed=seed).collect()
    assert len(got) == len(rows) and all(r.taken in (r.size, 2 * r.size) for r in got)
    assert 0 <= got[0].target - sum(r.taken for r in got) < 40


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).collect() == [] and mixing.mixed_rows(docs).collect() == []


def test_pick_needs_exact_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "A"])
    assert shared.pick(df, "A").first()[0] == 2
    with pytest.raises(ValueError):
        shared.pick(df, "b")
