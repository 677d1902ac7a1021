import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from siftline.llm import shared
from siftline.llm import simhash as s


def plain_fingerprint(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB É\t\x0b\x1f ", max_size=30))
def test_fingerprint(text):
    assert s.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    want = plain_fingerprint(text)
    monkeypatch.setattr(s, "CHUNK", 7)
    assert s.fingerprint(text) == want
    assert s.fingerprint(None) == s.fingerprint(" \t") == 0


def test_masks_cover_every_pair_of_bits():
    masks = s.masks(2)
    assert len(masks) == 7
    for pair in combinations(range(64), 2):
        diff = sum(1 << b for b in pair)
        assert any(m & diff == 0 for m in masks)
    assert min(m.bit_count() for m in masks) >= 32


def union(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("bucket", [128, 2])
def test_links_are_all_pairs(spark, bucket):
    rng, values = random.Random(3), set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    for _ in range(10):
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = {s._signed(v): v for v in values}
    nodes = spark.createDataFrame([(k,) for k in signed], "fp long")
    got = {r.node: r.root for r in s.components(s.links(nodes, 2, bucket)).collect()}
    want = union(signed, [(a, b) for a, b in combinations(signed, 2) if (signed[a] ^ signed[b]).bit_count() <= 2])
    assert {k: got.get(k, k) for k in signed} == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e} - {300}
    assert got == union(nodes, [e for e in edges if e[0] != e[1]])


def test_odd_radius(spark):
    with pytest.raises(ValueError):
        s.links(spark.createDataFrame([(1,)], "fp long"), 3)


def near(text, rng, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(7)
    rows = []
    for i in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400])))
        rows.append((i, base))
        for j in range(rng.randint(0, 3)):
            rows.append((1000 + 10 * i + j, near(base, rng, rng.choice([1, 2, 6, 40]))))
    shared_text = " ".join(f"p{i}" for i in range(60))
    rows += [(2000 + i, shared_text + " " + " ".join(f"u{rng.randrange(9999)}" for _ in range(80))) for i in range(20)]
    return [*rows, (3000, None), (3001, ""), (3002, "one"), (3003, "One"), (None, rows[0][1]), (0, rows[0][1]), (3004, "long word " * 30_000)]


def test_near_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int").repartition(3)
    got = s.near_copies(docs).collect()
    assert len(got) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(plain_fingerprint(t), []).append(i)
    roots = union(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    lowest = {}
    for p, ids in prints.items():
        lowest.setdefault(roots[p], []).extend(x for x in ids if x is not None)
    want = Counter((i, f"{p:016x}", min(lowest[roots[p]], default=None)) for p, ids in prints.items() for i in ids)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("rest", [1024, 3])
def test_drop_near_copies_is_brute_force(spark, monkeypatch, rest):
    monkeypatch.setattr(s, "REST", rest)
    rows = corpus()
    docs = spark.createDataFrame([(t, i, 5) for i, t in rows], "text string, doc_id long, rid int").repartition(3)
    sets = [shingles(t) for _, t in rows]
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = {}
    for i, root in union(range(len(rows)), pairs).items():
        groups.setdefault(root, []).append(i)
    want = Counter()
    for members in groups.values():
        i = min(members, key=lambda m: (rows[m][0] is None, rows[m][0] or 0))
        want[rows[i][0]] += 1
    out = s.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == want


@pytest.mark.parametrize("hub", [120])
def test_links_to_rows_that_leave_a_large_bucket(spark, monkeypatch, hub):
    # One bucket of a hub and over REST copies, each alike to the hub and to no other copy.
    monkeypatch.setattr(s, "REST", 128)
    rng, rows, sets = random.Random(11), [], []
    for c in range(200):
        words = [f"w{i}" for i in range(300)]
        for e in range(6 if c != hub else 0):
            words[50 * e + 5 + rng.randrange(40)] = f"c{c}e{e}"
        hashes = s.shingle_hashes(" ".join(words), 5)
        sets.append(set((hashes >> np.uint64(32)).tolist()))
        rows.append((c, c, [7], np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32).tolist()))
    pairs = [(a, b) for a, b in combinations(range(200), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(pairs) == {(min(hub, c), max(hub, c)) for c in range(200) if c != hub}
    found = s.similar_links(spark.createDataFrame(rows, s._FEATURES).repartition(3), 0.8)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()} == set(pairs)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert s.near_copies(docs).collect() == [] and s.drop_near_copies(docs).collect() == []


def test_jaccard_of_samples():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:889], rng.integers(0, 1 << 63, 111, dtype=np.uint64)])
    _, x = s.bucket_keys(a, s.masks(2))
    _, y = s.bucket_keys(b, s.masks(2))
    assert 0.6 < (x == y).mean() < 0.95


def bucket_of(texts):
    """Features of texts that share one bucket and no other."""
    rows, sets = [], []
    for i, words in enumerate(texts):
        hashes = s.shingle_hashes(" ".join(words), 5)
        own = np.unique((hashes >> np.uint64(32)).astype(np.uint32)).view(np.int32)
        sets.append(set(own.tolist()))
        rows.append((i, i, [7], own.tolist()))
    return rows, sets


@pytest.mark.parametrize("rest", [1024, 3, 40])
def test_chains_in_one_large_bucket(spark, monkeypatch, rest):
    # Chains in which each row is alike to its neighbours only, in one bucket.
    monkeypatch.setattr(s, "REST", rest)
    texts = [[f"c{c}w{w}" for w in range(12 * i, 12 * i + 124)] for c in range(6) for i in range(12)]
    random.Random(4).shuffle(texts)
    rows, sets = bucket_of(texts)
    pairs = {(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(pairs) == 6 * 11
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in s.similar_links(spark.createDataFrame(rows, s._FEATURES).repartition(3), 0.8).collect()}
    assert found <= pairs and union(range(len(rows)), found) == union(range(len(rows)), pairs)


def test_parts_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(s, "GROUP_SHINGLES", 500)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(204)]
    texts = [[w if rng.random() > 0.004 else f"x{rng.random()}" for w in base] for _ in range(30)] + [[f"u{i}w{w}" for w in range(204)] for i in range(5)]
    rows, sets = bucket_of(texts)
    pairs = {(a, b) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in s.similar_links(spark.createDataFrame(rows, s._FEATURES), 0.8).collect()}
    assert found <= pairs and union(range(len(rows)), found) == union(range(len(rows)), pairs)


def test_hot_fingerprints_and_keys(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 4)
    rows = corpus() + [(5000 + i, "the same text here") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = {r.doc_id: r for r in s.near_copies(docs).collect()}
    assert len(plain) == len({i for i, _ in rows}) and all(plain[5000 + i].component_id == 5000 for i in range(60))
    kept = [r.doc_id for r in s.drop_near_copies(docs).collect()]
    assert [i for i in kept if i is not None and i >= 5000] == [5000]


def test_a_large_bucket_of_two_groups_ships_each_set_a_few_times(spark, monkeypatch):
    """50,000 rows in one bucket, in 25 parts: two groups whose members are alike to their group only."""
    from siftline.llm import linking

    monkeypatch.setattr(s, "REST", 2000)
    rng, rows = np.random.default_rng(9), []
    bases = [rng.integers(0, 1 << 30, 20), rng.integers(0, 1 << 30, 20)]
    for i in range(50_000):
        own = bases[i % 2].copy()
        own[rng.integers(0, 20)] = i
        rows.append((i, i, [7], sorted({int(x) for x in own})))
    shipped = []

    def counted(members, sets, group, f, percent, plain=linking._searched):
        shipped.append(members.count())
        return plain(members, sets, group, f, percent)

    monkeypatch.setattr(linking, "_searched", counted)
    found = {r.node: r.root for r in s.components(s.similar_links(spark.createDataFrame(rows, s._FEATURES).repartition(8), 0.8)).collect()}
    assert len(found) == 50_000 and len(set(found.values())) == 2 and all(found[i] == found[i % 2] for i in range(50_000))
    # Once with its part, once with the hubs, once for the rest: the smaller group's elements lie in no other component.
    assert sum(shipped) <= 3 * 50_000 + linking.HUBS * 25 + 5_000
