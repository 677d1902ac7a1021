import random
import re

import numpy as np
import pytest

from siftline.llm import jaccard_join as j
from siftline.llm import linking, shared


def plain_set(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def alike(a, b, percent=90):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def brute(rows, percent=90):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if alike(sets[a], sets[b], percent):
                parent[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {root: min((x for x in ids if x is not None), default=None) for root, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr)


def corpus(rng, groups, sizes=(3, 9, 10, 12, 20, 40, 100, 300)):
    """Groups of texts a few edits apart, many of them near 0.9, with a passage that many share."""
    passage = [f"p{i}" for i in range(60)]
    out = []
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.choice(sizes))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 50)):
                edit = rng.random()
                if edit < 0.4:
                    t[rng.randrange(len(t))] = f"z{rng.randint(0, 9)}"
                elif edit < 0.7 and len(t) > 1:
                    t.pop(rng.choice((0, -1)))
                else:
                    t += [f"n{i}" for i in range(rng.randint(1, 4))]
            out.append(" ".join(t))
    return out


def test_every_alike_pair_shares_a_key():
    rng, held, table = random.Random(1), j._Words(), j.bands(1 << 10)
    texts = corpus(rng, 150)
    sets = [plain_set(t) for t in texts]
    hashes = [j.shingle_set(t.encode(), held) for t in texts]
    assert [len(h) for h in hashes] == [len(s) for s in sets]
    keys = [{x for own in j.segment_keys(h, table) for x in own.tolist()} for h in hashes]
    seen = 0
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] != sets[b] and alike(sets[a], sets[b]):
                seen += 1
                assert keys[a] & keys[b]
    assert seen > 100


def test_bands_bound_the_difference():
    for low, partner, segments in j.bands(3000):
        for a in range(low, partner + 1):
            for b in range(a, min(partner, a * 100 // 90) + 1):
                if a * 100 // 90 >= b and a <= partner * 90 // 100 + 1:
                    # The most that sets of these sizes may differ in, if a is of the band.
                    most = max((d for d in range(b - a, a + b + 1, 2) if 100 * (a + b - d) >= 90 * (a + b + d)), default=-1)
                    assert most < segments or a > int(max(low, int(low * j.BAND)))
        if low > 400:
            break


@pytest.mark.parametrize("entries", [0, 4096])
def test_divide_skip_counts_occurrences(monkeypatch, entries):
    monkeypatch.setattr(linking, "HEAP_ENTRIES", entries)
    rng = random.Random(2)
    for _ in range(400):
        lists = [np.array(sorted(rng.sample(range(30), rng.randint(0, 20))), np.int64) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(np.concatenate(lists), minlength=30)
        for least in range(1, 11):
            lengths, held = np.array([len(x) for x in lists]), lambda which, found: np.array([np.isin(found, lists[i]) for i in which])
            for found, of in (linking.merged(lists, least), linking.divide_skip(lengths, lists.__getitem__, held, least)):
                assert found.tolist() == np.flatnonzero(counts >= least).tolist() and of.tolist() == counts[counts >= least].tolist()


@pytest.mark.parametrize("entries", [0, 4096])
def test_inverted_lists_find_what_is_alike(monkeypatch, entries):
    monkeypatch.setattr(linking, "HEAP_ENTRIES", entries)
    held = j._Words()
    texts = [t for t in corpus(random.Random(4), 40)]
    sets, hashes = [plain_set(t) for t in texts], [j.shingle_set(t.encode(), held) for t in texts]
    lists = linking.InvertedLists(hashes, 90)
    for q in range(len(texts)):
        assert set(lists.alike(hashes[q], np.ones(len(texts), bool)).tolist()) == {i for i in range(len(texts)) if alike(sets[q], sets[i])}
    links = linking.forest(hashes, 90)
    assert all(alike(sets[a], sets[b]) for a, b in links) and len({b for _, b in links}) == len(links)


ROWS = [
    (1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (None, "one two three"), (None, "alone by itself here"), (7, "É one two"), (8, "é one two"),
    (9, "x " * 100_000), (9, "x " * 100_000), (10, "X " * 50), (11, "one two three"), (2, "one two"), (12, "\x1f a b"), (13, "\x85 a b c"),
]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, n int, key int").repartition(3)


def joined(spark, rows, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_components(docs(spark, rows), **options).collect()), key=repr)


def test_rows_of_every_kind(spark):
    assert joined(spark, ROWS) == brute(ROWS)
    assert j.jaccard_components(docs(spark, ROWS).limit(0)).collect() == []


def test_components_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    rows = list(enumerate(corpus(rng, 120)))
    rng.shuffle(rows)
    assert joined(spark, rows) == brute(rows)


def test_large_blocks_are_dealt(spark, monkeypatch):
    """Copies of one text that are alike to it and not to each other, chains, and copies of copies, in blocks of many parts."""
    rng = random.Random(6)
    rows, hub = [], [f"w{i}" for i in range(120)]
    rows.append((500, " ".join(hub)))
    for i in range(60):  # 0.95 from the hub, 0.90 or less from each other
        t = list(hub)
        t[rng.randrange(120)] = f"e{i}"
        rows.append((i, " ".join(t)))
    chain = [f"c{i}" for i in range(110)]
    for i in range(40):
        rows.append((600 + i, " ".join(chain)))
        chain = chain[2:] + [f"d{i}", f"f{i}"]
    rows += [(700 + i, t) for i, t in enumerate(corpus(rng, 20))]
    rng.shuffle(rows)
    want = brute(rows)
    monkeypatch.setattr(j, "PART_ROWS", 7)
    monkeypatch.setattr(j, "BROADCAST_IDS", 0)
    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    monkeypatch.setattr(shared, "HOT_KEYS", 20)
    assert joined(spark, rows) == want


def test_other_thresholds(spark):
    rows = list(enumerate(corpus(random.Random(7), 30)))
    assert joined(spark, rows, percent=70) == brute(rows, 70)
