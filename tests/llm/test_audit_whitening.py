import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from siftline.llm import filter_audit as f
from siftline.llm import shared
from siftline.llm import whitening as w

# ---------------------------------------------------------------- filter interaction audit

LONG = "lorem ipsum dolor sit amet " * 50
ROWS = [
    (1, "a", LONG), (2, "a", LONG), (2, "b", LONG), (3, None, LONG), (4, "", None), (5, "b", ""), (6, "b", "short TEXT"), (7, "a", " ".join(f"w{i}" for i in range(300))),
    (8, "a", " ".join(f"w{i}" for i in range(300)) + " #"), (9, "b", "X" * 400_000), (None, "a", LONG), (None, "a", "no id"), (7, "a", " ".join(f"w{i}" for i in range(300))),
    (10, "c", "É" * 300 + " \x1f\x85 " + "B" * 8), (11, "c", "É" * 300 + " " + "B" * 5),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, 0, 1), (7, 1, None), (9, None, 1), (None, 1, 1), (77, 1, 1)]


def replayed(rows, labels):
    """Every order replayed on every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, source, text in rows:
        text = text or ""
        words = [x for x in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if x]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows),
        }
        docs.append((source or "", {x for x, bad in fails.items() if bad}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in own) - len(gone)
                left = [d for d in left if x not in d[1]]
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, x] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def tables(spark, rows=ROWS, labels=LABELS):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, mask int, digest int").repartition(3)
    return docs, spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")


def audit(spark, rows=ROWS, labels=LABELS):
    names = ("part", "filter_order", "step", *f.COUNTS, "shapley")
    return {tuple(r[n] for n in names[:3]): tuple(r[n] for n in names[3:]) for r in f.audit_orders(*tables(spark, rows, labels)).select(*names).collect()}


def test_audit_replays_every_order(spark):
    assert audit(spark) == replayed(ROWS, LABELS)


def test_audit_with_hot_texts_and_no_labels(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    assert audit(spark, labels=[]) == replayed(ROWS, [])


def test_audit_of_nothing(spark):
    docs, labels = tables(spark)
    assert f.audit_orders(docs.limit(0), labels).collect() == []


def test_lattice():
    assert len(f.lattice(5)) == 80 == len(set(f.lattice(5)))
    assert len(f.paths()) == 600 and {x[2:] for x in f.paths()} == set(f.lattice(5))
    weights = Counter(x[2:] for x in f.paths())
    assert all(n == math.factorial(s.bit_count()) * math.factorial(4 - s.bit_count()) for (s, _), n in weights.items())


def test_failures_in_slices(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\t\n\x0b\x0c\r \x1f\x85É#A") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    whole = [f.failures(t.encode()) for t in texts]
    monkeypatch.setattr(shared, "SLICE", 5)
    assert [f.failures(t.encode()) for t in texts] == whole
    assert all([x for part in shared.word_slices(t.encode()) for x in part] == t.encode().split() for t in texts)


# ---------------------------------------------------------------- whitening


def brute(rows, k):
    """The definition, by a dense eigendecomposition."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(((n * r - sums) ** 2).sum()) for r in x]
    centred = (x - sums / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return [i for i, _ in kept], n, deviation, centred @ vectors / np.sqrt(values), values / (sum(deviation) / n**3)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, n string").repartition(5)


def check(spark, rows, k, **options):
    got = w.whiten(vectors(spark, rows), **options).toPandas()
    ids, n, deviation, whitened, explained = brute(rows, k)
    assert len(got) == len(ids) * k and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids]
    assert list(wide.columns) == list(range(1, k + 1))
    signs = np.sign((wide.to_numpy() * whitened).sum(axis=0))
    assert np.abs(wide.to_numpy() * signs - whitened).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-10)
    assert got.drop_duplicates("vec_id").set_index("vec_id")["deviation"].loc[ids].tolist() == deviation


def test_whitening_is_the_dense_one(spark):
    rng = np.random.default_rng(1)
    mixing = rng.standard_normal((40, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 40)) @ mixing)]
    rows += [(1000, None), (1001, []), (1002, [None] * 40), (1003, [float("nan")] + [0.0] * 39), (1004, [float("inf")] * 40), (1005, rows[0][1]), (1006, [0.0] * 40), (1007, [1.0] * 39)]
    kept = [r for r in rows if r[0] != 1007]
    got = w.whiten(vectors(spark, rows)).toPandas()
    assert 1007 not in set(got["vec_id"])  # of another length than most
    check(spark, kept, 32)
    check(spark, kept, 5, components=5, block=2)


def test_whitening_without_variance(spark):
    rng = np.random.default_rng(2)
    flat = [(i, [float(a), float(b), 1.0, float(a)]) for i, (a, b) in enumerate(rng.integers(-50, 50, (60, 2)))]
    got = w.whiten(vectors(spark, flat)).toPandas()
    assert set(got["component"]) == {1, 2} and got["identity_error"][0] < 1e-9
    assert abs(got.groupby("component")["explained"].first().sum() - 1) < 1e-9
    for rows in ([(1, [1.0, 2.0])] * 5, [(1, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert w.whiten(vectors(spark, rows)).collect() == []
    assert w.whiten(vectors(spark, flat).limit(0)).collect() == []
    again = [(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [2.0, 2.5]), (3, [0.0, 1e30])]
    assert sorted((r.vec_id is None, r.component) for r in w.whiten(vectors(spark, again)).collect()) == [(False, 1), (True, 1), (True, 1)]


def test_deviations_beyond_a_long():
    x = np.array([[1 << 39, 0], [0, 5]])
    sums = x.sum(axis=0)
    assert w.deviations(x, 2, sums) == [sum((2 * int(c) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x]
    assert w.deviations(x, 1 << 30, sums)[0] > 1 << 63


@pytest.mark.parametrize("block", [1, 3, 16])
@pytest.mark.parametrize("most_basis", [0, 512])
def test_block_lanczos(block, most_basis):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    for spectrum in (np.linspace(5, 1, 90), np.r_[[4.0] * 7, [2.0] * 83], np.r_[[9.0, 3.0, 1.0], np.zeros(87)], 0.8 ** np.arange(90), np.zeros(90)):
        m = (q * spectrum) @ q.T
        values, v = w.block_lanczos(lambda x: m @ x, 90, 8, block, most_basis)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-11)
        assert np.allclose(v.T @ v, np.eye(8), atol=1e-11) and np.abs(m @ v - v * values).max() < 1e-10
