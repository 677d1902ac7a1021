import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.llm import exact_dedup as e


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(norm[i], []).append((doc_id is None, doc_id or 0, i))
    return {n: (min(g), len(g)) for n, g in groups.items()}, norm


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab ", max_size=6), st.integers(0, 9)), max_size=40), st.integers(0, 30))
def test_trie(items, budget):
    trie, want = e.PatriciaTrie(min, budget), {}
    for key, n in items:
        trie.insert(key.encode(), n)
        want[key.encode()] = min(n, want.get(key.encode(), n))
    assert sorted(trie.items()) == sorted(want.items())


def test_trie_spills_and_cleans_up(tmp_path):
    trie = e.PatriciaTrie(lambda a, b: a + b, 50, str(tmp_path))
    keys = [bytes([97 + i % 3]) + b"x" * 20 + str(i).encode() for i in range(60)] * 2
    for k in keys:
        trie.insert(k, 1)
    # The files have no name, so that they are gone however the task ends.
    assert trie.spilled and list(tmp_path.iterdir()) == []
    files = list(trie.spilled.values())
    assert dict(trie.items()) == {k: 2 for k in keys}
    assert all(f.closed for f in files) and not trie.spilled


def test_trie_counts_nodes_and_entries():
    trie = e.PatriciaTrie(e._merge_rows, 20_000, weigh=e._row_bytes)
    for i in range(1000):
        trie.insert(f"{i % 7}{i}".encode(), [i, i, (i, "v" * 100)])
        assert trie.held <= 20_000 and trie.held >= 600 * sum(trie._size(c) > 0 for c in trie.root.children.values())
    assert trie.spilled and len(dict(trie.items())) == 1000


def test_merging_many_representatives_is_linear():
    entry = [5, 5, 1, [5]]
    kept = entry[3]
    for i in range(6, 50_000):
        entry = e._merge(entry, [i, i, 1, [i]])
        assert entry[3] is kept
    assert entry[:3] == [5, 5, 49_995] and sorted(entry[3]) == list(range(5, 50_000))


def test_normalise():
    for t in ("a  b\t\n c", " ", "\x0b\x0c\r", "a b", "   ", "\x1c a", None, ""):
        assert e.normalise(t) == re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()


ROWS = [(5, "a  b"), (3, "a b"), (None, "a\tb"), (7, None), (8, ""), (9, " "), (2, "z"), (2, "z"), (1, "long " * 40_000), (4, "long " * 40_000), (None, "only")]


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, keep_id int, _rep int").repartition(3)
    got = e.exact_dedup(docs, **options).collect()
    groups, norm = brute(rows)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    import hashlib

    want = {}
    for n, ((missing, doc_id, _), size) in groups.items():
        want[hashlib.sha256(n.encode()).hexdigest()] = (None if missing else doc_id, size)
    assert {r.text_sha256: (r.keep_id, r.group_size) for r in got} == want
    assert sum(r.kept for r in got) == len(groups)
    kept = e.drop_copies(docs, **options)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    names = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""): r.doc_id for r in kept.collect()}
    assert names == {n: (None if g[0][0] else g[0][1]) for n, g in groups.items()}


def test_cases(spark):
    check(spark, ROWS)


def test_small_windows_and_budget(spark):
    check(spark, ROWS * 3, window_bytes=1, trie_bytes=10)


def test_one_group(spark):
    check(spark, [(i, "same") for i in range(300)], window_bytes=1)


def test_texts_in_a_thousand_windows(spark, monkeypatch):
    # Batches of one row are windows of one row, so each row is a representative.
    monkeypatch.setattr(e, "HOT_REPS", 20)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = [(5000 - i if i % 9 else None, "hot  text" if i % 2 else "hot text") for i in range(1000)]
        check(spark, rows + [(i, None if i % 2 else "") for i in range(60)] + [(i, f"t{i % 30}") for i in range(100)], window_bytes=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_parts_of_hot_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(e, "HOT_REPS", 20)
    reps = spark.range(1010).selectExpr("id as _c0", "'x' as _c1", "id as _rep", "1L as _count", "1L as _length", "if(id < 1000, 7L, id) as _content")
    hot = e._hot_texts(reps)
    assert [(r._content, r._parts) for r in hot.collect()] == [(7, 50)]
    sizes = [r.n for r in e._in_parts(reps, hot).selectExpr("pmod(xxhash64(_rep), 50) as p").groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 50


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert e.exact_dedup(docs).collect() == [] and e.drop_copies(docs).collect() == []
