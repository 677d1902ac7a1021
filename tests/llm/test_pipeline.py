import re

import pytest

import corpus_pipeline as cp
from siftline.llm import mixing, shared
from siftline.llm import queries as llm

from ..oracle import compare, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_against_sql(spark, name):
    compare(llm.QUERIES[name](spark, SF), connection(SF), llm.SQL[name])


def test_every_operator_has_a_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n.split("_")[0] for n in llm.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(llm.QUERIES) | {"pipeline"} <= set(names)


def sizes(rows):
    return sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)


def test_stages(spark):
    docs = shared.documents(spark, SF)
    columns, before = docs.columns, docs.collect()
    ids = [{r.doc_id for r in before}]
    for name, stage in cp.STAGES[:-1]:
        docs = shared.materialise(stage(spark, docs, SF), "test-stage")
        assert docs.columns == columns, name
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2], name
        if name == "near_dedup":
            unmixed = docs.collect()
    assert len(ids[1]) == len(ids[0])  # every document here has a language
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text) for r in before}
    assert len(ids[2]) == len(texts)
    mixed = docs.collect()
    wanted = {}
    for r in unmixed:
        wanted[r.source] = wanted.get(r.source, 0) + sizes([r])
    wanted = mixing.targets(wanted, sum(wanted.values()), mixing.WEIGHTS, mixing.SHARE, mixing.MAX_COPIES)
    for source, words in wanted.items():
        largest = max(sizes([r]) for r in unmixed if r.source == source)
        assert abs(sizes([r for r in mixed if r.source == source]) - words) < largest
    packed = cp.STAGES[-1][1](spark, docs, SF).collect()
    per = {}
    for r in packed:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in per.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({(r.doc_id) for r in packed}) == len(ids[-1])
    assert len(cp.run(spark, SF).collect()) == len(packed)


def test_every_kind_of_row_comes_through(spark, tmp_path):
    rows = [(1, "The cat sat on the mat and looked at the door. " * 3, "a", "en"), (1, "The cat sat on the mat and looked at the door. " * 3, "a", "en")]
    rows += [(None, "Der Hund lief schnell über die breite Straße nach Hause.", None, "de"), (None, None, None, None), (2, "", "b", None), (3, " \t\n", "b", "en")]
    rows += [(4, "long words in a very long text. " * 40_000, "b", "en"), (5, "12 34 56", "b", "en"), (5, "12 34 56", "b", "en")]
    rows += [(10 + i, f"Some words about thing number {i} and about what it is, in plain English for a reader. " * 2, "ab"[i % 2], "en") for i in range(40)]
    rows += [(100 + i, f"Ein Satz über das Ding Nummer {i} und darüber, was es ist, auf Deutsch für Leser. " * 2, "ab"[i % 2], "de") for i in range(40)]
    names = "doc_id long, text string, source string, lang string"
    docs = spark.createDataFrame(rows, names).selectExpr("doc_id", "source", "lang", "text", "1 as _rid", "2 as `_c0`", "3 as fp", "4 as sequence_id", "array(1) as key")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = cp.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in packed}
    assert {1, 4, None} <= ids and not ids & {2, 3, 5}  # no letter, no language
    stage = written = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in cp.STAGES[:-1]:
        stage = shared.materialise(f(spark, stage, str(tmp_path)), "edge")
        assert stage.columns == docs.columns and stage.schema["key"].dataType == written.schema["key"].dataType
    assert {(r["_rid"], r["_c0"], r["fp"], r["key"][0]) for r in stage.collect()} == {(1, 2, 3, 1)}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").collect() == []
