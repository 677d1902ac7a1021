import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedupe, extraction
from siftline.plans.plan import Deduplication, Plan, PlanField

PLAN = Plan("https://e.com/", "x", (PlanField("mail", "email", "M"), PlanField("name", "string", "N"), PlanField("n", "number", "C"), PlanField("on", "boolean", "B")))


def records(spark, rows):
    df = spark.createDataFrame(rows, "id long, mail string, name string, n string, on string").repartition(3)
    return extraction.records_from_table(df, PLAN, F.col("id"), {c: F.col(c) for c in ("mail", "name", "n", "on")}).withColumn("id", F.col("page_id").cast("long"))


def brute(rows, keys):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in keys:
        seen = {}
        for r in rows:
            own = tuple(r[i] for i in key)
            if all(own):
                a, b = find(seen.setdefault(own, r[0])), find(r[0])
                parent[max(a, b)] = min(a, b)
    return {r[0]: find(r[0]) for r in rows}


def run(spark, rows, *keys, **options):
    plan = replace(PLAN, deduplication=Deduplication(keys=keys, **options))
    got = dedupe.deduplicated(records(spark, rows), plan, "id").select("id", "represented_by", "kept").collect()
    assert len(got) == len(rows) and all(r.kept == (r.id == r.represented_by) for r in got)
    return {r.id: r.represented_by for r in got}


def test_components_of_alternative_keys(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *(f"m{j}@a.co" for j in range(90))]), rng.choice([None, "", *(f"n{j}" for j in range(40))]), rng.choice([None, "0", "1", "2.5"]), rng.choice(["true", "false", None])) for i in range(200)]
    assert run(spark, rows, "mail", "name + n + on") == brute(rows, [(1,), (2, 3, 4)])


def test_a_long_chain_and_a_hot_key(spark):
    chain = [(i, f"m{i // 2}@a.co", f"n{(i + 1) // 2}", None, None) for i in range(64)]
    hot = [(100 + i, "hot@a.co", None, None, None) for i in range(300)]
    random.Random(2).shuffle(chain)
    assert run(spark, chain + hot, "mail", "name") == brute(chain + hot, [(1,), (2,)])


def test_switched_off_and_wrong_keys(spark):
    rows = [(1, "a@b.co", "x", "1", None), (2, "a@b.co", "x", "1", None)]
    itself = {1: 1, 2: 2}
    assert run(spark, rows, "mail", enabled=False) == itself and run(spark, rows) == itself
    assert run(spark, rows, "mail") == {1: 1, 2: 1}
    assert run(spark, rows[:1], "mail") == {1: 1}
    with pytest.raises(ValueError, match="no field"):
        run(spark, rows, "mail+other")
