"""python -m tests.llm.near_dedup_recall SF_DIR: the pipeline's near-dedup stage against all pairs of documents.

Prints the pairs of five-word similarity 0.8 or more, the documents that brute force over all
of them keeps, those that the stage keeps, and how they differ.
"""

import sys
from collections import defaultdict

import numpy as np
from pyspark.sql import SparkSession

from siftline.llm import simhash


def kept_by_brute_force(rows):
    """(pairs, kept doc_ids) of rows (doc_id, text) by counting the shared shingles of every two documents that share one."""
    sets = []
    for _, text in rows:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    codes, lists = {}, defaultdict(list)
    for d, own in enumerate(sets):
        for x in own:
            lists[codes.setdefault(x, len(codes))].append(d)
    several = {c: np.array(v) for c, v in lists.items() if len(v) > 1}
    size, parent, pairs = np.array([len(x) for x in sets]), list(range(len(rows))), 0

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, own in enumerate(sets):
        near = [several[codes[x]] for x in own if codes[x] in several]
        if not near:
            continue
        other, both = np.unique(np.concatenate(near), return_counts=True)
        for o in other[(both >= 0.8 * (size[d] + size[other] - both)) & (other > d)].tolist():
            pairs += 1
            parent[find(o)] = find(d)
    groups = defaultdict(list)
    for d in range(len(rows)):
        groups[find(d)].append(rows[d][0])
    return pairs, sorted(min(x) for x in groups.values())


def main(sf_dir):
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs, want = kept_by_brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = sorted(r.doc_id for r in simhash.drop_near_copies(docs).select("doc_id").collect())
    print(f"{pairs} pairs, {len(want)} kept by brute force, {len(got)} by the stage, {len(set(got) - set(want))} extra, {len(set(want) - set(got))} missing")


if __name__ == "__main__":
    main(sys.argv[1])
