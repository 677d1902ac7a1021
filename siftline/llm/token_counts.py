"""Token counts of flat token files by separator scan.

A token file is a run of little-endian identifiers with an end-of-document identifier after
each document and no index. Files are cut into blocks of a fixed size; each block is searched
for separators with one vectorised comparison, so neither file nor document size bounds the
parallelism. A prefix scan over the (small) table of blocks gives each block the number of
separators before it and the place of the last one, which stitches documents that cross
block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared, tokens

#: Identifiers in a block: 8 MB of two-byte identifiers.
BLOCK = 4 << 20
#: Blocks that one scan task reads in turn.
BLOCKS_PER_TASK = 2

_WRITTEN = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("ordinal", T.LongType()), T.StructField("doc_id", T.LongType())]
)


def _write(batches: Iterator[pa.RecordBatch], folder: str, json_path: str, ranks_path: str) -> Iterator[pa.RecordBatch]:
    # A retried task writes under a new name; only the names that a finished task returned are read.
    name = f"{folder}/tokens-{uuid.uuid4().hex}.u16"
    system, path = shared.filesystem(name)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    total = ordinal = 0
    with system.open_output_stream(path) as out:
        for batch in batches:
            n = batch.num_rows
            for text in batch.column(1):
                ids = np.append(tokens.encode(text.as_py(), False, json_path, ranks_path), np.uint32(tokens.END_ID)).astype("<u2")
                out.write(ids.tobytes())
                total += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], _WRITTEN.names
            )
            ordinal += n
    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1], pa.int64()), pa.array([total], pa.int64())], _WRITTEN.names)


def write_token_files(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Tokenise docs (doc_id, text) into one flat file per task below folder.

    Returns (files: file, n_ids) and (order: file, ordinal, doc_id). Null texts are empty
    documents; repeated rows are documents each. The end-of-document identifier never comes
    from a text: its string is read as ordinary text.
    """
    shared.ship(docs.sparkSession)
    json_path, ranks_path = tokens.vocabulary_paths()
    f = partial(_write, folder=folder, json_path=json_path, ranks_path=ranks_path)
    rows = shared.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    done = shared.materialise(rows.mapInArrow(f, _WRITTEN), "token-order")
    return done.where("ordinal = -1").select("file", F.col("doc_id").alias("n_ids")), done.where("ordinal >= 0")


_SCANNED = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("ends", T.ArrayType(T.LongType())),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch], block: int, kind: str, end_id: int) -> Iterator[pa.RecordBatch]:
    width = np.dtype(kind).itemsize
    for batch in batches:
        for row in batch.to_pylist():
            system, path = shared.filesystem(row["file"])
            start = row["block"] * block
            with system.open_input_file(path) as f:
                f.seek(start * width)
                ids = np.frombuffer(f.read(min(block, row["n_ids"] - start) * width), kind)
            ends = np.flatnonzero(ids == end_id) + start
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["file"]]),
                    pa.array([row["block"]], pa.int64()),
                    pa.array([row["n_ids"]], pa.int64()),
                    pa.array([ends], pa.list_(pa.int64())),
                ],
                _SCANNED.names,
            )


def count_tokens(files: DataFrame, end_id: int = tokens.END_ID, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """One row per document of the flat files: file, ordinal (from 0), start, n_tokens.

    Input: file (URI), n_ids (identifiers in it). n_tokens leaves the separator out; two
    separators in a row are an empty document; identifiers after the last separator are a
    last document. Empty files give no rows.
    """
    shared.ship(files.sparkSession)
    planned = shared.pick(files, "file", "n_ids").where("n_ids > 0")
    blocks = planned.select("file", "n_ids", F.explode(F.expr(f"sequence(0L, (n_ids - 1) div {block}L)")).alias("block"))
    total = planned.agg(F.sum(F.expr(f"(n_ids - 1) div {block}L + 1"))).first()[0] or 1
    dealt = blocks.repartition(max(8, total // BLOCKS_PER_TASK), "file", "block")
    scanned = shared.materialise(dealt.mapInArrow(partial(_scan, block=block, kind=kind, end_id=end_id), _SCANNED), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "n_ids", F.size("ends").alias("n"), F.expr("try_element_at(ends, -1)").alias("last"))
    prefix = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.max("last").over(before) + 1, F.lit(0)).alias("begins"),
    )
    inner = (
        scanned.join(prefix, ["file", "block"])
        .select("file", "documents", "begins", "ends", F.posexplode("ends").alias("i", "end"))
        .withColumn("start", F.when(F.col("i") == 0, F.col("begins")).otherwise(F.expr("get(ends, i - 1)") + 1))
        .select("file", (F.col("documents") + F.col("i")).alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("n_tokens"))
    )
    tails = summary.groupBy("file").agg(
        F.sum("n").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0)).alias("start"), F.max("n_ids").alias("n_ids")
    )
    tails = tails.where("n_ids > start").select("file", "ordinal", "start", (F.col("n_ids") - F.col("start")).alias("n_tokens"))
    return inner.unionByName(tails)


def document_token_counts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_tokens, counted by scanning the token files written from docs.

    Null and empty texts have 0 tokens; null doc_ids and repeated rows keep their rows; an
    empty table gives no rows; other columns are ignored.
    """
    files, order = write_token_files(docs, shared.work_path(docs.sparkSession, "token-files"))
    return order.join(count_tokens(files, block=block), ["file", "ordinal"]).select("doc_id", "n_tokens")
