"""What the training-data operators share: tables in the work folder, hot keys, column picking."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import deploy
from siftline.workspace import discard, materialise, temporary, work_dir, work_path

__all__ = ["discard", "materialise", "temporary", "work_dir", "work_path"]

#: ASCII white space of the contracts, as a Java / Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Keys with over 1/HOT_KEYS of all rows, and at least HOT_ROWS: there are at most HOT_KEYS of them, so they can be broadcast.
HOT_ROWS, HOT_KEYS = 10_000, 10_000

#: Rows and bytes in an Arrow batch, at most: texts may be long, and a worker holds a batch or two at once.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Prepare a session for the operators' Arrow functions: the package on executors, batches of bounded size.

    The session keeps the smaller batches: DataFrames run after the call that makes them.
    """
    deploy.ship(spark)
    for conf, most in ((BATCH_CONF, BATCH_ROWS), (BYTES_CONF, BATCH_BYTES)):
        held = spark.conf.get(conf)
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(conf, str(most))


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder with columns _c0, _c1, ... and a row number _rid.

    A number is only good if it is the same whenever the rows are read: scans may be split
    otherwise after an executor is lost, and shuffles order rows by the columns that are
    left. So the numbers are written once with their rows.
    """
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return materialise(flat.withColumn("_rid", F.monotonically_increasing_id()), tag, keep=True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, matched with exact case, whatever else the table holds."""
    where = []
    for n in names:
        if n not in df.columns:
            raise ValueError(f"no column {n!r} among {df.columns}")
        where.append(df.columns.index(n))
    flat = df.toDF(*[f"_p{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_p{i}").alias(n) for i, n in zip(where, names)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def join_skewed(rows: DataFrame, per_key: DataFrame, key: str, rows_of_key: str = "n") -> DataFrame:
    """rows joined with per_key, a materialised table of one row per key that counts the key's rows.

    Any key may hold a large share of the rows. Those with over 1/HOT_KEYS of them are at most
    HOT_KEYS, so they are looked up by broadcast and their rows aren't shuffled; the others
    are joined as Spark plans it.
    """
    total, most = per_key.agg(F.sum(rows_of_key), F.max(rows_of_key)).first()
    least = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if not total or most <= least:
        return rows.join(per_key, key)
    few, others = (F.broadcast(per_key.where(F.col(rows_of_key) > least)), per_key.where(F.col(rows_of_key) <= least))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(others, key))


#: Bytes of a text that are split into words at once.
SLICE = 1 << 20
_SPACES = [b"%c" % c for c in b" \t\n\x0b\x0c\r"]


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about SLICE bytes; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = min((x for x in (text.find(s, end) for s in _SPACES) if x >= 0), default=len(text))
        yield text[at:end].split()
        at = end


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI in the shared folder, on any executor."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    # The Hadoop connectors' names of the same stores.
    return fs.FileSystem.from_uri(re.sub(r"^(s3)[an]://|^(abfs)s://", lambda m: f"{m[1] or m[2]}://", uri))
