"""Tables in the folder that driver and executors share: lineage ends there, and lost executors cost only the tasks they ran."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where spark.checkpoint.dir is unset, as in tests on one machine.
LOCAL_WORK_DIR = "file:///tmp/checkpoints/siftline"

_made: list[tuple[SparkSession, str]] = []
_scopes: list[list[str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; set here only if unset, and on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = LOCAL_WORK_DIR
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new folder name below work_dir, removed when the interpreter ends."""
    path = f"{work_dir(spark)}/siftline/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a work folder through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _made:
        try:
            discard(spark, path)
        except Exception:  # the JVM may be gone by now
            return


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised inside are removed at the end, but for those to keep."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)


@contextmanager
def session_conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session with some settings (dots as double underscores) for the jobs that run inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, on any executor."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    # The Hadoop connectors' names of the same stores.
    return fs.FileSystem.from_uri(re.sub(r"^(s3)[an]://|^(abfs)s://", lambda m: f"{m[1] or m[2]}://", uri))


def materialise(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over the cluster: for compact tables whose rows cost much CPU, as a scan deals rows by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def positioned(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with each row's place (0, 1, ...) in the order of some columns, as column `name`.

    No window over all rows: a range partitioning is written once, and its partitions' sizes,
    a row for each, say where each begins. Rows that are equal in `order` have no order of
    their own.
    """
    part, at = f"{name}_part", f"{name}_at"
    # Rows that are equal in `order` but not in all may be many: a hash parts them.
    plain = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*order, F.xxhash64(*plain)]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(placed.select("*", F.spark_partition_id().alias(part), within.alias(at)), "positioned", keep=True)
    before, base = 0, []
    for r in placed.groupBy(part).agg(F.count("*").alias("rows")).orderBy(part).collect():
        base.append((r[part], before))
        before += r["rows"]
    starts = F.broadcast(df.sparkSession.createDataFrame(base, f"{part} int, {name}_start long"))
    return placed.join(starts, part).select(*df.columns, (F.col(f"{name}_start") + F.col(at)).alias(name))
