import threading
import time

import pytest
from pyspark.sql import functions as F

from siftline.operators import running


def slow(spark, seconds, rows=40):
    def work(batches):
        for batch in batches:
            time.sleep(seconds)
            yield batch

    return spark.range(0, rows, 1, rows).mapInPandas(work, "id long")


def test_at_most_so_many_at_once(spark):
    lock, now, most, pools = threading.Lock(), [0], [0], {}

    def work(name):
        def run():
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            pools[name] = spark.sparkContext.getLocalProperty(running.POOL)
            n = spark.range(1000).where(F.col("id") % 2 == 0).count()
            time.sleep(0.2)
            with lock:
                now[0] -= 1
            return name, n

        return run

    names = [f"w{i}" for i in range(8)]
    assert running.bounded(spark, {n: work(n) for n in names}, "exports") == {n: (n, 500) for n in names}
    assert most[0] == 2 and set(pools.values()) == {"exports"}
    assert spark.sparkContext.getLocalProperty(running.POOL) is None


def test_an_error_ends_what_waits(spark):
    begun = []

    def work(i):
        begun.append(i)
        time.sleep(0.1)
        if i == 0:
            raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        running.bounded(spark, {str(i): (lambda i=i: work(i)) for i in range(30)}, "exports", 1)
    assert len(begun) < 30


def test_running_work_is_cancelled(spark, tmp_path):
    out = tmp_path / "out"
    asked, undone = threading.Event(), []
    threading.Timer(3, asked.set).start()
    start = time.time()

    def undo():
        import shutil

        shutil.rmtree(out, ignore_errors=True)
        undone.append(time.time())

    got = running.cancellable(spark, lambda: slow(spark, 20).write.parquet(f"file://{out}"), asked.is_set, undo)
    assert got.status == "CANCELLED" and time.time() - start < 10 and not out.exists() and len(undone) == 1
    assert spark.range(10).count() == 10


def test_work_that_ends_by_itself(spark):
    done = running.cancellable(spark, lambda: spark.range(7).count(), lambda: False)
    assert (done.status, done.result) == ("COMPLETED", 7)
    failed = running.cancellable(spark, lambda: spark.range(3).select(F.raise_error(F.lit("broken"))).collect(), lambda: False)
    assert failed.status == "FAILED" and "broken" in str(failed.error)
    assert not any(t.startswith("work-") for t in spark.sparkContext.getJobTags())
