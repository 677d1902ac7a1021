"""Leases and retries of running jobs as a stateful stream with event-time timers.

A worker claims a job for a while and renews its lease. A lease that lapses, or an attempt
that fails and may be repeated, costs one attempt: the next one is due after its backoff,
and after the last one the job has failed. The state of a job is its attempts so far and
what it waits for (the end of a lease or of a backoff), kept in a state variable; a timer
wakes it when the watermark passes. A job that is done, cancelled or failed has no state.

Deadlines that pass between two events of one micro-batch are settled before the later
event, so that the result doesn't depend on how events are cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What is known of a job: attempts so far, what it waits for and until when (microseconds).
_STATE = "attempt int, waits string, until long"
ACTIONS = ("CLAIM", "RENEW", "DONE", "CANCEL", "FAIL", "ABORT")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Job:
    """One job's attempts: what happens with its events and its deadlines. Times are microseconds."""

    def __init__(self, most: int, base: float, longest: float, attempt: int = 0, waits: str | None = None, until: int = 0):
        self.most, self.base, self.longest = most, base, longest
        self.attempt, self.waits, self.until = attempt, waits, until
        self.out: list[tuple[str, int, int]] = []

    def lose(self, at: int) -> None:
        """An attempt is over without a result: the next one waits for its backoff, if there is one."""
        self.attempt += 1
        if self.attempt > self.most:
            self.end("JOB_FAILED", at)
        else:
            delay = min(self.longest, self.base * 2.0 ** max(0, self.attempt - 1))
            self.waits, self.until = "BACKOFF", at + int(delay * 1_000_000)

    def end(self, event: str | None, at: int) -> None:
        if event:
            self.out.append((event, self.attempt, at))
        self.attempt, self.waits = 0, None

    def settle(self, passed) -> None:
        """Deadlines that have passed."""
        if self.waits == "LEASE" and passed(self.until):
            self.lose(self.until)
        if self.waits == "BACKOFF" and passed(self.until):
            self.out.append(("RETRY_DUE", self.attempt, self.until))
            self.waits = None

    def act(self, action: str, at: int, until: int | None) -> None:
        self.settle(lambda deadline: deadline < at)
        if action in ("CLAIM", "RENEW") and until is not None:
            self.waits, self.until = "LEASE", until
        elif action == "FAIL":
            self.lose(at)
        elif action == "ABORT":
            self.attempt += 1
            self.end("JOB_FAILED", at)
        elif action in ("DONE", "CANCEL"):
            self.end(None, at)


def _micros(times: pd.Series) -> list[int | None]:
    return [None if pd.isna(t) else t.value // 1000 for t in times]


class _Supervisor(StatefulProcessor):
    def __init__(self, most: int, base: float, longest: float):
        self.options = (most, base, longest)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", _STATE)

    def _job(self) -> Job:
        return Job(*self.options, *(self.held.get() if self.held.exists() else ()))

    def _keep(self, job: Job) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.waits:
            # Timers are in milliseconds: never before the deadline.
            self.handle.registerTimer(-(-job.until // 1000))
        if job.waits or job.attempt:
            self.held.update((job.attempt, job.waits, job.until))
        elif self.held.exists():
            self.held.clear()

    def _out(self, key, job: Job) -> Iterator[pd.DataFrame]:
        if job.out:
            event, attempt, at = zip(*job.out)
            yield pd.DataFrame({"job_id": [key[0]] * len(at), "event": event, "attempt": attempt, "at": pd.to_datetime(list(at), unit="us")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, batch = self._job(), pd.concat(list(rows)).sort_values(["at", "id"])
        for action, at, until in zip(batch["action"], _micros(batch["at"]), _micros(batch["lease_until"])):
            job.act(action, at, until)
        self._keep(job)
        yield from self._out(key, job)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, passed = self._job(), timerValues.getCurrentWatermarkInMs() * 1000
        job.settle(lambda deadline: deadline <= passed)
        self._keep(job)
        yield from self._out(key, job)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self._keep(Job(*self.options, int(row["attempt"]), "LEASE", _micros(initialState["lease_until"])[0]))

    def close(self) -> None:
        pass


def supervised(
    actions: DataFrame, most: int = 3, base: float = 1.0, longest: float = 60.0, delay: str = "0 seconds", held: DataFrame | None = None
) -> DataFrame:
    """job_id, event, attempt, at of a stream of what workers do: RETRY_DUE when a further attempt may start, JOB_FAILED after the last.

    Input: job_id, id, at (event time), action (one of ACTIONS; FAIL may be repeated, ABORT may not),
    lease_until (of CLAIM and RENEW). `held` (job_id, attempt, lease_until) are leases that were
    open before the stream began. A claim before its backoff is over stands; a job that has ended
    begins anew with its next event. An event at or before the watermark is late and dropped. Needs the RocksDB state store (STORE).
    """
    chosen = actions.select("job_id", "id", "at", "action", "lease_until").withWatermark("at", delay)
    kind = chosen.schema["job_id"].dataType.simpleString()
    start = None if held is None else held.select("job_id", "attempt", "lease_until").groupBy("job_id")
    return chosen.groupBy("job_id").transformWithStateInPandas(
        _Supervisor(most, base, longest), f"job_id {kind}, event string, attempt int, at timestamp", "append", "eventTime", start
    )
