"""The job consumer as a stateful stream: one state a version, retries, time-outs, and exactly one result a version.

Events of a version are `queued` (a job is there), `failed` (an attempt has ended badly), `done`, and anything else (a sign
of life). From its first job on, a version waits for `done`; MOST_ATTEMPTS failed attempts, or no event for `timeout`, end
it as failed. A version that has its result ignores all that follows. Time is the events' own: a silence counts as a
time-out whether the next event shows it or the watermark, which fires the state's timer; so results do not depend on how
events are cut into batches, as long as none comes later than the watermark allows.

State lives in Spark's state store under the checkpoint, results in a file sink that knows its batches, so a stopped query
goes on where it was and a repeated batch gives nothing twice. A version's events of one batch are put in order in memory;
the source's options (maxFilesPerTrigger, maxBytesPerTrigger) bound a batch. Spark hands a worker the states of many versions
with their events, and takes them back likewise; no call of its own goes out for a state or a timer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOST_ATTEMPTS = 3
QUEUED, FAILED, DONE = "queued", "failed", "done"
RESULT = "version_id string, status string, reason string, attempts int, at timestamp"
_MADE = "version_id string, status string, reason string, attempts int, ms long"
_STATE = "finished boolean, failures int, last long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def consumer(timeout_ms: int, most_attempts: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """One version's step: its state and its events of a batch, or its timer, to the next state and perhaps its result. Times
    are milliseconds."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        finished, failures, last = state.get if state.exists else (False, 0, None)
        found = None
        if state.hasTimedOut:
            found = None if finished else ("failed", "timeout", failures, last + timeout_ms)
        else:  # what has come is read in any case
            events = [x for r in rows for x in zip(r["ms"].tolist(), r["event_id"].tolist(), r["kind"].tolist(), strict=True)]
            for ts, _, kind in () if finished else sorted(events, key=lambda x: (x[0], x[1])):
                if last is None:
                    last = ts if kind == QUEUED else None
                    continue
                if ts > last + timeout_ms:
                    found = ("failed", "timeout", failures, last + timeout_ms)
                    break
                last = ts
                failures += kind == FAILED
                if kind == DONE or failures == most_attempts:
                    found = ("processed" if kind == DONE else "failed", "" if kind == DONE else "attempts", failures + (kind == DONE), last)
                    break
            if not finished and found is None and last is not None:
                now, due = state.getCurrentWatermarkMs(), last + timeout_ms
                if due < now:  # events of this batch that were in time as it began, with a silence that has run out since
                    found = ("failed", "timeout", failures, due)
                else:
                    state.setTimeoutTimestamp(max(due, now + 1))
        if last is not None and not finished:
            state.update((found is not None, failures, last))
        if found:
            status, reason, attempts, at = found
            yield pd.DataFrame({"version_id": [key[0]], "status": [status], "reason": [reason], "attempts": [attempts], "ms": [at]})

    return step


def results(events: DataFrame, timeout_ms: int, delay: str = "1 hour", most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """A stream of events (version_id string, event_id long, kind string, ts timestamp) -> a stream of results. Events without
    a time have no place among the others and are left out."""
    timed = events.where("ts is not null").withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
    made = timed.groupBy("version_id").applyInPandasWithState(consumer(timeout_ms, most_attempts), _MADE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return made.select("version_id", "status", "reason", "attempts", F.timestamp_millis("ms").alias("at"))


def run(events: DataFrame, path: str, checkpoint: str, timeout_ms: int, delay: str = "1 hour", most_attempts: int = MOST_ATTEMPTS) -> StreamingQuery:
    """Processes what is there now, appends results (Parquet under path) and stops; the next run goes on from the checkpoint.
    The state store, which keeps states on disk and not in memory, is set for this query only."""
    spark = events.sparkSession
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        sink = results(events, timeout_ms, delay, most_attempts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return sink.outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER[0])
        else:
            spark.conf.set(_PROVIDER[0], before)
