"""The job consumer as a stream against a plain fold of each version's events."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from citelake.streaming import consumer

SCHEMA = "version_id string, event_id long, kind string, ts timestamp"
START, HOUR = datetime(2024, 5, 1, tzinfo=timezone.utc), 3_600_000


def events(seed, versions=25, n=400):
    rng = random.Random(seed)
    kinds = ["queued"] * 3 + ["failed"] * 2 + ["done", "seen", "seen", None]
    return [(f"v{rng.randrange(versions)}", i, rng.choice(kinds), START + timedelta(minutes=20 * i, milliseconds=i)) for i in range(n)]


def fold(rows, silence, watermark):
    """The results that are due once the watermark has passed."""
    out = {}
    for v in {r[0] for r in rows}:
        last, failures, result = None, 0, None
        for _, _, kind, ts in sorted((r for r in rows if r[0] == v), key=lambda r: (r[3], r[1])):
            if last is None:
                last = ts if kind == "queued" else None
                continue
            if ts > last + silence:
                result = ("failed", "timeout", failures, last + silence)
                break
            last, failures = ts, failures + (kind == "failed")
            if kind == "done" or failures == 3:
                result = ("processed", "", failures + 1, ts) if kind == "done" else ("failed", "attempts", failures, ts)
                break
        if result is None and last is not None and last + silence < watermark:
            result = ("failed", "timeout", failures, last + silence)
        if result:
            out[v] = result
    return out


def got(spark, path):
    rows = spark.read.schema(consumer.RESULT).parquet(path).withColumn("ms", F.unix_millis("at")).collect()
    assert max(Counter(r.version_id for r in rows).values(), default=1) == 1  # exactly one result a version
    return {r.version_id: (r.status, r.reason, r.attempts, r.ms) for r in rows}


def as_ms(found):
    return {v: (s, why, n, int(at.timestamp() * 1000 + 0.5)) for v, (s, why, n, at) in found.items()}


def test_restarts_and_any_batches_give_the_folds_results(spark, tmp_path):
    rows = events(1)
    for name, cuts in (("one", [400]), ("many", [70, 150, 151, 300, 400])):
        base, start = tmp_path / name, 0
        for cut in cuts:
            spark.createDataFrame(rows[start:cut], SCHEMA).coalesce(1).write.mode("append").parquet(str(base / "events"))
            start = cut
            stream = spark.readStream.schema(SCHEMA).parquet(str(base / "events"))
            consumer.run(stream, str(base / "out"), str(base / "state"), 9 * HOUR).awaitTermination()
            known = rows[:cut]
            assert got(spark, str(base / "out")) == as_ms(fold(known, timedelta(hours=9), max(r[3] for r in known) - timedelta(hours=1)))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None or "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_run_without_new_events_changes_nothing(spark, tmp_path):
    rows = [("a", 1, "queued", START), ("a", 2, "done", START), ("b", 3, "done", START), ("b", 4, "queued", START + timedelta(minutes=1)), (None, 5, "queued", START), ("a", 6, "failed", START + timedelta(minutes=2))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "events"))
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))
        consumer.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), 9 * HOUR).awaitTermination()
        assert got(spark, str(tmp_path / "out")) == {"a": ("processed", "", 1, int(START.timestamp() * 1000))}


class State:
    """A version's state as Spark hands it in, and what is asked of it."""

    def __init__(self, now, value=None, timed_out=False):
        self.now, self.get, self.exists, self.hasTimedOut, self.due = now, value, value is not None, timed_out, None

    def getCurrentWatermarkMs(self):
        return self.now

    def setTimeoutTimestamp(self, due):
        assert due > self.now  # Spark refuses others
        self.due = due

    def update(self, value):
        self.get = value


def test_a_step_needs_its_events_and_state_alone():
    """Timers that are due as they are set, at the watermark and later; then the timer itself; finished versions stay."""
    step = consumer.consumer(10, 3)

    def run(state, *rows):
        out = list(step(("v",), iter([pd.DataFrame(rows, columns=["ms", "event_id", "kind"])] if rows else []), state))
        return [tuple(x.itertuples(index=False, name=None))[0][1:] for x in out]

    for now, due, want in ((20, None, [("failed", "timeout", 0, 15)]), (15, 16, []), (3, 15, []), (0, 15, [])):
        state = State(now)
        assert run(state, (5, 1, "queued")) == want and state.due == due and state.get == (bool(want), 0, 5)
    late = State(40, (False, 1, 5), timed_out=True)
    assert run(late) == [("failed", "timeout", 1, 15)] and late.get == (True, 1, 5)
    over = State(0, (True, 1, 5))
    assert run(over, (6, 2, "done")) == [] and over.get == (True, 1, 5) and over.due is None
    assert run(State(0), (7, 3, "done"), (6, 2, "failed"), (5, 1, "queued")) == [("processed", "", 2, 7)]
    assert run(State(0), (5, 1, "done"), (6, 2, None)) == []


def test_events_without_a_time_are_left_out(spark, tmp_path):
    rows = [("a", 1, "queued", START), ("a", 2, "done", None), ("a", 3, "failed", START), ("b", 4, "queued", START + timedelta(hours=30))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))
    consumer.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), 9 * HOUR).awaitTermination()
    assert got(spark, str(tmp_path / "out")) == {"a": ("failed", "timeout", 1, int(START.timestamp() * 1000) + 9 * HOUR)}
