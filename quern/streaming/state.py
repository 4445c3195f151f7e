"""Keyed state with an end: jobs that go when their work is done, users that fall silent, results that belong to work.

State is kept by key in the store of the stream's checkpoint; a key whose story is over is cleared. Rows of a key are taken in their
order inside a batch, and batches must come in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(stream: DataFrame, key: str) -> GroupedData:
    """stream by key, a long, for a processor, whose keys are (is null, value or 0), as null keys would be groups of one row each. Sets
    the session's state store to the one that holds more state than memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.withColumn("_none", F.col(key).isNull()).withColumn(key, F.coalesce(key, F.lit(0).cast("long"))).groupBy("_none", key)


def own(key: tuple) -> int | None:
    """What stands in the key's column."""
    return None if key[0] else key[1]


class Removal(StatefulProcessor):
    """Of a job: how much of its work is out, and whether its removal is asked for. Both are cleared when it goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "out long, asked boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        out, asked = self.open.get() if self.open.exists() else (0, False)
        gone = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            out, asked = out + r.step, asked or r.ask
            if asked and out == 0 and (r.ask or r.step < 0):
                gone.append((own(key), r.seq))
                asked = False
        if out == 0 and not asked:
            self.open.clear()
        else:
            self.open.update((int(out), bool(asked)))
        yield pd.DataFrame(gone, columns=["job", "seq"]).astype({"job": "Int64"})


def removals(stream: DataFrame) -> DataFrame:
    """(job, seq): rows of stream(job, seq, step, ask) with which their job goes: its removal is asked for and no work is out any more.

    step is 1 for work given out and -1 for a result; null steps count as 0, null asks as false. seq must not fall from batch to batch.
    """
    rows = stream.select("job", "seq", F.coalesce(F.col("step").cast("long"), F.lit(0)).alias("step"), F.coalesce("ask", F.lit(False)).alias("ask"))
    return with_state(rows, "job").transformWithStateInPandas(Removal(), "job long, seq long", "append", "None")


class Silence(StatefulProcessor):
    """Of a user: when it was heard last and whether one grace period has begun. A user that is given up is cleared."""

    def __init__(self, interval: int, slack: int, event_time: bool):
        self.interval, self.slack, self.event_time = interval, slack, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "at long, grace boolean")

    def now(self, values: TimerValues) -> int:
        return values.getCurrentWatermarkInMs() if self.event_time else values.getCurrentProcessingTimeInMs()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.heard.get()[0] if self.heard.exists() else None
        found = []
        for at in sorted(pd.concat(list(rows))["at"].tolist()) if self.event_time else [self.now(timerValues)]:
            if self.event_time and last is not None and at - last > self.interval + self.slack:
                found.append((own(key), last, last + self.interval + self.slack))
            last = at if last is None else max(at, last)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.heard.update((int(last), False))
        self.handle.registerTimer(int(last + self.interval + self.slack // 2))
        yield pd.DataFrame(found, columns=["user_id", "last", "silent"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, grace = self.heard.get()
        end = last + self.interval + self.slack
        found = []
        # In event time the clock is the data's and both periods may be over at once; by the machine's clock the second one begins now, for
        # it may have slept.
        if grace or (self.event_time and self.now(timerValues) >= end):
            found.append((own(key), last, end))
            self.heard.clear()
        else:
            self.heard.update((last, True))
            self.handle.registerTimer(int(end if self.event_time else self.now(timerValues) + self.slack - self.slack // 2))
        yield pd.DataFrame(found, columns=["user_id", "last", "silent"])


def silences(stream: DataFrame, user: str, time: str, interval_ms: int, slack_ms: int, event_time: bool = True) -> DataFrame:
    """(user_id, last, silent) in milliseconds: users that weren't heard for interval and slack, and when they were given up.

    After half of the slack a user gets one more period, the other half. With event_time the clock is the watermark of `time` and gaps
    inside a batch count too; otherwise it is the machine's. Rows without a user or a time are passed over.
    """
    rows = stream.where(F.col(user).isNotNull() & F.col(time).isNotNull())
    if event_time:
        rows = rows.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", "0 seconds")
    rows = rows.select(F.col(user).cast("long").alias("user_id"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"), *(["_time"] if event_time else []))
    mode = "EventTime" if event_time else "ProcessingTime"
    return with_state(rows, "user_id").transformWithStateInPandas(Silence(interval_ms, slack_ms, event_time), "user_id long, last long, silent long", "append", mode)


def results_of_work(work: DataFrame, results: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """Rows of work(work, given) and results(work, done, ...) that belong together: done in the time `within` after it was given.

    Both streams have watermarks, so work whose time is over is dropped from state, as are results for which no work can come any more;
    rows that come later than `late` are dropped at once.
    """
    given = work.select(F.col("work").alias("_work"), F.col("given").cast("timestamp").alias("given")).withWatermark("given", late)
    done = results.withColumn("done", F.col("done").cast("timestamp")).withWatermark("done", late)
    in_time = (F.col("done") >= F.col("given")) & (F.col("done") <= F.col("given") + F.expr(f"interval {within}"))
    return done.join(given, (F.col("work") == F.col("_work")) & in_time).drop("_work")
