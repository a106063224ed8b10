"""Streams that act when time has come: states that expire by a timer, and freshness that flips at its end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.dates import instant
from ..storage import Snapshots, snapshot_sink


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


class Claims(StatefulProcessor):
    """Per token: issued with a lifetime, handed out on the first claim within it, and told to have expired by a timer."""

    def __init__(self, seconds: int):
        self.life = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", "payload string, seq long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.state.get() if self.state.exists() else None
        timer = now[2] if now else None
        frame = pd.concat(list(rows))
        for at, seq, kind, payload in sorted(zip(_millis(frame["at"]), frame["seq"], frame["kind"], frame["payload"]), key=lambda r: r[:2]):
            if now and now[2] <= at:  # the watermark lags behind: time itself decides
                out.append((key[0], now[1], now[2], "expired", now[0]))
                now = None
            if kind == "issue":
                now = (payload, seq, at + self.life)
            else:
                out.append((key[0], seq, at, "claimed" if now else "refused", now[0] if now else None))
                now = None
        if timer is not None and (not now or now[2] != timer):
            self.handle.deleteTimer(timer)
        if now:
            self.state.update(tuple(int(v) if k else v for k, v in enumerate(now)))
            if now[2] != timer:
                self.handle.registerTimer(int(now[2]))
        else:
            self.state.clear()
        yield _frame(out, ["token", "seq", "at", "outcome", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        payload, seq, until = self.state.get()
        self.state.clear()
        yield _frame([(key[0], seq, until, "expired", payload)], ["token", "seq", "at", "outcome", "payload"])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    out["at"] = pd.to_datetime(out["at"].astype("int64"), unit="ms")
    return out


def expiring_claims(events: DataFrame, seconds: int, late: str = "0 seconds") -> DataFrame:
    """(token, seq, at, outcome, payload) for a stream of events (token, seq, kind issue or claim, payload, at timestamp).

    A claim gets the payload of the last issue if that is less than ``seconds`` old and was not claimed: "claimed", else
    "refused" and null. An issue that nobody claims is told as "expired" at its end, with the seq of the issue: by a timer once
    the watermark is there, or by a later event of its token. Timers and states go with it, so that the state holds only
    what can still be claimed. A later issue replaces an earlier one silently. Events of one token are taken in order of time
    within a batch; rows later than ``late`` are dropped by the watermark. Times without a zone are UTC.
    """
    timed = events.select(F.col("token").cast("string").alias("token"), F.col("seq").cast("long").alias("seq"), "kind", "payload", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.groupBy("token").transformWithStateInPandas(Claims(seconds), "token string, seq long, at timestamp, outcome string, payload string", "append", "eventtime", eventTimeColumnName="at")


class Freshness(StatefulProcessor):
    """Per series: whether its coverage is current, told when that changes; a timer at the end of validity tells the flip."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("told", "current boolean, starts long, ends long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        was, starts, ends = self.state.get() if self.state.exists() else (None, None, None)
        set_ = {t for t in (starts, ends) if t is not None}
        frame = pd.concat(list(rows))
        for at, good, since, until in sorted(zip(_millis(frame["at"]), frame["good"], frame["since"], frame["until"]), key=lambda r: r[0]):
            for t, now in ((starts, True), (ends, False)):  # what a timer would have told before this event
                if t is not None and t <= at:
                    out.append((key[0], t, now))
                    was = now
            starts = ends = None
            now = bool(good) and since <= at < until
            if was is None or now != was:
                out.append((key[0], at, now))
                was = now
            if good and at < since < until:
                starts = int(since)
            if good and at < until and since < until:
                ends = int(until)
        for t in set_ - {starts, ends}:
            self.handle.deleteTimer(t)
        for t in {starts, ends} - set_ - {None}:
            self.handle.registerTimer(t)
        self.state.update((bool(was), starts, ends))
        yield _frame(out, ["series_id", "at", "current"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        _, starts, ends = self.state.get()
        self.state.update((at == starts, None if at == starts else starts, None if at == ends else ends))
        yield _frame([(key[0], at, at == starts)], ["series_id", "at", "current"])

    def close(self) -> None:
        pass


def freshness(coverage: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(series_id, at, current): the changes of ``coverage_current`` over a stream of coverage rows (series_id, coverage, at timestamp).

    The first row of a series tells its state, a later one only a change; from then on timers at assessedAt and validUntil
    tell when it becomes current or stale, so that no clock has to look at all series again. The last change at or before an
    instant is what ``coverage_current`` says of the last row then, for every instant that the watermark has passed.
    """
    c = F.col("coverage")
    none = F.lit(0).cast("long")
    good = F.coalesce((c["status"] == "verified") & c["current"] & instant(c["assessedAt"]).isNotNull() & instant(c["validUntil"]).isNotNull(), F.lit(False))
    ms = lambda x: F.coalesce(F.unix_millis(instant(x)), none)
    rows = coverage.select(F.col("series_id").cast("string").alias("series_id"), F.col("at").cast("timestamp").alias("at"), good.alias("good"), ms(c["assessedAt"]).alias("since"), ms(c["validUntil"]).alias("until"))
    timed = rows.withWatermark("at", late)
    return timed.groupBy("series_id").transformWithStateInPandas(Freshness(), "series_id string, at timestamp, current boolean", "append", "eventtime", eventTimeColumnName="at")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Take all that is there, timers that are due included, append it to Parquet files and stop; a restart goes on where it ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def state_at(changes: DataFrame, key: str, value: str, at: Column) -> DataFrame:
    """(key, value) as of an instant, from changes (key, at, value): the last one at or before it."""
    return changes.where(F.col("at") <= at).groupBy(key).agg(F.max_by(value, "at").alias(value))


def sync(stream: DataFrame, table: Snapshots, name: str, checkpoint: str) -> None:
    """Merge all that a stream of rows has into a versioned table and stop; to be called again whenever there may be more.

    A run that is killed between the merge and the note of it in ``checkpoint`` gives the same batch again, which the table knows by
    ``name`` and number. So no row is lost, and none counts twice, whenever a run ends.
    """
    write = snapshot_sink(table, name, stream.columns)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
