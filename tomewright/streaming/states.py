"""Stateful streams: revisions by compare-and-set, expiring one-time states, latest-wins tables, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _keyed(rows: DataFrame, key: str):
    """``rows`` by key; on a table instead of a stream the endpoint that keeps track of states has to be started first."""
    if not rows.isStreaming:
        rows.sparkSession.streams.active  # noqa: B018
    return rows.groupBy(key)


class Revisions(StatefulProcessor):
    """Per user a revision and a document: an edit that names the current revision is accepted, another gets what there is."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("library", "revision long, document string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        revision, document = self.state.get() if self.state.exists() else (0, "")
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            accepted = row.base == revision
            if accepted:
                revision, document = revision + 1, row.document
            out.append((key[0], row.seq, accepted, revision, document))
        self.state.update((revision, document))
        yield pd.DataFrame(out, columns=["user_id", "seq", "accepted", "revision", "document"])

    def close(self) -> None:
        pass


def compare_and_set(edits: DataFrame) -> DataFrame:
    """(user_id, seq, accepted, revision, document) for a stream of edits (user_id, seq, base, document).

    Needs the RocksDB state store. Edits of one user within a batch are taken in the order of seq.
    """
    return _keyed(edits, "user_id").transformWithStateInPandas(Revisions(), "user_id string, seq long, accepted boolean, revision long, document string", "update", "none")


#: Keys that the tokens of ``one_time`` are dealt to. A call of Python costs milliseconds, so it gets the tokens of one key at once.
BUCKETS = 4096


class OneTime(StatefulProcessor):
    """Tokens, each issued with a lifetime, handed out on the first claim within it, and forgotten then.

    Of a batch, only a token's first row needs what was there and only its last one changes it; a claim within the batch gets
    what the row before it issued.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("pending", "token string", "payload string", ttlDurationMs=self.seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        e = pd.concat(list(rows), ignore_index=True)
        e = e.assign(t=pd.factorize(e["token"], use_na_sentinel=False)[0]).sort_values(["t", "seq"], ignore_index=True)
        issue, first = e["kind"] == "issue", e["t"].ne(e["t"].shift())
        payload = e["payload"].shift().where(issue.shift(fill_value=False) & ~first).astype(object)
        ends = e[e["t"].ne(e["t"].shift(-1))]
        if self.state.exists():
            for i in e.index[first & ~issue]:
                if self.state.containsKey((e.at[i, "token"],)):
                    payload[i] = self.state.getValue((e.at[i, "token"],))[0]
            for token in ends.loc[~issue[ends.index], "token"]:
                self.state.removeKey((token,))
        for row in ends[issue[ends.index]].itertuples(index=False):
            self.state.updateValue((row.token,), (row.payload,))
        yield e.assign(payload=payload.where(payload.notna(), None))[~issue][["token", "seq", "payload"]]

    def close(self) -> None:
        pass


def one_time(events: DataFrame, seconds: int) -> DataFrame:
    """(token, seq, payload) for each claim in a stream of events (token, seq, kind issue or claim, payload)."""
    dealt = events.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)))
    return _keyed(dealt, "bucket").transformWithStateInPandas(OneTime(seconds), "token string, seq long, payload string", "update", "processingtime")


def latest_wins(events: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key so far; a streaming aggregate for update or complete mode."""
    return events.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v")).select(*key, "v.*")


def windowed_counts(events: DataFrame, at: str = "ts", by: tuple[str, ...] = (), width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """An extension of our own: counts per tumbling window, with a watermark that bounds the state of a stream.

    Times without a zone are taken as UTC, since a watermark needs a point in time.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def upsert_sink(path: str, key: list[str], order: list[str], values: list[str], buckets: int = 64):
    """A foreachBatch function that folds each batch into a Parquet table of latest rows, partitioned by buckets of the key.

    Only the buckets that a batch touches are read and written again, and their old files go when the new ones are there. A
    batch that is run again leaves the table as it is.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*key, *order, *values, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket"))
        touched = [r[0] for r in new.select("bucket").distinct().collect()]  # numbers, as many as buckets at most
        if not touched:
            return
        try:
            new = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched)).unionByName(new)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        pick = new.groupBy("bucket", *key).agg(F.max_by(F.struct(*order, *values), F.struct(*order)).alias("r")).select(*key, "r.*", "bucket")
        pick.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


#: Seconds between two polls of the account store, between two looks at the clock, and from an edit to its sync.
POLL, TICK, SETTLE = 60, 300, 0.4


def every(stream: DataFrame, write, seconds: float, checkpoint: str):
    """A running query that hands each batch of ``stream`` to ``write``, one at a time, every so many seconds."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{round(seconds * 1000)} milliseconds").start()
