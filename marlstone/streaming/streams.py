"""Streams over an event log: windows with late data, sessions, joins, state by key, replays and corrected rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder; `ts` becomes a timestamp with a zone, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` go."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's runs of events with no longer pause than `gap`."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_replays(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """The first arrival of each key, remembered for `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of a user's events of two streams, the second within `within` of the first; state is bounded by both watermarks."""
    a = first.withWatermark("ts", late).select(F.col("user_id").alias("user_id"), F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = second.withWatermark("ts", late).select(F.col("user_id").alias("__user"), F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"))
    near = (F.col("user_id") == F.col("__user")) & (F.col("second_ts") > F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).drop("__user")


LEDGER = "thread_id string, seq long, reported long, increment long, status string"


def ledger(reports: DataFrame) -> DataFrame:
    """Increments of cumulative counters by thread: thread_id, seq, reported (null: no report), cumulative.

    A cumulative report is less the thread's last one; a first one that resumes is `missing`, a smaller one `decreased`.
    The state is one number a thread. Rows of a thread in one trigger are taken by seq. An empty thread id matches none.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows, out = pd.concat(list(batches)).sort_values("seq"), []
        for seq, reported, cumulative, resumed in rows[["seq", "reported", "cumulative", "resumed"]].itertuples(index=False):
            if pd.isna(reported):
                out.append((key[0], seq, None, None, "none"))
                continue
            if not cumulative:
                out.append((key[0], seq, int(reported), int(reported), "ok"))
                continue
            if not resumed:
                out.append((key[0], seq, int(reported), int(reported), "ok"))
            elif last is None or key[0] == "":
                out.append((key[0], seq, int(reported), None, "missing"))
            elif reported < last:
                out.append((key[0], seq, int(reported), None, "decreased"))
            else:
                out.append((key[0], seq, int(reported), int(reported - last), "ok"))
            last = int(reported)
        if last is not None:
            state.update((last,))
        made = pd.DataFrame(out, columns=["thread_id", "seq", "reported", "increment", "status"])
        yield made.astype({"reported": "Int64", "increment": "Int64"})

    return reports.groupBy("thread_id").applyInPandasWithState(fold, LEDGER, "last long", "update", GroupStateTimeout.NoTimeout)


IDLE = "user_id long, events long, last_ts timestamp, idle boolean"


def idle_users(events: DataFrame, after: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's count so far after each trigger, and once more with `idle` when the watermark is `after` past the last event."""
    pause = int(pd.Timedelta(after).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
        else:
            for b in batches:
                n += len(b)
                last = max(last, int(b["ts"].max().timestamp() * 1000))
            state.update((n, last))
            state.setTimeoutTimestamp(max(last + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "last_ts": [pd.Timestamp(last, unit="ms")], "idle": [bool(state.hasTimedOut)]})

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(fold, IDLE, "n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def upsert(spark: SparkSession, stream: DataFrame, path: str, keys: list[str], sequence: str, checkpoint: str):
    """Corrected rows into a versioned table: a batch writes the buckets of its keys, and a repeated one changes nothing; `versions.read` gives the table."""
    from marlstone.sources import versions

    def merge(batch: DataFrame, k: int) -> None:
        versions.upsert(batch, path, keys, sequence, batch=k)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """All that has arrived, then an end; the next call goes on from there. What can't append goes out by complete batches."""
    if mode == "append":
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def out(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={k}")

    return stream.writeStream.outputMode(mode).foreachBatch(out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
