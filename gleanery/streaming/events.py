"""Streams of change events: debounce, dedupe, throttle, drains, upserts by batch. Each works on batch frames too where it can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

#: Quiet spans of keystrokes, refreshes, teaching, backups and the interactive window.
KEYSTROKE, REFRESH, TEACH, BACKUP, INTERACTIVE = "80 milliseconds", "300 milliseconds", "1200 milliseconds", "30 seconds", "8 seconds"


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def debounce(events: DataFrame, quiet: str, keys: list[str], late: str = "1 minute", time: str = "ts") -> DataFrame:
    """keys, started, ended, events of each burst: events less than ``quiet`` apart. A streaming source gets a watermark."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    grouped = source.groupBy(F.session_window(time, quiet).alias("w"), *keys).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("events"))
    return grouped.select(*keys, "started", "ended", "events")


def once(events: DataFrame, keys: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Each key's first event; redelivered ones go. On a stream the first to arrive, for as long as the watermark allows; on a batch the first by ``time`` (of equal times one of them)."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(time))).filter("_r = 1").drop("_r")


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 minute", time: str = "ts") -> DataFrame:
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def throttle(events: DataFrame, key: str, interval_ms: int, time: str = "ts", late: str | None = None) -> DataFrame:
    """Events of a key at least ``interval_ms`` after the last one let through; state is the time of that one.

    With ``late``, the stream gets a watermark, and a key's state goes when it has passed the interval, since what comes after is let through anyway; without, each key's state stays.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else -(1 << 60)
        for frame in frames:
            keep = []
            frame = frame.sort_values(time, kind="stable")
            for now in frame[time].astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[frame[time].dt.unit]:
                ok = now - last >= interval_ms
                keep.append(ok)
                last = now if ok else last
            yield frame[keep][[key, time]]
        state.update((int(last),))
        if late is not None and last + interval_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(last) + interval_ms)
        elif late is not None:
            state.remove()

    kind = dict(events.dtypes)
    own = events.select(key, time) if late is None else events.select(key, time).withWatermark(time, late)
    expiry = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    return own.groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {time} {kind[time]}", "last long", "append", expiry)


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off all that is there now in batches, each seen by ``apply`` with its number; it runs to the end and stops."""
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch function that keeps the last row of each key in a table; a repeated batch changes nothing.

    Versions are folders by batch number, so a reader of version n isn't disturbed while n + 1 is written.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else batch.unionByName(spark.read.parquet(f"{path}/version={number - 1}").drop("version"))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/version={number}")

    return apply
