"""Event streams: bounded state by watermarks; each function takes a streaming or a batch frame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_by_window(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and sums of value by time window; later than `late` is dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events with less than a gap between neighbours."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("n"))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time with or without a zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def batch_sessions(events: DataFrame, time: str, user: str, gap_seconds: int) -> DataFrame:
    """sessions() of a bounded table by windows: a new session where the time since the last event is the gap or more."""
    order = Window.partitionBy(user).orderBy(time, "event_id")
    since = micros(F.col(time)) - F.lag(micros(F.col(time))).over(order)
    marked = events.withColumn("session", F.sum(F.coalesce((since >= gap_seconds * 1_000_000).cast("int"), F.lit(0))).over(order))
    return marked.groupBy(user, "session").agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))


def dedupe(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_totals(events: DataFrame, user: str, value: str) -> DataFrame:
    """(user, n, total) after each micro-batch, from state of two numbers per user."""
    kind = events.schema[user].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n += len(batch)
            total += float(batch[value].sum())
        state.update((n, total))
        yield pd.DataFrame({user: [key[0]], "n": [n], "total": [total]})

    return events.select(user, value).groupBy(user).applyInPandasWithState(update, f"`{user}` {kind}, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout)


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, exactly once, as Parquet."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def json_number(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).try_cast("bigint")
