"""Top-k for each key and window of event time over a stream, held in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def epoch_seconds(time):
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def _kept(k: int, width: int):
    """Keep the k best of a (key, window) in its state; give them out and forget them once the watermark is behind the window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, start = key[0], int(key[1])
        if state.hasTimedOut:
            values, ties = state.get
            state.remove()
            yield pd.DataFrame({"key": [name] * len(values), "start": [start] * len(values), "rank": range(1, len(values) + 1), "value": values, "tie": ties})
            return
        values, ties = state.getOption or ([], [])
        best = list(zip(values, ties, strict=True))
        for rows in batches:
            best = sorted([*best, *zip(rows["value"].tolist(), rows["tie"].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
        state.update(([v for v, _ in best], [t for _, t in best]))
        state.setTimeoutTimestamp((start + width) * 1000)

    return run


def windowed_topk(stream: DataFrame, key: str, time: str, value: str, tie: str, k: int, width: int, delay: int) -> DataFrame:
    """``key, start, rank, value, tie``: the k largest values of each key in each window of ``width`` seconds, ties by the lesser ``tie``.

    A window is given out once, when the largest time seen is more than
    ``delay`` seconds behind its end; rows that come later are dropped, and its
    state goes. The state of a key and window is k rows. Rows with a null
    value, tie or time take no part; a null key is a key, written ''.
    """
    at = epoch_seconds(F.col(time))
    rows = stream.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.timestamp_seconds(at).alias("at"), (F.floor(at / width) * width).cast("long").alias("start"), F.col(value).cast("double").alias("value"), F.col(tie).cast("long").alias("tie"))
    rows = rows.dropna(subset=["at", "value", "tie"]).withWatermark("at", f"{delay} seconds")
    return rows.groupBy("key", "start").applyInPandasWithState(_kept(k, width), "key string, start long, rank int, value double, tie long", "values array<double>, ties array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def drained(spark: SparkSession, rows: DataFrame, store: str) -> DataFrame:
    """Run a stream as far as its source goes, appending to files in ``store``; a later run goes on behind it with the state it left."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{store}/rows").option("checkpointLocation", f"{store}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{store}/rows")
