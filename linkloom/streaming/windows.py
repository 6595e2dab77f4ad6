"""Structured Streaming versions of the window detectors; each equals its batch operator on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    """A file stream; ts becomes a timestamp for watermarks."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours: hour, user_id, n. Distinct users of an hour are counted by synchronized() on what this wrote."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("hour"), "user_id", "n")


def synchronized(counts: DataFrame, least: int = 5) -> DataFrame:
    """hour, entities, n of hours with enough distinct users, from written hourly_counts()."""
    out = counts.groupBy("hour").agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("n"))
    return out.where(F.col("entities") >= least)


def sliding_counts(events: DataFrame, span: str = "24 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def interval_join(left: DataFrame, right: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Pairs of the two streams' events of one user within so many minutes of each other."""
    a = left.select(F.col("user_id").alias("ua"), F.col("ts").alias("ta"), F.col("event_id").alias("a")).withWatermark("ta", late)
    b = right.select(F.col("user_id").alias("ub"), F.col("ts").alias("tb"), F.col("event_id").alias("b")).withWatermark("tb", late)
    return a.join(b, F.expr(f"ua = ub AND tb BETWEEN ta - INTERVAL {minutes} MINUTES AND ta + INTERVAL {minutes} MINUTES")).select("a", "b")


def deduplicated(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


STRUCTURED = "user_id bigint, window_start timestamp, n bigint, total double"


def structuring(events: DataFrame, threshold: float, span: int = 86400, least: int = 3) -> DataFrame:
    """The first window of a user with enough values below the threshold that sum to over three thresholds: the rows of the last span are the state, dropped once the user is reported.

    events: user_id, ts, value. A batch may come in any order within itself.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        done, times, values = state.get if state.exists else (False, [], [])
        times, values = list(times), list(values)
        for frame in frames:
            if not done:
                times += (frame["ts"].astype("datetime64[us]").astype("int64")).tolist()
                values += frame["value"].tolist()
        if done:
            return
        order = sorted(range(len(times)), key=lambda i: (times[i], values[i]))
        times, values = [times[i] for i in order], [values[i] for i in order]
        end, total = 0, 0.0
        for i, t in enumerate(times):
            while end < len(times) and times[end] // 1_000_000 <= t // 1_000_000 + span:
                total += values[end]
                end += 1
            if end - i >= least and round(total, 6) > 3 * threshold:
                state.update((True, [], []))
                yield pd.DataFrame({"user_id": [key[0]], "window_start": [pd.Timestamp(t, unit="us")], "n": [end - i], "total": [round(total, 2)]})
                return
            total -= values[i]
        keep = [i for i, t in enumerate(times) if t >= times[-1] - span * 1_000_000]
        state.update((False, [times[i] for i in keep], [values[i] for i in keep]))

    small = events.where(F.col("value") < threshold).select("user_id", "ts", "value")
    return small.groupBy("user_id").applyInPandasWithState(step, STRUCTURED, "done boolean, times array<bigint>, vals array<double>", "append", "NoTimeout")


def missing_windows(batch: DataFrame, stream: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """keys, batch count, stream count where the two differ: rows that came too late for the stream, and windows still open."""
    a, b = batch.select(*keys, F.col(count).alias("batch_n")), stream.select(*keys, F.col(count).alias("stream_n"))
    rows = a.join(b, keys, "left").withColumn("stream_n", F.coalesce("stream_n", F.lit(0).cast("long")))
    return rows.where("batch_n <> stream_n")


def dropped_late(stream) -> int:
    """Rows that a finished query dropped behind its watermark, by its progress."""
    return sum(int(o.numRowsDroppedByWatermark) for p in stream.recentProgress for o in p.stateOperators)


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote as Parquet, at path or beside the checkpoint; in complete mode each batch replaces the last."""
    path = path or f"{checkpoint.rstrip('/')}-out"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def publish(rows: DataFrame, folder: str, topic: str) -> None:
    """Appends an envelope {topic, published_at, payload} for subscribers of a folder."""
    rows.select(F.lit(topic).alias("topic"), F.current_timestamp().alias("published_at"), F.to_json(F.struct(*rows.columns)).alias("payload")).write.mode("append").partitionBy("topic").parquet(folder)


def subscribe(spark: SparkSession, folder: str, topic: str) -> DataFrame:
    schema = "published_at timestamp, payload string, topic string"
    return spark.readStream.schema(schema).parquet(folder).where(F.col("topic") == topic)
