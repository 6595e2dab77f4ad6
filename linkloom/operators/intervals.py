"""Range windows and band joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def seconds(ts: Column | str) -> Column:
    """Whole seconds of a timestamp without time zone."""
    return F.unix_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def in_forward_range(key: str, ts: str, span: int) -> WindowSpec:
    """Rows of the key within [ts, ts + span] (seconds, closed)."""
    return Window.partitionBy(key).orderBy(seconds(ts)).rangeBetween(0, span)


def band_semi_join(left: DataFrame, right: DataFrame, on: list[str], ts: str, width: int, extra: Column | None = None) -> DataFrame:
    """Left rows with a right row of the same keys within width seconds: time buckets, one before and one after."""
    own = left.withColumn("__b", F.explode(F.array(*(F.floor(seconds(ts) / width) + k for k in (-1, 0, 1))))).withColumn("__t", seconds(ts))
    other = right.select(*(F.col(c).alias(f"__r_{c}") for c in right.columns), F.floor(seconds(ts) / width).alias("__rb"), seconds(ts).alias("__rt"))
    near = (F.col("__b") == F.col("__rb")) & (F.abs(F.col("__t") - F.col("__rt")) <= width)
    for c in on:
        near &= F.col(c) == F.col(f"__r_{c}")
    if extra is not None:
        near &= extra
    return own.join(other, near, "left_semi").drop("__b", "__t").distinct()


def before_incident(events: DataFrame, incidents: DataFrame, key: str, ts: str, hours: int = 1) -> DataFrame:
    """Pairs of an incident and the events of its key in [incident - hours, incident).

    incidents: incident_id, the key, incident_ts. The equi-join is on the key and the hour bucket.
    """
    span = hours * 3600
    e = events.withColumn("__t", seconds(ts)).withColumn("__b", F.explode(F.array(F.floor(F.col("__t") / span), F.floor(F.col("__t") / span) + 1)))
    i = incidents.select("incident_id", F.col(key).alias("__k"), seconds("incident_ts").alias("__i"), F.floor(seconds("incident_ts") / span).alias("__ib"))
    hit = (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__ib")) & (F.col("__t") >= F.col("__i") - span) & (F.col("__t") < F.col("__i"))
    return e.join(i, hit).drop("__t", "__b", "__k", "__i", "__ib")
