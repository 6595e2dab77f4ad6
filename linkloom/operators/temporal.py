"""Activity detectors over (entity, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.intervals import in_forward_range, seconds


def burst_z(events: DataFrame, entity: str, ts: str = "ts", z: float = 3.0, least: int = 5) -> DataFrame:
    """24-hour look-ahead counts from each active hour, by z-score over the entity's hours (sample deviation).

    Counts come from hourly totals: the frame holds hours, not events.
    """
    hourly = events.groupBy(entity, F.date_trunc("hour", F.col(ts).cast("timestamp")).alias("hour")).count()
    ahead = Window.partitionBy(entity).orderBy(F.unix_timestamp("hour")).rangeBetween(0, 86399)
    w = Window.partitionBy(entity)
    out = hourly.withColumn("n", F.sum("count").over(ahead)).withColumns({"m": F.avg("n").over(w), "sd": F.stddev_samp("n").over(w), "starts": F.count(F.lit(1)).over(w), "events": F.sum("count").over(w)})
    score = F.round((F.col("n") - F.col("m")) / F.col("sd"), 6)
    out = out.where(f"starts >= {least} AND events >= {least} AND sd > 0").withColumn("z", score).where(F.col("z") > z)
    return out.select(entity, F.col("hour").cast("timestamp_ntz").alias("window_start"), "n", "z", F.when(F.col("z") > 5, "HIGH").otherwise("MEDIUM").alias("severity"), F.round(F.least(F.lit(1.0), F.col("z") / 10), 6).alias("confidence"))


def rate_of_four(events: DataFrame, entity: str, order: list[str], ts: str = "ts", factor: float = 3.0) -> DataFrame:
    """Four consecutive events at more than factor times the entity's daily rate (whole days; 0 counts as 0.1 in the window, as 1 in the baseline)."""
    w = Window.partitionBy(entity)
    ahead = F.lead(ts, 3).over(w.orderBy(*order))
    days = lambda a, b: F.floor((seconds(b) - seconds(a)) / 86400)
    rows = events.withColumns({"until": ahead, "n": F.count(F.lit(1)).over(w), "lo": F.min(ts).over(w), "hi": F.max(ts).over(w)}).where("until IS NOT NULL AND n >= 4")
    span, window = days(F.col("lo"), F.col("hi")), days(F.col(ts), F.col("until"))
    base = F.col("n") / F.greatest(span, F.lit(1))
    rate = F.lit(4.0) / F.when(window > 0, window.cast("double")).otherwise(0.1)
    rows = rows.withColumns({"baseline": base, "rate": rate}).where(F.col("rate") > factor * F.col("baseline"))
    return rows.groupBy(entity).agg(F.count(F.lit(1)).alias("windows"), F.min(ts).alias("first_start"), F.round(F.max("rate"), 6).alias("peak_rate"), F.round(F.max("baseline"), 6).alias("baseline_rate"))


def dormant(events: DataFrame, entity: str, ts: str = "ts", gap_days: int = 30, within_days: int = 7, least: int = 3) -> DataFrame:
    """Reactivations: a gap of gap_days, then at least `least` events in less than within_days."""
    w = Window.partitionBy(entity).orderBy(ts)
    ahead = in_forward_range(entity, ts, within_days * 86400 - 1)
    rows = events.withColumns({"prev": F.lag(ts).over(w), "n": F.count(F.lit(1)).over(ahead)})
    gap = F.floor((seconds(ts) - seconds("prev")) / 86400)
    rows = rows.withColumn("gap_days", gap).where(f"gap_days >= {gap_days} AND n >= {least}")
    return rows.select(entity, F.col(ts).alias("reactivated"), "gap_days", "n", F.round(F.least(F.lit(0.9), F.col("gap_days") / 90), 6).alias("confidence"))


def synchronized_hours(events: DataFrame, entity: str, ts: str = "ts", least: int = 5) -> DataFrame:
    """Clock hours with at least so many distinct entities."""
    out = events.groupBy(F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("hour")).agg(F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("n"))
    return out.where(F.col("entities") >= least).withColumn("confidence", F.round(F.least(F.lit(0.8), F.col("entities") / 10), 6))


def week_key(ts: str) -> Column:
    """Year and Monday-based week number as %Y-%W has it."""
    monday0 = (F.dayofweek(ts) + 5) % 7
    return F.concat(F.date_format(ts, "yyyy"), F.lit("-"), F.lpad(F.floor((F.dayofyear(ts) + 6 - monday0) / 7).cast("string"), 2, "0"))


def busy_weeks(events: DataFrame, ts: str = "ts", factor: float = 2.5) -> DataFrame:
    """Weeks with more than factor times the mean number of rows a week."""
    weekly = events.where(F.col(ts).isNotNull()).groupBy(week_key(ts).alias("week")).count()
    mean = weekly.agg((F.sum("count") / F.count(F.lit(1))).alias("mean"))
    out = weekly.join(F.broadcast(mean)).where(F.col("count") > factor * F.col("mean"))  # one row
    return out.select("week", F.col("count").alias("n"), F.round("mean", 6).alias("weekly_mean"))


def velocity(events: DataFrame, entity: str, ts: str = "ts", factor: float = 5.0, least: int = 3) -> DataFrame:
    """Rate of the last 7 days over that of the 23 before; both windows hold the boundary instant."""
    latest = events.agg(F.max(seconds(ts)).alias("now"))
    age = F.col("now") - seconds(ts)
    rows = events.join(F.broadcast(latest)).groupBy(entity).agg(F.count(F.when(age.between(0, 7 * 86400), 1)).alias("recent"), F.count(F.when(age.between(7 * 86400, 30 * 86400), 1)).alias("before"))  # one row
    ratio = F.round((F.col("recent") / 7) / (F.col("before") / 23), 6)
    return rows.where(F.col("before") >= least).withColumn("ratio", ratio).where(F.col("ratio") > factor).withColumn("severity", F.when(F.col("ratio") > 20, "HIGH").otherwise("MEDIUM"))


def period_change(events: DataFrame, entity: str, ts: str, now: str, days: int) -> DataFrame:
    """Counts of [now - 2w, now - w) and [now - w, now] with percent change and its ladder."""
    age = seconds(F.lit(now).cast("timestamp_ntz")) - seconds(ts)
    span = days * 86400
    rows = events.groupBy(entity).agg(F.count(F.when((age > span) & (age <= 2 * span), 1)).alias("previous"), F.count(F.when(age.between(0, span), 1)).alias("current"))
    delta = F.when(F.col("previous") > 0, F.round(100.0 * (F.col("current") - F.col("previous")) / F.col("previous"), 4))
    size = F.abs(F.coalesce(delta, F.when(F.col("current") > 0, 100.0).otherwise(0.0)))
    level = F.when(size >= 300, "CRITICAL").when(size >= 150, "HIGH").when(size >= 75, "MEDIUM").when(size >= 25, "LOW").otherwise("NONE")
    return rows.withColumns({"delta_percent": delta, "level": level})


def cumulative_degree(edges: DataFrame, ts: str = "ts") -> DataFrame:
    """Running number of edges of each node by day."""
    daily = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.to_date(ts).alias("day")).groupBy("node", "day").count()
    return daily.select("node", "day", F.sum("count").over(Window.partitionBy("node").orderBy("day")).alias("degree"))


def node_features(edges: DataFrame, ts: str = "ts") -> DataFrame:
    """First, last, count, events a day (span at least one day), burstiness = deviation over mean of the gaps."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), seconds(ts).alias("t"))
    gaps = ends.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("node").orderBy("t")))
    out = gaps.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_s"), F.max("t").alias("last_s"), F.avg("gap").alias("m"), F.stddev_samp("gap").alias("sd"))
    rate = F.round(F.col("n") / F.greatest((F.col("last_s") - F.col("first_s")) / 86400, F.lit(1.0)), 6)
    return out.select("node", "n", "first_s", "last_s", rate.alias("per_day"), F.round(F.when(F.col("m") > 0, F.coalesce("sd", F.lit(0.0)) / F.col("m")).otherwise(0.0), 4).alias("burstiness"))
