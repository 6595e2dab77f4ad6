"""Money-flow operators over transfers (src, dst, amount decimal, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.intervals import in_forward_range


def money(c: Column) -> Column:
    return F.round(c, 2).cast("double")


def pair_flows(tx: DataFrame, min_amount: float = 0.0) -> DataFrame:
    """Total, count and time range of each (src, dst)."""
    out = tx.groupBy("src", "dst").agg(money(F.sum("amount")).alias("total_amount"), F.count(F.lit(1)).alias("transaction_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.where(F.col("total_amount") >= min_amount)


def account_totals(tx: DataFrame) -> DataFrame:
    """account, in/out totals, distinct counterparties each way, degree: one shuffle of exploded endpoints."""
    ends = tx.select(F.explode(F.array(F.struct(F.col("src").alias("account"), F.col("dst").alias("other"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("account"), F.col("src").alias("other"), F.lit(False).alias("out")))).alias("e"), "amount").select("e.*", "amount")
    return ends.groupBy("account").agg(
        money(F.coalesce(F.sum(F.when(~F.col("out"), F.col("amount"))), F.lit(0))).alias("total_in"), money(F.coalesce(F.sum(F.when(F.col("out"), F.col("amount"))), F.lit(0))).alias("total_out"),
        F.countDistinct(F.when(~F.col("out"), F.col("other"))).alias("fan_in"), F.countDistinct(F.when(F.col("out"), F.col("other"))).alias("fan_out"), F.count(F.lit(1)).alias("degree"),
    )


def order_statistic(df: DataFrame, value: str, share: float, buckets: int = 1000) -> DataFrame:
    """The value at index int(n * share) of the ascending order, as one row.

    Values are counted in equal buckets between the smallest and the largest; only the bucket that holds the
    index is put in order.
    """
    v = df.select(F.col(value).cast("double").alias("v"), F.col(value).alias("x")).where("x IS NOT NULL")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = v.join(F.broadcast(span)).withColumns({"b": F.least(F.floor(width * buckets), F.lit(buckets - 1)), "at": F.least(F.floor(F.col("n") * share), F.col("n") - 1)})  # one row
    per = rows.groupBy("b", "at").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.orderBy("b")))  # a row a bucket
    held = per.where("upto > at").agg(F.min(F.struct("b", (F.col("at") - (F.col("upto") - F.col("c"))).alias("rest"))).alias("h")).select("h.b", "h.rest")
    inside = rows.join(F.broadcast(held), "b").groupBy("x", "rest").agg(F.count(F.lit(1)).alias("c"))  # one row
    return inside.withColumn("upto", F.sum("c").over(Window.orderBy("x"))).where("upto > rest").agg(F.min("x").alias("cutoff"))


def pass_through(totals: DataFrame, share: float = 0.9) -> DataFrame:
    """Accounts whose min(in, out) reaches the order statistic at share; confidence min(1, v / max(2 cutoff, 1))."""
    both = totals.where("total_in > 0 AND total_out > 0").withColumn("volume", F.least("total_in", "total_out"))
    cut = order_statistic(both, "volume", share)
    out = both.join(F.broadcast(cut)).where("volume >= cutoff")  # one row
    return out.select("account", "volume", F.round(F.least(F.lit(1.0), F.col("volume") / F.greatest(2 * F.col("cutoff"), F.lit(1.0))), 6).alias("confidence"))


def smurfing(tx: DataFrame, threshold: float = 50000, days: int = 1, least: int = 3) -> DataFrame:
    """First window [t, t + days] of a destination with enough sub-threshold transfers summing over 3 thresholds."""
    rows = tx.where(F.col("amount") < threshold)
    w = in_forward_range("dst", "ts", 86400 * days)
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "total": F.sum("amount").over(w)}).where((F.col("n") >= least) & (F.col("total") > 3 * threshold))
    first = rows.groupBy("dst").agg(F.min(F.struct("ts", "n", "total")).alias("f"))
    total = money(F.col("f.total"))
    return first.select("dst", F.col("f.ts").alias("window_start"), F.col("f.n").alias("n"), total.alias("total_amount"), F.when(F.col("f.total") > 5 * threshold, "HIGH").otherwise("MEDIUM").alias("severity"), F.round(F.least(F.lit(1.0), total / (3 * threshold)), 6).alias("confidence"))


def layering(tx: DataFrame, days: int = 7, least: int = 5) -> DataFrame:
    """First window of an account with enough inflows and outflows; retention = out / max(in, 1)."""
    ends = tx.select(F.col("src").alias("account"), "ts", "amount", F.lit(1).alias("o")).unionByName(tx.select(F.col("dst").alias("account"), "ts", "amount", F.lit(0).alias("o")))
    w = in_forward_range("account", "ts", 86400 * days)
    pick = lambda o, c: F.when(F.col("o") == o, c)
    rows = ends.withColumns({"n_in": F.count(pick(0, F.lit(1))).over(w), "n_out": F.count(pick(1, F.lit(1))).over(w), "s_in": F.sum(pick(0, F.col("amount"))).over(w), "s_out": F.sum(pick(1, F.col("amount"))).over(w)})
    first = rows.where((F.col("n_in") >= least) & (F.col("n_out") >= least)).groupBy("account").agg(F.min(F.struct("ts", "n_in", "n_out", "s_in", "s_out")).alias("f"))
    retention = F.round(F.abs(1 - F.col("f.s_out").cast("double") / F.greatest(F.col("f.s_in").cast("double"), F.lit(1.0))), 6)
    out = first.select("account", F.col("f.ts").alias("window_start"), F.col("f.n_in").alias("n_in"), F.col("f.n_out").alias("n_out"), money(F.col("f.s_in") + F.col("f.s_out")).alias("total_amount"), retention.alias("retention"))
    return out.withColumns({"severity": F.when(F.col("retention") < 0.05, "HIGH").when(F.col("retention") < 0.2, "MEDIUM").otherwise("LOW"), "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 5 * F.col("retention"))), 6)})


def busy_accounts(tx: DataFrame, factor: float = 3, floor: float = 10) -> DataFrame:
    """Accounts with more transfers than max(factor * median, floor)."""
    n = tx.select(F.explode(F.array("src", "dst")).alias("account")).groupBy("account").count()
    cut = n.agg(F.greatest(factor * F.median("count"), F.lit(float(floor))).alias("cut"))
    return n.join(F.broadcast(cut)).where("count > cut").select("account", F.col("count").alias("n"), F.col("cut").alias("threshold"))


def row_window_bursts(tx: DataFrame, rows: int = 7, least: int = 5, factor: float = 3) -> DataFrame:
    """Counts over the next observed dates (rows, not days) that exceed factor times a window's average."""
    daily = tx.where("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day")).count()
    mean = daily.agg((F.sum("count") / F.count(F.lit(1))).alias("mean"))
    w = Window.orderBy("day").rowsBetween(0, rows - 1)
    out = daily.withColumns({"n": F.sum("count").over(w), "until": F.max("day").over(w)}).join(F.broadcast(mean))
    return out.where((F.col("n") >= least) & (F.col("n") > factor * rows * F.col("mean"))).select("day", "until", "n", F.round("mean", 6).alias("daily_mean"))


def gang_report(members: DataFrame, tx: DataFrame) -> DataFrame:
    """members (gang, account): counts and sums per gang with the 400/200/80 risk ladder on 0.02 n + total / 1e5."""
    touched = tx.join(members, (tx.src == members.account)).select("gang", "amount").unionByName(tx.join(members, tx.dst == members.account).select("gang", "amount"))
    out = touched.groupBy("gang").agg(F.count(F.lit(1)).alias("n"), money(F.sum("amount")).alias("total_amount"))
    risk = F.round(0.02 * F.col("n") + F.col("total_amount") / 100000, 4)
    return out.withColumn("risk", risk).withColumn("level", F.when(risk >= 400, "CRITICAL").when(risk >= 200, "HIGH").when(risk >= 80, "MEDIUM").otherwise("LOW"))


def account_risk(patterns: DataFrame) -> DataFrame:
    """patterns (account, severity, confidence): mean of severity weight (1, 0.5, 0.2) times confidence, at most 1."""
    weight = F.when(F.col("severity") == "HIGH", 1.0).when(F.col("severity") == "MEDIUM", 0.5).otherwise(0.2)
    out = patterns.groupBy("account").agg(F.sum(weight * F.col("confidence")).alias("s"), F.count(F.lit(1)).alias("patterns"))
    return out.select("account", F.round(F.least(F.lit(1.0), F.col("s") / F.col("patterns")), 6).alias("risk"), "patterns")


def shell_accounts(tx: DataFrame, holders: DataFrame, factor: float = 3, floor: float = 10, least: float = 0.5) -> DataFrame:
    """Busy accounts whose holder is little known: holders (account, has_name, has_phone, has_location); an unknown holder scores 0."""
    n = tx.select(F.explode(F.array("src", "dst")).alias("account"), "amount").groupBy("account").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("s"))
    cut = n.agg(F.greatest(factor * F.median("n"), F.lit(float(floor))).alias("cut"))
    known = sum((F.when(F.col(c), 1.0).otherwise(0.0) for c in ("has_name", "has_phone", "has_location")), F.lit(0.0)) / 3
    rows = n.join(F.broadcast(cut)).where("n > cut").join(holders.select("account", known.alias("known")), "account", "left")  # one row
    rows = rows.withColumn("completeness", F.coalesce("known", F.lit(0.0))).where(F.col("completeness") < least)
    return rows.select("account", "n", money(F.col("s")).alias("volume"), F.round("completeness", 6).alias("completeness"), F.round(1 - F.col("completeness"), 6).alias("confidence"))
