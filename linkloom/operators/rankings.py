"""Rankings by several methods, time buckets, top lists, knowledge gaps and next steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.intervals import seconds


def method_ranks(scores: DataFrame, key: str = "node") -> DataFrame:
    """scores (node, method, score) with rank from 1 (highest, ties by id) and percentile 1 - rank / n of each method."""
    w = Window.partitionBy("method")
    rank = F.row_number().over(w.orderBy(F.desc("score"), key)).cast("long")
    return scores.withColumn("rank", rank).withColumn("percentile", F.round(1 - F.col("rank") / F.count(F.lit(1)).over(w), 4))


def agreement(ranks: DataFrame, key: str = "node") -> DataFrame:
    """key, agreement = 1 - 3 sample deviations of the percentiles (0 at least; 0.5 for a single method), level."""
    out = ranks.groupBy(key).agg(F.round(F.when(F.count(F.lit(1)) < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 3 * F.stddev_samp("percentile"))), 4).alias("agreement"))
    a = F.col("agreement")
    return out.withColumn("level", F.when(a >= 0.8, "STRONG").when(a >= 0.5, "MODERATE").when(a >= 0.25, "WEAK").otherwise("DISAGREEMENT"))


def disagreements(ranks: DataFrame, n: int, key: str = "node") -> DataFrame:
    """The n nodes with the widest spread of ranks: the methods that rank them worst (high) and best (low)."""
    by = F.struct("rank", "method")
    out = ranks.groupBy(key).agg(F.max(by).alias("h"), F.min(by).alias("l"))
    out = out.select(key, F.col("h.method").alias("high_method"), F.col("h.rank").alias("high_rank"), F.col("l.method").alias("low_method"), F.col("l.rank").alias("low_rank"), (F.col("h.rank") - F.col("l.rank")).alias("spread"))
    return out.where("spread > 0").orderBy(F.desc("spread"), key).limit(n)


def ranked(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, rank (1 for the largest, ties by key), share (rows of a value not above it).

    Counts of distinct values give what lies above each; only rows of one value are put in order together.
    """
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    down, up = Window.orderBy(F.desc(value)), Window.orderBy(value)
    per = per.select(value, (F.sum("c").over(down) - F.col("c")).alias("above"), F.sum("c").over(up).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("total"))  # a row a distinct value
    own = F.row_number().over(Window.partitionBy(value).orderBy(key))
    out = rows.join(per, value).withColumn("rank", (F.col("above") + own).cast("long"))
    return out.select(key, value, "rank", F.round(F.col("upto") / F.col("total"), 6).alias("share"))


def percentile_scores(rows: DataFrame, key: str, score: str) -> DataFrame:
    """rows with percentile (rank - 1) / (n - 1), ascending, ties by key; 0 for a single row.

    Ranks come from counts of range partitions, so no task sorts all rows.
    """
    parts = rows.repartitionByRange(F.col(score), F.col(key)).withColumn("__p", F.spark_partition_id())
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("__p", (F.sum("c").over(Window.orderBy("__p")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(score, key)) - 1
    out = parts.withColumn("__r", rank).join(F.broadcast(before), "__p")
    return out.withColumn("percentile", F.when(F.col("n") > 1, F.round((F.col("before") + F.col("__r")) / (F.col("n") - 1), 6)).otherwise(0.0)).drop("__p", "__r", "before", "n", "c")


def edge_timeline(edges: DataFrame, buckets: int, ts: str = "ts") -> DataFrame:
    """bucket, edges, nodes of equal closed buckets over the whole range: an edge on a boundary is in both."""
    dated = edges.where(F.col(ts).isNotNull()).select("src", "dst", seconds(ts).alias("t"))
    span = dated.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = dated.join(F.broadcast(span)).withColumn("step", (F.col("hi") - F.col("lo")) / buckets)  # one row
    own = F.least(F.floor((F.col("t") - F.col("lo")) / F.col("step")), F.lit(buckets - 1))
    held = F.filter(F.array(own - 1, own, own + 1), lambda i: (i >= 0) & (i < buckets) & F.col("t").between(F.col("lo") + F.col("step") * i, F.col("lo") + F.col("step") * (i + 1)))
    rows = rows.withColumn("bucket", F.explode(F.when(F.col("step") > 0, held).otherwise(F.array(F.lit(0).cast("long")))))
    nodes = rows.select("bucket", F.explode(F.array("src", "dst")).alias("n")).groupBy("bucket").agg(F.countDistinct("n").alias("nodes"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "bucket")


def replay_buckets(edges: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """ts, bucket: every (distinct seconds // n)th second from the first, n + 1 of them at most.

    Distinct seconds are numbered within range partitions; only the marks themselves are put in order.
    """
    d = edges.where(F.col(ts).isNotNull()).select(F.date_trunc("second", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("ts")).distinct()
    parts = d.repartitionByRange("ts").withColumn("p", F.spark_partition_id())
    counts = parts.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("p", (F.sum("c").over(Window.orderBy("p")) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))  # one row a partition
    at = parts.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("ts")) - 1).join(F.broadcast(before), "p").withColumn("i", F.col("before") + F.col("r"))
    marks = at.where(F.col("i") % F.greatest(F.floor(F.col("n") / n), F.lit(1)) == 0).orderBy("ts").limit(n + 1)
    return marks.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).cast("long").alias("bucket"))


def topology_changes(edges: DataFrame, buckets: int = 15, share: float = 0.1) -> DataFrame:
    """Replay marks at which the number of nodes seen so far jumps by more than a share of the mark before."""
    marks = replay_buckets(edges, buckets)
    first = edges.where("ts IS NOT NULL").select(F.explode(F.array("src", "dst")).alias("n"), "ts").groupBy("n").agg(F.min(F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz")).alias("first"))
    per = first.join(F.broadcast(marks), F.col("first") <= F.col("ts")).groupBy("n").agg(F.min("bucket").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("new"))  # buckets + 1 marks
    w = Window.orderBy("bucket")
    rows = marks.join(per, "bucket", "left").withColumn("nodes", F.sum(F.coalesce("new", F.lit(0))).over(w))
    rows = rows.withColumn("change", F.col("nodes") - F.lag("nodes").over(w))
    return rows.where((F.col("nodes") - F.col("change") > 0) & (F.abs("change") > (F.col("nodes") - F.col("change")) * share)).select("ts", "nodes", "change")


def midpoint_split(edges: DataFrame) -> DataFrame:
    """node, before, after: ends of edges up to and past the middle one in time (index n // 2), in seconds.

    The middle comes from counts per second, refined from days to seconds.
    """
    dated = edges.where("ts IS NOT NULL").select("src", "dst", seconds("ts").alias("t"))
    n = dated.count()
    days = dated.groupBy(F.floor(F.col("t") / 86400).alias("d")).agg(F.count(F.lit(1)).alias("c"))
    upto = days.select("d", F.sum("c").over(Window.orderBy("d")).alias("u"), "c").where(F.col("u") > n // 2).orderBy("d").first()  # one row a day
    day, before = (upto["d"], upto["u"] - upto["c"]) if upto else (0, 0)
    sec = dated.where(F.floor(F.col("t") / 86400) == day).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    mid = sec.select("t", F.sum("c").over(Window.orderBy("t")).alias("u")).where(F.col("u") > n // 2 - before).agg(F.min("t").alias("mid"))
    rows = dated.select(F.explode(F.array("src", "dst")).alias("node"), "t").join(F.broadcast(mid))  # one row
    return rows.groupBy("node").agg(F.count(F.when(F.col("t") <= F.col("mid"), 1)).alias("before"), F.count(F.when(F.col("t") > F.col("mid"), 1)).alias("after"))


def top(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order of columns, "-" before a falling one; end it with a key."""
    return rows.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.col(c) for c in order)).limit(n)


def knowledge_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """gap_type, subject, severity, impact: edges without a time or confidence or with little, and nodes without edges."""

    def gap(rows: DataFrame, kind: str, subject: str, severity: str, impact: float) -> DataFrame:
        return rows.select(F.lit(kind).alias("gap_type"), F.col(subject).alias("subject"), F.lit(severity).alias("severity"), F.lit(impact).alias("impact"))

    seen = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    out = gap(edges.where("ts IS NULL"), "MISSING_TIME", "edge_id", "LOW", 0.2)
    out = out.unionByName(gap(edges.where("confidence IS NULL"), "MISSING_CONFIDENCE", "edge_id", "MEDIUM", 0.3))
    out = out.unionByName(gap(edges.where("confidence < 0.1"), "LOW_CONFIDENCE", "edge_id", "HIGH", 0.5))
    return out.unionByName(gap(nodes.join(seen, "id", "left_anti"), "ISOLATED_ENTITY", "id", "MEDIUM", 0.4))


def ranked_gaps(gaps: DataFrame, n: int) -> DataFrame:
    """The n gaps of most impact, then severity, then by name, with their place."""
    worth = F.when(F.col("severity") == "HIGH", 3).when(F.col("severity") == "MEDIUM", 2).otherwise(1)
    best = gaps.withColumn("worth", worth).orderBy(F.desc("impact"), F.desc("worth"), "gap_type", "subject").limit(n)
    return best.select("gap_type", "subject", F.row_number().over(Window.orderBy(F.desc("impact"), F.desc("worth"), "gap_type", "subject")).cast("long").alias("place"))


def next_actions(edges: DataFrame, n: int) -> DataFrame:
    """action, subject, total: edges to verify, people to interview, edges to date; the n of highest total, ties by name."""
    verify = edges.where("confidence < 0.1").select(F.lit("VERIFY_EDGE").alias("action"), F.col("edge_id").alias("subject"), F.round(1 - F.col("confidence"), 4).alias("total"))
    busy = edges.where("ts IS NOT NULL").groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    most = busy.agg(F.max("n").alias("most"))
    meet = busy.join(F.broadcast(most)).select(F.lit("INTERVIEW").alias("action"), F.col("src").alias("subject"), F.round(F.col("n") / F.col("most"), 4).alias("total"))  # one row
    date = edges.where("ts IS NULL").select(F.lit("DATE_EDGE").alias("action"), F.col("edge_id").alias("subject"), F.lit(0.3).alias("total"))
    return top(verify.unionByName(meet).unionByName(date), ["-total", "action", "subject"], n)


def community_summary(degree: DataFrame, members: DataFrame, n: int, each: int) -> DataFrame:
    """The n largest communities with the ids of their `each` busiest members."""
    rows = degree.join(members.select("node", "community"), "node")
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(n)
    r = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    best = rows.join(F.broadcast(sizes), "community").withColumn("r", r).where(F.col("r") <= each)  # n rows
    return best.groupBy("community", "size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "node"))), lambda x: x["node"]), ",").alias("members"))
