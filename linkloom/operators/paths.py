"""Paths: shortest ones between two nodes, chains, money along paths and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import k_hop, undirected
from linkloom.operators.materialize import checkpointed


def shortest(edges: DataFrame, start: str, goal: str, k: int, most: int = 4, directed: bool = False) -> DataFrame:
    """The k shortest simple paths of at most `most` hops: path, hops, place; ties by path.

    Only nodes near enough to both ends take part: levels from each end prune the rest first.
    """
    if directed:
        adj = checkpointed(edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct())
        both = adj
    else:
        both = undirected(edges).select("u", "v").distinct()
        a, b = (k_hop(edges, x, most).select("node", F.col("level").alias(n)) for x, n in ((start, "a"), (goal, "b")))
        held = checkpointed(a.join(b, "node").where(F.col("a") + F.col("b") <= most).select("node"))
        both = checkpointed(both.join(held.withColumnRenamed("node", "u"), "u", "left_semi").join(held.withColumnRenamed("node", "v"), "v", "left_semi"))
    level = both.where(F.col("u") == start).select(F.array("u", "v").alias("path"), F.col("v").alias("end"))
    found = level.where(F.col("end") == goal)
    for _ in range(most - 1):
        level = level.where(F.col("end") != goal).join(both, level.end == both.u).where(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"), F.col("v").alias("end"))
        found = found.unionByName(level.where(F.col("end") == goal))
    out = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))
    return out.orderBy("hops", "path").limit(k)


def all_shortest(edges: DataFrame, start: str, goal: str, most: int = 4, limit: int = 5) -> DataFrame:
    """Directed paths of the least number of hops, the first so many by name."""
    found = shortest(edges, start, goal, 1_000_000, most, directed=True)
    least = found.agg(F.min("hops").alias("least"))
    return found.join(F.broadcast(least)).where("hops = least").drop("least").orderBy("path").limit(limit)  # one row


def hop_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path, hop, edge_id: the surest edge of each hop (either direction), ties by id; null confidence counts as 0."""
    n = F.split("path", ">")
    hops = paths.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(n) - 2), lambda i: F.struct((i + 1).alias("hop"), F.get(n, i).alias("a"), F.get(n, i + 1).alias("b")))).alias("h")).select("path", "h.*")
    e = edges.select("edge_id", F.coalesce("confidence", F.lit(0.0)).alias("c"), F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"))
    met = hops.join(e, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")))
    best = met.groupBy("path", "hop").agg(F.min(F.struct((-F.col("c")).alias("c"), "edge_id")).alias("e"))
    return best.select("path", F.col("hop").cast("long").alias("hop"), F.col("e.edge_id").alias("edge_id"))


def chains(edges: DataFrame, least: int = 3, most: int = 6, starts: DataFrame | None = None) -> DataFrame:
    """path, nodes: directed simple paths of least to most nodes from the starts (node; all by default)."""
    pairs = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    level = pairs if starts is None else pairs.join(starts.select(F.col("node").alias("src")), "src", "left_semi")
    level = level.select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    out = level if least <= 2 else None
    for n in range(3, most + 1):
        level = level.join(pairs, level.end == pairs.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        if n >= least:
            out = level if out is None else out.unionByName(level)
    return out.select(F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("nodes"))


def layering(edges: DataFrame, least: int = 3, most_hops: int = 5) -> DataFrame:
    """path, nodes, confidence (nodes / 5, 1 at most): chains from accounts that nothing flows into."""
    into = edges.select(F.col("dst").alias("node")).distinct()
    starts = edges.select(F.col("src").alias("node")).distinct().join(into, "node", "left_anti")
    out = chains(edges, least, most_hops + 1, starts)
    return out.withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("nodes") / 5), 6))


def circular_flows(flows: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """cycle (from its smallest account), nodes, total, confidence (nodes / 5): directed simple cycles of flows (src, dst, amount), one row a pair, with the money along them."""
    pairs = checkpointed(flows.where("src <> dst").select("src", "dst", "amount"))
    level = pairs.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"), F.col("amount").alias("total"))
    step = pairs.select(F.col("src").alias("end"), F.col("dst").alias("next"), "amount")
    out = None
    for n in range(2, most + 1):
        if n >= least:
            closed = level.join(step, "end").where(F.col("next") == F.get("path", F.lit(0))).select(F.array_join("path", ">").alias("cycle"), F.lit(n).cast("long").alias("nodes"), (F.col("total") + F.col("amount")).alias("total"))
            out = closed if out is None else out.unionByName(closed)
        if n < most:
            grown = level.join(step, "end").where((F.col("next") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("next")))
            level = grown.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"), (F.col("total") + F.col("amount")).alias("total"))
    return out.select("cycle", "nodes", F.round("total", 2).cast("double").alias("total"), F.round(F.least(F.lit(1.0), F.col("nodes") / 5), 6).alias("confidence"))


def round_trips(edges: DataFrame, most: int = 4, factor: float = 10.0, hours: int | None = None) -> DataFrame:
    """Cycles whose sum of first amounts a hop exceeds factor times the median of all amounts (1 at least): cycle, total, ratio, severity, confidence.

    edges: src, dst, amount, ts, and edge_id that breaks ties of time. With hours, first to last hop must fit in them.
    """
    first = edges.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("ts", "edge_id", "amount")).alias("f")).select("src", "dst", F.col("f.amount").alias("amount"), F.col("f.ts").alias("ts"))
    first = checkpointed(first)
    median = edges.agg(F.greatest(F.median(F.col("amount").cast("double")), F.lit(1.0)).alias("median"))
    level = first.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"), F.col("amount").alias("total"), F.col("ts").alias("lo"), F.col("ts").alias("hi"))
    step = first.select(F.col("src").alias("end"), F.col("dst").alias("next"), "amount", "ts")
    out = None
    for n in range(2, most + 1):
        grown = level.join(step, "end").select("path", "next", (F.col("total") + F.col("amount")).alias("total"), F.least("lo", "ts").alias("lo"), F.greatest("hi", "ts").alias("hi"))
        closed = grown.where(F.col("next") == F.get("path", F.lit(0)))
        out = closed if out is None else out.unionByName(closed)
        level = grown.where((F.col("next") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"), "total", "lo", "hi")
    if hours is not None:
        out = out.where(F.unix_timestamp(F.col("hi").cast("timestamp")) - F.unix_timestamp(F.col("lo").cast("timestamp")) <= hours * 3600)
    ratio = F.round(F.col("total").cast("double") / F.col("median"), 6)
    out = out.join(F.broadcast(median)).select(F.array_join("path", ">").alias("cycle"), F.round("total", 2).cast("double").alias("total"), ratio.alias("ratio")).where(F.col("ratio") > factor)  # one row
    return out.withColumns({"severity": F.when(F.col("ratio") > 50, "HIGH").when(F.col("ratio") > 10, "MEDIUM").otherwise("LOW"), "confidence": F.round(F.least(F.lit(1.0), F.col("ratio") / 100), 6)})


def fund_paths(flows: DataFrame, start: str, hops: int, least: float = 0.0, goal: str | None = None, top: int | None = 200) -> DataFrame:
    """path, hops, total, smallest hop of money from an account along flows (src, dst, amount; one row a pair) of at least `least` each; accounts may recur. The largest totals, ties by path."""
    step = checkpointed(flows.where(F.col("amount") >= least).select("src", "dst", "amount"))
    level = step.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"), F.col("amount").alias("total"), F.col("amount").alias("low"))
    out = level
    for _ in range(hops - 1):
        level = level.join(step, level.end == step.src).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"), (F.col("total") + F.col("amount")).alias("total"), F.least("low", "amount").alias("low"))
        out = out.unionByName(level)
    out = out if goal is None else out.where(F.col("end") == goal)
    out = out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"), F.round("total", 2).cast("double").alias("total"), F.round("low", 2).cast("double").alias("smallest_hop"))
    return out if top is None else out.orderBy(F.desc("total"), "path").limit(top)


def trace(flows: DataFrame, start: str, hops: int = 4, least: float = 0.0) -> DataFrame:
    """account, level, largest_hop and flags of what money from an account reaches: RAPID_PASS_THROUGH, FAN_IN, FAN_OUT; indicators only, no legal conclusions."""
    step = checkpointed(flows.where(F.col("amount") >= least).select("src", "dst", "amount"))
    seen = step.sparkSession.range(1).select(F.lit(start).alias("account"), F.lit(0).alias("level"))
    front, reached = seen, None
    for n in range(1, hops + 1):
        met = front.join(step, front.account == step.src).groupBy(F.col("dst").alias("account")).agg(F.max("amount").alias("largest"))
        new = checkpointed(met.join(seen.select("account"), "account", "left_anti").select("account", F.lit(n).alias("level"), "largest"))
        seen = checkpointed(seen.unionByName(new.select("account", "level")))
        front = new.select("account", "level")
        reached = new if reached is None else reached.unionByName(new)
    into = step.groupBy(F.col("dst").alias("account")).agg(F.sum("amount").alias("i"), F.count(F.lit(1)).alias("fan_in"))
    outof = step.groupBy(F.col("src").alias("account")).agg(F.sum("amount").alias("o"), F.count(F.lit(1)).alias("fan_out"))
    rows = reached.join(into, "account", "left").join(outof, "account", "left").na.fill(0, ["fan_in", "fan_out"])
    share = F.coalesce(F.col("o").cast("double") / F.col("i").cast("double"), F.lit(0.0))
    flags = F.array_compact(F.array(F.when(share.between(0.9, 1.1), "RAPID_PASS_THROUGH"), F.when(F.col("fan_in") >= 3, "FAN_IN"), F.when(F.col("fan_out") >= 3, "FAN_OUT")))
    return rows.select("account", F.col("level").cast("long").alias("level"), F.round("largest", 2).cast("double").alias("largest_hop"), F.array_join(flags, ",").alias("flags"))
