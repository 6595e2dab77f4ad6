"""Graph operators on edge tables (src, dst, ...): joins and aggregates, no driver-side graph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.materialize import checkpointed
from linkloom.operators.shipped import HELD, pair_sums, rings_held


def undirected(edges: DataFrame) -> DataFrame:
    """u, v, weight: both directions of the simple graph without self-loops; weight = parallel edges."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), "weight").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, degree, centrality = degree / (n - 1)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    out = ends.groupBy("node").agg(F.sum(1 - F.col("o")).alias("in_degree"), F.sum("o").alias("out_degree"), F.count(F.lit(1)).alias("degree"))
    n = out.agg(F.count(F.lit(1)).alias("nodes"))
    return out.join(F.broadcast(n)).select("node", "in_degree", "out_degree", "degree", F.round(F.col("degree") / F.greatest(F.col("nodes") - 1, F.lit(1)), 9).alias("centrality"))  # one row


def as_of(edges: DataFrame, moment: str, ts: str = "ts") -> DataFrame:
    """Edges visible at a moment; edges without a time are always visible."""
    return edges.where(F.col(ts).isNull() | (F.col(ts) <= F.lit(moment).cast("timestamp_ntz")))


def between(edges: DataFrame, start: str, end: str, ts: str = "ts", undated: bool = True) -> DataFrame:
    inside = F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return edges.where(inside | F.col(ts).isNull() if undated else inside)


def delta(edges: DataFrame, early: str, late: str, ts: str = "ts") -> DataFrame:
    """Directed pairs whose first dated edge lies after early and not after late: what a replay adds."""
    first = edges.where(F.col(ts).isNotNull()).groupBy("src", "dst").agg(F.min(ts).alias("first_ts"))
    return first.where((F.col("first_ts") > F.lit(early).cast("timestamp_ntz")) & (F.col("first_ts") <= F.lit(late).cast("timestamp_ntz")))


def k_hop(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """node, level: breadth-first levels from a node over undirected edges."""
    adj = undirected(edges).select("u", "v")
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("level"))
    front = seen
    for level in range(1, hops + 1):
        step = front.join(adj, front.node == adj.u).select(F.col("v").alias("node"), F.lit(level).alias("level")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti")
        seen = seen.unionByName(front)
    return seen


def fan(edges: DataFrame, side: str, least: int = 3) -> DataFrame:
    """Fan-in (side "dst") or fan-out ("src"): parallel edges at a node, and distinct counterparties."""
    other = "src" if side == "dst" else "dst"
    return edges.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct(other).alias("counterparties")).where(F.col("edges") >= least)


def hubs(edges: DataFrame, least: int = 5) -> DataFrame:
    """Degree at least mean + 2 sample deviations, and at least `least`."""
    d = degrees(edges)
    cut = d.agg(F.avg("degree").alias("m"), F.coalesce(F.stddev_samp("degree"), F.lit(0.0)).alias("sd"))
    return d.join(F.broadcast(cut)).where((F.col("degree") >= F.col("m") + 2 * F.col("sd")) & (F.col("degree") >= least)).select("node", "degree", F.round(F.col("m") + 2 * F.col("sd"), 6).alias("threshold"))  # one row


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest id): min-label propagation with pointer jumping, checkpointed each round."""
    adj = checkpointed(undirected(edges).select("u", "v"))
    labels = checkpointed(adj.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")).withColumnRenamed("u", "node"))
    while True:
        near = adj.join(labels, adj.v == labels.node).groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, labels.node == near.u).select("node", "l", F.least("l", "m").alias("n"))
        jump = labels.select(F.col("node").alias("n"), F.col("l").alias("up"))
        new = checkpointed(step.join(jump, "n").select("node", "l", F.least("n", "up").alias("n")))
        changed = new.where("n <> l").limit(1).count()
        labels = new.select("node", F.col("n").alias("l"))
        if not changed:
            return labels.withColumnRenamed("l", "component")


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85, restart: str | None = None) -> DataFrame:
    """A fixed number of power iterations; parallel edges add weight, dangling mass is spread like the restart.

    restart: a node to personalise on.
    """
    pairs = checkpointed(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    out = pairs.groupBy("src").agg(F.sum("w").alias("total"))
    share = checkpointed(pairs.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("p")))
    nodes = checkpointed(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(out.withColumnRenamed("src", "node"), "node", "left").select("node", F.isnull("total").alias("dangling")))
    n = nodes.count()
    base = F.lit(1.0 / n) if restart is None else F.when(F.col("node") == restart, 1.0).otherwise(0.0)
    rank = nodes.withColumn("rank", base)
    for _ in range(rounds):
        flow = rank.join(share, rank.node == share.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("lost"))
        rank = checkpointed(rank.drop("rank").join(flow, rank.node == flow.dst, "left").join(F.broadcast(lost)).select("node", "dangling", (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * base) + (1 - alpha) * base).alias("rank")))  # lost is one row
    return rank.select("node", "rank")


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Directed simple cycles of a length, each once, from its smallest node; needs few parallel pairs."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    paths = pairs.where("dst > src").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    step = pairs.select(F.col("src").alias("end"), F.col("dst").alias("next"))
    for _ in range(length - 2):
        grown = paths.join(step, "end").where((F.col("next") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("next")))
        paths = grown.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"))
    closed = paths.join(step, "end").where(F.col("next") == F.get("path", F.lit(0)))
    return closed.select(F.array_join("path", ">").alias("cycle"), F.lit(length).alias("nodes"))


def rings(edges: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """Directed simple cycles of each length from least to most nodes.

    Up to HELD pairs, tasks hold the graph and paths meet in the middle, so no path is shuffled; beyond, by joins.
    """
    pairs = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    if pairs.count() <= HELD and least >= 2:
        return rings_held(pairs.toDF("u", "v"), least, most)
    out = cycles(pairs, least)
    for length in range(least + 1, most + 1):
        out = out.unionByName(cycles(pairs, length))
    return out


def paths(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """Directed simple paths from a node, of 1 to hops edges."""
    pairs = edges.where("src <> dst").select("src", "dst").distinct()
    level = pairs.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    out = level
    for _ in range(hops - 1):
        level = level.join(pairs, level.end == pairs.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        out = out.unionByName(level)
    return out.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"), "end")


def link_scores(edges: DataFrame) -> DataFrame:
    """Common neighbours, Jaccard, Adamic-Adar, resource allocation and preferential attachment of pairs with a shared neighbour.

    Computed within tasks that each hold two blocks of nodes, so no wedge is shuffled; see pair_sums.
    """
    parts = {"aa": lambda d, t: 1 / np.log(np.maximum(d, 2)), "ra": lambda d, t: 1 / d}
    out = pair_sums(undirected(edges), parts).where("common > 0")
    return out.select("x", "y", "common", F.round(F.col("common") / (F.col("dx") + F.col("dy") - F.col("common")), 6).alias("jaccard"), F.round("aa", 6).alias("adamic_adar"), F.round("ra", 6).alias("resource_allocation"), (F.col("dx") * F.col("dy")).alias("preferential"), (F.col("weight") > 0).alias("linked"))


def relationship_gaps(edges: DataFrame, least: int = 3) -> DataFrame:
    """Pairs with enough shared neighbours and no edge."""
    return link_scores(edges).where((F.col("common") >= least) & ~F.col("linked"))


def structural_holes(edges: DataFrame) -> DataFrame:
    """Burt's constraint of each node: sum over j of (p_ij + sum over q of p_iq p_qj)^2."""
    through = pair_sums(undirected(edges), {"q": lambda d, t: 1 / t}, linked_only=True, weighted=True)
    ends = F.array(F.struct(F.col("x").alias("node"), F.col("tx").alias("t")), F.struct(F.col("y").alias("node"), F.col("ty").alias("t")))
    tie = through.select(F.explode(ends).alias("e"), "weight", "q").select("e.node", F.pow((F.col("weight") + F.col("q")) / F.col("e.t"), 2).alias("c"))
    return tie.groupBy("node").agg(F.round(F.sum("c"), 6).alias("constraint"), F.count(F.lit(1)).alias("degree"))


def community_profile(edges: DataFrame, member: DataFrame) -> DataFrame:
    """member (node, community): size, internal and external edges, density of each community."""
    s = member.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    d = member.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    tied = edges.join(s, "src").join(d, "dst")
    ends = tied.select(F.explode(F.when(F.col("cs") == F.col("cd"), F.array(F.struct(F.col("cs").alias("community"), F.lit(1).alias("i")))).otherwise(F.array(F.struct(F.col("cs").alias("community"), F.lit(0).alias("i")), F.struct(F.col("cd").alias("community"), F.lit(0).alias("i"))))).alias("e")).select("e.*")
    counts = ends.groupBy("community").agg(F.sum("i").alias("internal_edges"), F.sum(1 - F.col("i")).alias("external_edges"))
    out = member.groupBy("community").agg(F.count(F.lit(1)).alias("members")).join(counts, "community", "left").na.fill(0)
    return out.withColumn("density", F.round(F.col("internal_edges") / F.greatest(F.col("members") * (F.col("members") - 1), F.lit(1)), 9))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: sum over communities of internal / m - (degree / 2m)^2 on the weighted simple graph."""
    adj = undirected(edges).join(member.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u").join(member.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v")
    per = adj.groupBy("cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0)).alias("inside"), F.sum("weight").alias("degree"))
    total = F.sum("degree").over(Window.partitionBy())
    return per.withColumn("m2", total).agg(F.round(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)), 6).alias("modularity"))


def removal_fragmentation(edges: DataFrame, victims: DataFrame) -> DataFrame:
    """victims (removed): number of components left without each node, 64 nodes at once by labelled edges."""
    adj = checkpointed(undirected(edges).select("u", "v"))
    victims = checkpointed(victims.select("removed").where("removed IS NOT NULL").distinct())
    blocks = max(1, -(-victims.count() // 64))
    out = None
    for b in range(blocks):
        some = victims.where(F.pmod(F.xxhash64("removed"), F.lit(blocks)) == b)
        cut = adj.join(F.broadcast(some)).where("u <> removed AND v <> removed")  # about 64 rows
        named = cut.select(F.concat_ws("|", "removed", "u").alias("src"), F.concat_ws("|", "removed", "v").alias("dst"))
        found = components(named).groupBy(F.substring_index("node", "|", 1).alias("removed")).agg(F.countDistinct("component").alias("components"), F.count(F.lit(1)).alias("nodes_left"))
        out = found if out is None else out.unionByName(found)
    return out
