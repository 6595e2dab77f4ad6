"""Communities, distances, snapshot metrics, removal simulations, bridges, layers, replay states and motifs.

Iterations write each round to the shared checkpoint folder. What is done for several removed nodes or
buckets at once runs on one graph whose node names carry the label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.numbers import ladder
from linkloom.operators.graph import components, cycles, degrees, fan, hubs, undirected
from linkloom.operators.materialize import checkpointed
from linkloom.operators.profiles import community_ends, layer

EFFECT = "NETWORK EFFECT SCORE — NOT AN ENFORCEMENT RECOMMENDATION"


# --- communities --------------------------------------------------------------------------------


def louvain(edges: DataFrame, rounds: int = 10, levels: int = 5, resolution: float = 1.0) -> DataFrame:
    """node, community (0 for the largest, ties by smallest member): modularity by local moves, level by level.

    In each round one half of the nodes, by hash, moves to the neighbouring community of most gain (ties to
    the smallest name), so that neighbours don't swap for ever; then communities become nodes. Reruns agree.
    """
    adj = checkpointed(undirected(edges).select("u", "v", F.col("weight").cast("double").alias("w")))
    total = adj.agg(F.sum("w")).first()[0] or 0.0
    member = checkpointed(adj.select(F.col("u").alias("node")).distinct().withColumn("c", F.col("node")))
    size = member.count()
    for _ in range(levels):
        strength = checkpointed(adj.groupBy("u").agg(F.sum("w").alias("k")).withColumn("c", F.col("u")))
        near = adj.where("u <> v")
        still = 0
        for r in range(rounds):
            of = strength.select(F.col("u").alias("v"), "c")
            links = near.join(of, "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            own = strength.select("u", "k", F.col("c").alias("own"))
            options = links.unionByName(strength.select("u", "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
            sums = strength.groupBy("c").agg(F.sum("k").alias("tot"))
            rated = options.join(own, "u").join(sums, "c")
            rest = F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
            rated = rated.withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * rest / total, 9))
            best = rated.groupBy("u", "k", "own").agg(F.max("gain").alias("top"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("stay"))
            target = rated.join(best.select("u", "top", "stay"), "u").where("gain = top").groupBy("u", "k", "own", "top", "stay").agg(F.min("c").alias("to"))
            turn = (F.pmod(F.xxhash64("u"), F.lit(2)) == r % 2) & (F.col("top") > F.col("stay") + 1e-7)
            moved = checkpointed(target.select("u", "k", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("c"), turn.alias("moved")))
            changes = moved.where("moved").count()
            strength = moved.drop("moved")
            still = 0 if changes else still + 1
            if still == 2:
                break
        member = checkpointed(member.join(strength.select(F.col("u").alias("c"), F.col("c").alias("up")), "c").select("node", F.col("up").alias("c")))
        a, b = strength.select("u", F.col("c").alias("cu")), strength.select(F.col("u").alias("v"), F.col("c").alias("cv"))
        adj = checkpointed(adj.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        now = strength.select("c").distinct().count()
        if now == size:
            break
        size = now
    sizes = member.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    order = sizes.select("c", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("community"))  # one row a community
    return member.join(order, "c").select("node", "community")


def bucketed_components(edges: DataFrame, bounds: DataFrame) -> DataFrame:
    """bucket, communities, largest, nodes of the graph up to each bound (bucket, ts): one labelled graph for all."""
    e = edges.where("ts IS NOT NULL").join(F.broadcast(bounds.select("bucket", F.col("ts").alias("bound"))), F.col("ts") <= F.col("bound"))  # a few bounds
    found = components(_labelled(e, F.col("bucket").cast("string")))
    per = found.groupBy(_label("node").cast("long").alias("bucket"), "component").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("bucket").agg(F.count(F.lit(1)).alias("communities"), F.max("n").alias("largest"), F.sum("n").alias("nodes"))


def _labelled(edges: DataFrame, name: Column) -> DataFrame:
    return edges.select(F.concat_ws("|", name, "src").alias("src"), F.concat_ws("|", name, "dst").alias("dst"))


def _label(column: str) -> Column:
    return F.substring_index(column, "|", 1)


def community_changes(counts: DataFrame) -> DataFrame:
    """bucket, formed or merged: changes of the number of components from one bucket to the next."""
    w = Window.orderBy("bucket")  # one row a bucket
    return counts.select("bucket", "communities", (F.col("communities") - F.lag("communities", 1, 0).over(w)).alias("change"), (F.col("nodes") - F.lag("nodes", 1, 0).over(w)).alias("new_nodes"))


# --- distances and snapshots --------------------------------------------------------------------


def distances(edges: DataFrame, sources: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """s, node, d: breadth-first distances from sources (node; all by default) over undirected edges, one level a join."""
    adj = checkpointed(undirected(edges).select("u", "v").distinct())
    start = adj.select(F.col("u").alias("node")).distinct() if sources is None else sources.select("node")
    front = checkpointed(start.select(F.col("node").alias("s"), "node", F.lit(0).alias("d")))
    levels = [front]
    while most is None or len(levels) <= most:
        step = front.join(adj, front.node == adj.u).select("s", F.col("v").alias("node")).distinct()
        for old in levels[-2:]:  # a neighbour of a level lies in it, the one before or the one after
            step = step.join(old.select("s", "node"), ["s", "node"], "left_anti")
        front = checkpointed(step.withColumn("d", F.lit(len(levels))))
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for f in levels[1:]:
        out = out.unionByName(f)
    return out


def snapshot(edges: DataFrame, members: DataFrame | None = None, label: Column | None = None) -> DataFrame:
    """Per label (one row without): nodes, edges (simple), density, components, giant, fragmentation, efficiency, mean path length; with members (node, community) their number and modularity.

    Density counts unordered pairs, fragmentation is 1 - giant / nodes, efficiency the mean of 1 / distance
    over all ordered pairs (0 where unreachable), path length the mean over reachable ones.
    """
    e = checkpointed(_labelled(edges, F.lit("0") if label is None else label))
    pairs = undirected(e).where("u < v")
    m = pairs.groupBy(_label("u").alias("label")).agg(F.count(F.lit(1)).alias("edges"))
    c = components(e).groupBy(_label("node").alias("label"), "component").agg(F.count(F.lit(1)).alias("n"))
    c = c.groupBy("label").agg(F.sum("n").alias("nodes"), F.count(F.lit(1)).alias("components"), F.max("n").alias("giant"))
    d = distances(e).where("d > 0").groupBy(_label("s").alias("label"), "d").agg(F.count(F.lit(1)).alias("n"))
    d = d.groupBy("label").agg(F.sum(F.col("n") / F.col("d")).alias("near"), (F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("apl"))
    n = F.col("nodes")
    out = c.join(m, "label").join(d, "label", "left")
    out = out.select("label", "nodes", "edges", F.round(2 * F.col("edges") / (n * (n - 1)), 6).alias("density"), "components", "giant", F.round(1 - F.col("giant") / n, 6).alias("fragmentation"), F.round(F.coalesce("near", F.lit(0.0)) / (n * (n - 1)), 6).alias("efficiency"), F.round("apl", 6).alias("path_length"))
    if members is not None:
        from linkloom.operators.graph import modularity

        k = members.agg(F.countDistinct("community").alias("communities"))
        out = out.join(F.broadcast(k)).join(F.broadcast(modularity(edges, members)))  # one row each
    return out


#: Weights of a removal's effect, and its classes.
EFFECT_WEIGHTS = {"fragmentation_increase": 0.25, "efficiency_loss": 0.25, "community_disruption": 0.20, "gcc_loss": 0.15, "path_length_increase": 0.10, "modularity_drop": 0.05}
EFFECT_CLASSES = [(0.30, "critical"), (0.15, "high"), (0.07, "medium")]


def removal_effects(edges: DataFrame, members: DataFrame, victims: DataFrame) -> DataFrame:
    """Per victim (removed): the six parts of the effect of its removal, their weighted score, class and rank.

    All victims' damaged graphs are measured as one labelled graph. Communities after the removal are the
    parts that the components leave of the given ones; their disruption is 1 - normalised mutual information.
    Isolated neighbours stay nodes of the damaged graph.
    """
    simple = checkpointed(undirected(edges).where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"))
    nodes = checkpointed(simple.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    total = nodes.count()
    base = checkpointed(snapshot(simple).drop("label"))
    v = checkpointed(victims.select("removed").distinct())
    cut = checkpointed(simple.join(F.broadcast(v)).where("src <> removed AND dst <> removed"))  # few victims
    after = snapshot(cut, label=F.col("removed")).withColumnRenamed("label", "removed")
    left = nodes.join(F.broadcast(v)).where("node <> removed")  # few victims
    comp = components(_labelled(cut, F.col("removed"))).select(_label("node").alias("removed"), F.substring_index("node", "|", -1).alias("node"), "component")
    parts = checkpointed(left.join(comp, ["removed", "node"], "left").withColumn("component", F.coalesce("component", "node")).join(members, "node"))
    sizes = parts.groupBy("removed", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("removed").agg(F.max("n").alias("gcc"), F.count(F.lit(1)).alias("pieces"))
    joint = parts.groupBy("removed", "community", "component").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("removed", "community")
    per = joint.withColumn("cc", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("removed")))
    # After-communities refine the old ones, so their mutual information is the entropy of the old ones.
    e_new = per.groupBy("removed").agg(F.sum(-F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n"))).alias("h_new"), F.sum(-F.col("c") / F.col("n") * F.log(F.col("cc") / F.col("n"))).alias("h_old"), F.countDistinct(F.when(F.col("c") < F.col("cc"), F.col("community"))).alias("split_communities"))
    nmi = F.when((F.col("h_new") > 0) & (F.col("h_old") > 0), F.sqrt(F.col("h_old") / F.col("h_new"))).otherwise(F.when(F.col("h_new") == F.col("h_old"), 1.0).otherwise(0.0))
    lost = _modularity_drop(cut, simple, members)
    b = base.select(F.col("giant").alias("g0"), F.col("efficiency").alias("e0"), F.col("path_length").alias("p0"), F.col("fragmentation").alias("f0"), F.col("nodes").alias("n0"))
    rows = v.join(after.select("removed", "efficiency", "path_length", "nodes"), "removed", "left").join(sizes, "removed").join(e_new, "removed").join(lost, "removed", "left").join(F.broadcast(b))  # one row
    pos = lambda c: F.round(F.greatest(F.lit(0.0), c), 6)
    full = F.lit(float((total - 1) * (total - 2) or 1))
    eff = F.coalesce(F.col("efficiency") * F.col("nodes") * (F.col("nodes") - 1), F.lit(0.0)) / full
    shares = {
        "fragmentation_increase": pos((1 - F.col("gcc") / float(max(total - 1, 1))) - F.col("f0")), "efficiency_loss": pos(F.when(F.col("e0") > 0, (F.col("e0") - eff) / F.col("e0")).otherwise(0.0)), "community_disruption": pos(1 - nmi),
        "gcc_loss": pos((F.col("g0") - F.col("gcc")) / F.col("n0")), "path_length_increase": pos(F.coalesce((F.col("path_length") - F.col("p0")) / F.col("p0"), F.lit(0.0))), "modularity_drop": F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("drop", F.lit(0.0)))), 6),
    }
    out = rows.select("removed", "pieces", "split_communities", *(c.alias(k) for k, c in shares.items()))
    out = out.withColumn("impact", F.round(sum((x * F.col(k) for k, x in EFFECT_WEIGHTS.items()), F.lit(0.0)), 4))
    out = out.withColumn("disruption", ladder(F.col("impact"), EFFECT_CLASSES, "low", strict=False))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("impact"), "removed")).cast("long")).withColumn("note", F.lit(EFFECT))  # few victims


def _modularity_drop(cut: DataFrame, simple: DataFrame, members: DataFrame) -> DataFrame:
    """removed, drop: relative loss of modularity of the given communities."""

    def score(e: DataFrame, keys: list[str]) -> DataFrame:
        ends = e.select(*keys, F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v")))).alias("x"), "weight").select(*keys, "x.*", "weight")
        a, b = members.select(F.col("node").alias("u"), F.col("community").alias("cu")), members.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        per = ends.join(a, "u").join(b, "v").groupBy(*keys, "cu").agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0)).alias("i"), F.sum("weight").alias("k"))
        per = per.withColumn("m", F.sum("k").over(Window.partitionBy(*keys)))
        return per.groupBy(*keys).agg(F.sum(F.col("i") / F.col("m") - F.pow(F.col("k") / F.col("m"), 2)).alias("q"))

    q0 = score(simple, []).withColumnRenamed("q", "q0")
    return score(cut, ["removed"]).join(F.broadcast(q0)).select("removed", ((F.col("q0") - F.col("q")) / F.greatest(F.abs("q0"), F.lit(1e-9))).alias("drop"))  # one row


def removal_payload(edges: DataFrame, node: str) -> DataFrame:
    """One row: neighbours, incident edges, pairs of neighbours and how many of them keep another way of two hops or an edge once the node is gone."""
    adj = checkpointed(undirected(edges).select("u", "v").distinct())
    near = adj.where(F.col("u") == node).select(F.col("v").alias("n"))
    rest = adj.where((F.col("u") != node) & (F.col("v") != node))
    a, b = near.select(F.col("n").alias("a")), near.select(F.col("n").alias("b"))
    direct = rest.join(a, F.col("u") == F.col("a"), "left_semi").join(b, F.col("v") == F.col("b"), "left_semi").where("u < v").select(F.col("u").alias("a"), F.col("v").alias("b"))
    around = rest.join(a, rest.u == F.col("a")).select("a", F.col("v").alias("z"))
    two = around.join(around.select(F.col("a").alias("b"), "z"), "z").where("a < b").select("a", "b")
    kept = direct.union(two).distinct().agg(F.count(F.lit(1)).alias("rerouted_pairs"))
    n = near.agg(F.count(F.lit(1)).alias("neighbours"))
    m = edges.where((F.col("src") == node) | (F.col("dst") == node)).agg(F.count(F.lit(1)).alias("incident_edges"))
    out = n.join(F.broadcast(m)).join(F.broadcast(kept)).withColumn("pairs", (F.col("neighbours") * (F.col("neighbours") - 1) / 2).cast("long"))  # one row each
    return out.select(F.lit(node).alias("removed"), "neighbours", "incident_edges", "pairs", "rerouted_pairs", F.round(F.when(F.col("pairs") > 0, F.col("rerouted_pairs") / F.col("pairs")).otherwise(0.0), 6).alias("rerouting_score"))


def baseline_ranking(scores: DataFrame, key: str = "node", weights: dict[str, float] | None = None) -> DataFrame:
    """key, score, rank: weighted mean of min-max scaled pagerank, betweenness and degree (0.4, 0.4, 0.2), ties by key."""
    weights = weights or {"pagerank": 0.4, "betweenness": 0.4, "degree": 0.2}
    bounds = scores.agg(*(f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))))
    rows = scores.join(F.broadcast(bounds))  # one row
    scaled = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(0.0)
    out = rows.select(key, F.round(sum((w * scaled(c) for c, w in weights.items()), F.lit(0.0)), 6).alias("score"))
    return out.orderBy(F.desc("score"), key)


# --- bridges ------------------------------------------------------------------------------------


def bridges(edges: DataFrame) -> DataFrame:
    """a, b of edges whose removal parts a component, by hashes of cycles.

    Every edge off a breadth-first tree gets a random 64-bit value; the values of those that leave a subtree
    cancel to 0 (but for one chance in 2^64) only where none does, and then the tree edge above is a bridge.
    Parallel edges are never bridges; self-loops are ignored. Subtrees are summed level by level.
    """
    weighted = checkpointed(undirected(edges))
    adj = weighted.select("u", "v")
    roots = components(adj.select(F.col("u").alias("src"), F.col("v").alias("dst"))).select(F.col("component").alias("node")).distinct()
    level = checkpointed(distances(adj.select(F.col("u").alias("src"), F.col("v").alias("dst")), roots).select("node", "d"))
    up = adj.join(level.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(level.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v")
    tree = checkpointed(up.where("dv = du - 1").groupBy(F.col("u").alias("node"), F.col("du").alias("d")).agg(F.min("v").alias("parent")))
    t = tree.select(F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    off = weighted.where("u < v").join(t.withColumn("t", F.lit(1)), ["u", "v"], "left").where("t IS NULL OR weight > 1")
    value = off.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("u", "v").alias("x")).groupBy("node").agg(F.expr("bit_xor(x)").alias("x"))
    value = checkpointed(tree.select("node", "parent", "d").join(value, "node", "left").na.fill(0, ["x"]))
    deepest = tree.agg(F.max("d")).first()[0] or 0
    done = None
    below = None
    for d in range(deepest, 0, -1):
        here = value.where(F.col("d") == d)
        if below is not None:
            part = below.groupBy(F.col("parent").alias("node")).agg(F.expr("bit_xor(x)").alias("y"))
            here = here.join(part, "node", "left").select("node", "parent", "d", F.col("x").bitwiseXOR(F.coalesce("y", F.lit(0).cast("long"))).alias("x"))
        below = checkpointed(here)
        cut = below.where("x = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
        done = cut if done is None else done.unionByName(cut)
    return done if done is not None else t.select(F.col("u").alias("a"), F.col("v").alias("b")).limit(0)


# --- layers, time, subgraphs --------------------------------------------------------------------


def layer_view(edges: DataFrame, name: str | None = None) -> DataFrame:
    """edges with their layer; of one layer only, if named."""
    out = edges.withColumn("layer", layer())
    return out if name is None else out.where(F.col("layer") == name)


def replay(edges: DataFrame, moment: str, mode: str = "cumulative", days: int = 30) -> DataFrame:
    """Dated edges up to a moment (cumulative), at that second (exact) or within the days before it (sliding); undated ones never show."""
    at = F.lit(moment).cast("timestamp_ntz")
    second = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    if mode == "cumulative":
        return edges.where(second <= at)
    if mode == "exact":
        return edges.where(second == at)
    if mode == "sliding":
        return edges.where((second <= at) & (second > at - F.expr(f"INTERVAL {days} DAYS")))
    raise ValueError(f"unknown mode {mode}")


def snapshot_delta(early: DataFrame, late: DataFrame) -> DataFrame:
    """a, b, change (ADDED, REMOVED) of unordered pairs between two edge tables."""
    pairs = lambda e: e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    x, y = pairs(early).withColumn("x", F.lit(1)), pairs(late).withColumn("y", F.lit(1))
    both = x.join(y, ["a", "b"], "full").where("x IS NULL OR y IS NULL")
    return both.select("a", "b", F.when(F.col("x").isNull(), "ADDED").otherwise("REMOVED").alias("change"))


def neighbours(edges: DataFrame, node: str, direction: str = "both", relation: str | None = None) -> DataFrame:
    """other, relation, direction (OUT, IN), edges of a node's neighbours."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("other"), "relation", F.lit("OUT").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("other"), "relation", F.lit("IN").alias("direction"))
    rows = {"both": out.unionByName(into), "out": out, "in": into}[direction]
    rows = rows if relation is None else rows.where(F.col("relation") == relation)
    return rows.groupBy("other", "relation", "direction").agg(F.count(F.lit(1)).alias("edges"))


def ego(edges: DataFrame, node: str, hops: int, cap: int, rank: DataFrame) -> DataFrame:
    """Edges among a node and the `cap` most relevant nodes within so many hops; rank: node, score; ties by degree, then name."""
    from linkloom.operators.graph import k_hop

    near = k_hop(edges, node, hops)
    d = degrees(edges).select("node", "degree")
    kept = near.join(rank, "node", "left").join(d, "node", "left").orderBy(F.when(F.col("node") == node, 0).otherwise(1), F.desc(F.coalesce("score", F.lit(0.0))), F.desc("degree"), "node").limit(cap).select("node")
    kept = checkpointed(kept)
    return edges.join(F.broadcast(kept.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(kept.withColumnRenamed("node", "dst")), "dst", "left_semi")  # at most cap rows


# --- motifs -------------------------------------------------------------------------------------


def connectors(edges: DataFrame, members: DataFrame, least: int = 3) -> DataFrame:
    """node, communities: nodes tied to members of at least so many communities, their own included."""
    e = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))).alias("x")).select("x.*")
    seen = e.join(members.select(F.col("node").alias("other"), "community"), "other").select("node", "community").unionByName(members.select("node", "community")).distinct()
    return seen.groupBy("node").agg(F.count(F.lit(1)).alias("communities")).where(F.col("communities") >= least)


def brokers(edges: DataFrame, members: DataFrame, betweenness: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes of highest betweenness among those with an edge out of their community; ties by name."""
    out = community_ends(edges, members).where(~F.col("internal")).groupBy("node").agg(F.count(F.lit(1)).alias("external_edges"))
    return betweenness.join(out, "node").orderBy(F.desc("betweenness"), "node").limit(n)


def motif_report(edges: DataFrame, members: DataFrame, ring: int = 3) -> DataFrame:
    """motif_type, subject, size, motif_id of hubs, fans, rings of three and connectors, numbered by type in order of size and subject."""

    def rows(df: DataFrame, kind: str, subject: str, size: str) -> DataFrame:
        return df.select(F.lit(kind).alias("motif_type"), F.col(subject).alias("subject"), F.col(size).cast("long").alias("size"))

    out = rows(hubs(edges), "HUB", "node", "degree").unionByName(rows(fan(edges, "dst"), "FAN_IN", "node", "edges")).unionByName(rows(fan(edges, "src"), "FAN_OUT", "node", "edges"))
    out = out.unionByName(rows(connectors(edges, members), "CONNECTOR", "node", "communities")).unionByName(rows(cycles(edges, ring), "RING", "cycle", "nodes"))
    number = F.row_number().over(Window.partitionBy("motif_type").orderBy(F.desc("size"), "subject"))
    return out.withColumn("motif_id", F.concat(F.lit("MOTIF-"), "motif_type", F.lit("-"), number.cast("string")))
