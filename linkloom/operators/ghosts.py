"""Hidden intermediaries: what pairs of communities share without being tied, and where a missing person would stand.

Every ghost is a hypothesis: status and limitations are columns of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators.intervals import seconds
from linkloom.operators.materialize import checkpointed

#: Relations by what they share, and how much each category counts.
TAXONOMY = {
    "locations": ("LIVES_IN", "BASED_IN", "HEADQUARTERED_IN", "LOCATED_IN", "OPERATES_IN", "SEEN_IN", "TRANSITS_THROUGH", "IS_IN_COUNTRY", "TRAVELS_TO", "STAYED_AT"),
    "money_routes": ("FUNDS", "FUNDED", "TRANSFERS_TO", "TRANSFERRED_TO", "USES_ACCOUNT", "PAYS", "PAYS_TO", "PAID_TO", "WIRES_TO", "WIRED_TO", "LAUNDERS_TO", "RECEIVES_FROM", "MOVES_FUNDS", "PAYMENT_TO", "TRANSACTION_TO"),
    "suppliers": ("SUPPLIES_TO", "SUPPLIER_OF", "SUPPLIES", "SHIPS_TO", "DELIVERS_TO", "PURCHASES_FROM", "VENDOR_OF", "PROVIDES", "SELLS_TO"),
}
CATEGORY_WEIGHTS = {"locations": 0.25, "money_routes": 0.50, "suppliers": 0.25}
#: Parts of the confidence; those not given drop out and the rest is scaled up.
WEIGHTS = {"attribute": 0.50, "embedding": 0.20, "hole": 0.10, "sage": 0.10, "temporal": 0.20}
REVIEW = "HYPOTHESIS — requires human review"


def category(relation: str = "relation") -> Column:
    out = F.lit(None).cast("string")
    for name, held in TAXONOMY.items():
        out = F.when(F.upper(relation).isin(*held), name).otherwise(out)
    return out


def contacts(edges: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """anchor, category, node, community, ts: what members touch, direction-aware.

    A place counts from both sides, a supplier from whom it supplies, money from whom it comes: its sink must be
    an account that three edges reuse, or neither a person nor an account.
    """
    kind = nodes.select("id", F.upper("entity_type").alias("t"))
    e = edges.select("src", "dst", F.upper("relation").alias("relation"), "ts").withColumn("category", category()).where("category IS NOT NULL")
    e = e.join(kind.select(F.col("id").alias("src"), F.col("t").alias("st")), "src", "left").join(kind.select(F.col("id").alias("dst"), F.col("t").alias("dt")), "dst", "left")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("degree"))
    back = F.col("relation") == "RECEIVES_FROM"
    sink, source, sort = F.when(back, F.col("src")).otherwise(F.col("dst")), F.when(back, F.col("dst")).otherwise(F.col("src")), F.coalesce(F.when(back, F.col("st")).otherwise(F.col("dt")), F.lit(""))
    money = e.where("category = 'money_routes'").select(sink.alias("anchor"), "category", source.alias("node"), "ts", sort.alias("t")).join(degree, "anchor")
    money = money.where(((F.col("t") == "ACCOUNT") & (F.col("degree") >= 3)) | ~F.col("t").isin("PERSON", "ACCOUNT")).select("anchor", "category", "node", "ts")
    supply = e.where("category = 'suppliers'").select(F.col("src").alias("anchor"), "category", F.col("dst").alias("node"), "ts")
    place = e.where("category = 'locations'")
    here = place.where("st = 'LOCATION'").select(F.col("src").alias("anchor"), "category", F.col("dst").alias("node"), "ts")
    there = place.where("dt = 'LOCATION'").select(F.col("dst").alias("anchor"), "category", F.col("src").alias("node"), "ts")
    every = money.unionByName(supply).unionByName(here).unionByName(there)
    return every.join(members.select("node", "community"), "node")


def shared_anchors(touched: DataFrame) -> DataFrame:
    """category, anchor, community, rarity (1 over the other communities, 1 at most) of anchors that two communities share."""
    per = touched.groupBy("category", "anchor", "community").agg(F.count(F.lit(1)).alias("contacts"))
    k = per.groupBy("category", "anchor").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    return per.join(k, ["category", "anchor"]).select("category", "anchor", "community", (1 / F.greatest(F.lit(1), F.col("k") - 1)).alias("rarity"))


def pair_affinity(anchors: DataFrame) -> DataFrame:
    """a, b, shared, affinity of communities that share an anchor: by category half the weighted Jaccard and half the peak rarity, damped by s / (s + 1), 12 % more for each further category."""
    size = anchors.groupBy("category", "community").agg(F.sum("rarity").alias("w"))
    x, y = anchors.alias("x"), anchors.alias("y")
    both = x.join(y, ["category", "anchor"]).where("x.community < y.community")
    per = both.groupBy("category", F.col("x.community").alias("a"), F.col("y.community").alias("b")).agg(F.sum("x.rarity").alias("w"), F.max("x.rarity").alias("peak"), F.count(F.lit(1)).alias("s"))
    per = per.join(size.select("category", F.col("community").alias("a"), F.col("w").alias("wa")), ["category", "a"]).join(size.select("category", F.col("community").alias("b"), F.col("w").alias("wb")), ["category", "b"])
    score = 0.5 * F.col("w") / (F.col("wa") + F.col("wb") - F.col("w")) + 0.5 * F.least(F.lit(1.0), F.col("peak"))
    weight = F.lit(0.0)
    for name, w in CATEGORY_WEIGHTS.items():
        weight = F.when(F.col("category") == name, w).otherwise(weight)
    part = weight * score * F.col("s") / (F.col("s") + 1)
    out = per.withColumn("part", part).groupBy("a", "b").agg(F.sum("s").alias("shared"), F.sum("part").alias("total"), F.count(F.when(F.col("part") > 1e-9, 1)).alias("active"))
    return out.select("a", "b", "shared", (F.col("total") * (1 + 0.12 * (F.col("active") - 1))).alias("affinity"))


def temporal_affinity(touched: DataFrame, anchors: DataFrame, window: int = 4 * 3600) -> DataFrame:
    """a, b, temporal: of the anchors that both communities touch at known times, the share touched within the window."""
    t = touched.where("ts IS NOT NULL").join(anchors.select("category", "anchor", "community"), ["category", "anchor", "community"], "left_semi").select("anchor", "community", seconds("ts").alias("t")).distinct()
    side = t.select("anchor", "community").distinct()
    met = side.alias("x").join(side.alias("y"), "anchor").where("x.community < y.community").select("anchor", F.col("x.community").alias("a"), F.col("y.community").alias("b"))
    own = t.select("anchor", F.col("community").alias("a"), F.col("t").alias("ta"), F.explode(F.array(*(F.floor(F.col("t") / window) + d for d in (-1, 0, 1)))).alias("bucket"))
    other = t.select("anchor", F.col("community").alias("b"), F.col("t").alias("tb"), F.floor(F.col("t") / window).alias("bucket"))
    near = own.join(other, ["anchor", "bucket"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= window)).select("anchor", "a", "b").distinct().withColumn("hit", F.lit(1))
    out = met.join(near, ["anchor", "a", "b"], "left")
    return out.groupBy("a", "b").agg((F.count("hit") / F.count(F.lit(1))).alias("temporal"))


def evaluate(edges: DataFrame, nodes: DataFrame, members: DataFrame, holes: DataFrame, embedding: DataFrame | None = None, pool: int = 5, window: int = 4 * 3600, least_affinity: float = 0.25, least_confidence: float = 0.46) -> DataFrame:
    """a, b, shared, direct_edges, affinity, temporal, penalty, confidence, proposed, ghost_id, status of all pairs of communities that share an anchor.

    holes: node, hole (0..1); embedding: a, b, similarity, if there is one. Communities of which 30 % are
    anchors are infrastructure and left out. Direct edges between members that are no anchors weigh against.
    """
    touched = checkpointed(contacts(edges, nodes, members))
    anchors = checkpointed(shared_anchors(touched))
    named = anchors.select("anchor").distinct()
    plain = members.join(named.withColumnRenamed("anchor", "node"), "node", "left_anti")
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("n")).join(plain.groupBy("community").agg(F.count(F.lit(1)).alias("free")), "community", "left").na.fill(0)
    usable = size.where((F.col("n") - F.col("free")) / F.col("n") < 0.30)
    a, b = plain.select(F.col("node").alias("src"), F.col("community").alias("x")), plain.select(F.col("node").alias("dst"), F.col("community").alias("y"))
    direct = edges.select("src", "dst").join(a, "src").join(b, "dst").where("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count(F.lit(1)).alias("direct_edges"))
    w = Window.partitionBy("community").orderBy(F.desc("hole"), "node")
    top = members.join(holes, "node", "left").na.fill(0.0, ["hole"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= pool).groupBy("community").agg(F.avg("hole").alias("hole"))
    pairs = pair_affinity(anchors)
    for end in ("a", "b"):
        pairs = pairs.join(usable.select(F.col("community").alias(end), F.col("free").alias(f"{end}_free")), end).join(top.select(F.col("community").alias(end), F.col("hole").alias(f"{end}_hole")), end)
    pairs = pairs.join(direct, ["a", "b"], "left").join(temporal_affinity(touched, anchors, window), ["a", "b"], "left").na.fill(0, ["direct_edges"]).na.fill(0.0, ["temporal"])
    density = F.col("direct_edges") / F.greatest(F.lit(1), F.col("a_free") * F.col("b_free"))
    attribute = F.when(F.col("temporal") > 0, F.least(F.lit(1.0), F.col("affinity") * (0.85 + 0.15 * F.col("temporal")))).otherwise(F.col("affinity"))
    rows = pairs.withColumns({"density": density, "attribute": attribute}).withColumn("penalty", F.least(F.lit(0.30), 0.15 * F.col("density") / 0.002))
    parts = {"attribute": F.greatest(F.lit(0.0), F.col("attribute") - F.col("penalty")), "hole": (F.col("a_hole") + F.col("b_hole")) / 2, "temporal": F.col("temporal")}
    if embedding is not None:
        rows = rows.join(embedding, ["a", "b"], "left").na.fill(0.0, ["similarity"])
        parts["embedding"] = (F.col("similarity") + 1) / 2
    total = sum(WEIGHTS[k] for k in parts)
    confidence = F.round(sum((WEIGHTS[k] * c for k, c in parts.items()), F.lit(0.0)) / total, 6)
    rows = rows.withColumn("confidence", confidence)
    connected = (F.col("direct_edges") > 2) & (F.col("density") > 0.002)
    proposed = ~connected & (F.col("attribute") >= least_affinity) & (F.col("confidence") >= least_confidence)
    ident = T.short_id("GHOST", F.concat_ws("|", "a", "b"), 12)
    return rows.select("a", "b", "shared", "direct_edges", F.round("attribute", 6).alias("affinity"), F.round("temporal", 6).alias("temporal"), F.round("penalty", 6).alias("penalty"), "confidence", connected.alias("connected"), proposed.alias("proposed"), ident.alias("ghost_id"), F.lit(REVIEW).alias("status"))


def broker_edges(ghosts: DataFrame, edges: DataFrame, members: DataFrame, holes: DataFrame, touched: DataFrame, each: int = 2) -> DataFrame:
    """ghost_id, node, side, probability: where a proposed ghost would attach, by 0.5 hole + 0.3 share of the anchors touched + 0.2 degree over the largest.

    Probability is 0.35 + 0.45 confidence + 0.20 affinity, within 0 and 0.99.
    """
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    most = degree.agg(F.max("d").alias("most"))
    anchors = shared_anchors(touched)
    near = touched.join(anchors.select("category", "anchor", "community"), ["category", "anchor", "community"], "left_semi").groupBy("community", "node").agg(F.countDistinct("anchor").alias("t"))
    total = anchors.groupBy("community").agg(F.countDistinct("anchor").alias("total"))
    rows = members.join(holes, "node", "left").join(degree, "node", "left").join(near, ["community", "node"], "left").join(total, "community", "left").na.fill(0).join(F.broadcast(most))  # one row
    score = F.round(0.5 * F.coalesce("hole", F.lit(0.0)) + 0.3 * F.when(F.col("total") > 0, F.col("t") / F.col("total")).otherwise(0.0) + 0.2 * F.col("d") / F.col("most"), 6)
    best = rows.withColumn("score", score).withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "node"))).where(F.col("r") <= each).select("community", "node", "score")
    sides = ghosts.where("proposed").select("ghost_id", "confidence", "affinity", F.explode(F.array(F.struct(F.col("a").alias("community"), F.lit("A").alias("side")), F.struct(F.col("b").alias("community"), F.lit("B").alias("side")))).alias("s")).select("ghost_id", "confidence", "affinity", "s.*")
    p = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.0), 0.35 + 0.45 * F.col("confidence") + 0.20 * F.col("affinity"))), 6)
    return sides.join(best, "community").select("ghost_id", "node", "side", p.alias("probability"), "score")


def augmented(edges: DataFrame, predicted: DataFrame) -> DataFrame:
    """edges (src, dst, relation) with inferred = false, and the predicted ones (ghost_id, node) with true."""
    real = edges.select("src", "dst", "relation", F.lit(False).alias("inferred"))
    return real.unionByName(predicted.select(F.col("ghost_id").alias("src"), F.col("node").alias("dst"), F.lit("GHOST_LINK").alias("relation"), F.lit(True).alias("inferred")))


#: Fixed value: what observed edges between two communities take off the second detector's score, once.
CONTRADICTION = 0.25


def second_opinion(edges: DataFrame, members: DataFrame, nodes: DataFrame, betweenness: DataFrame, brokers: int = 3) -> DataFrame:
    """a, b, structural, bridge, behavioural, evidence, score of every pair of communities, by their brokers (0.6 share of outside neighbours + 0.4 betweenness).

    structural: mean share of outside neighbours; bridge: the most of a broker's neighbours in both communities,
    if it has some in each; behavioural: Jaccard of the brokers' neighbourhoods; evidence: shared accounts, phones,
    places and vehicles, three at most. The contradiction is taken off once.
    """
    from linkloom.operators.graph import undirected

    adj = checkpointed(undirected(edges).select("u", "v").join(members.select(F.col("node").alias("v"), F.col("community").alias("cv")), "v", "left"))
    own = adj.join(members.select(F.col("node").alias("u"), F.col("community").alias("cu")), "u")
    cross = own.groupBy("u", "cu").agg(F.avg(F.when(F.col("cu") == F.col("cv"), 0.0).otherwise(1.0)).alias("hole"), F.count(F.lit(1)).alias("n"))
    s = cross.join(betweenness.select(F.col("node").alias("u"), "betweenness"), "u", "left").na.fill(0.0, ["betweenness"])
    w = Window.partitionBy("cu").orderBy(F.desc("score"), "u")
    top = checkpointed(s.withColumn("score", F.round(0.6 * F.col("hole") + 0.4 * F.col("betweenness"), 9)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= brokers).select("u", "cu", "hole", "n"))
    c = top.groupBy("cu").agg(F.sum("hole").alias("h"), F.count(F.lit(1)).alias("k"))
    pairs = c.alias("x").join(c.alias("y"), F.col("x.cu") < F.col("y.cu")).select(F.col("x.cu").alias("a"), F.col("y.cu").alias("b"), ((F.col("x.h") + F.col("y.h")) / (F.col("x.k") + F.col("y.k"))).alias("structural"))  # communities: the comparison itself
    reach = top.join(adj, "u").groupBy("u", "cu", "n", "cv").agg(F.count(F.lit(1)).alias("t"))
    split = reach.alias("p").join(reach.alias("q"), "u").where("p.cv < q.cv AND (p.cu = p.cv OR p.cu = q.cv)")
    bridge = split.groupBy(F.col("p.cv").alias("a"), F.col("q.cv").alias("b")).agg(F.max(F.least(F.lit(1.0), (F.col("p.t") + F.col("q.t")) / F.col("p.n"))).alias("bridge"))
    hood = top.join(adj, "u").select("cu", "v").distinct()
    size = hood.groupBy("cu").agg(F.count(F.lit(1)).alias("n"))
    both = hood.alias("p").join(hood.alias("q"), "v").where("p.cu < q.cu").select(F.col("p.cu").alias("a"), F.col("q.cu").alias("b"), "v")
    infra = nodes.where("upper(entity_type) IN ('ACCOUNT', 'PHONE', 'LOCATION', 'VEHICLE')").select(F.col("id").alias("v"), F.lit(1).alias("infra"))
    common = both.join(infra, "v", "left").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.count("infra").alias("infra"))
    d = own.where("cu < cv").groupBy(F.col("cu").alias("a"), F.col("cv").alias("b")).agg(F.count(F.lit(1)).alias("direct"))
    rows = pairs.join(bridge, ["a", "b"], "left").join(common, ["a", "b"], "left").join(d, ["a", "b"], "left").na.fill(0).na.fill(0.0, ["bridge"])
    rows = rows.join(size.select(F.col("cu").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cu").alias("b"), F.col("n").alias("nb")), "b")
    rows = rows.select("a", "b", F.round("structural", 6).alias("structural"), F.round("bridge", 6).alias("bridge"), F.round(F.col("common") / F.greatest(F.col("na") + F.col("nb") - F.col("common"), F.lit(1)), 6).alias("behavioural"), F.round(F.least(F.lit(1.0), F.col("infra") / 3), 6).alias("evidence"), "direct")
    weights = {"structural": 0.3, "bridge": 0.2, "behavioural": 0.15, "evidence": 0.15}
    blend = sum((x * F.col(k) for k, x in weights.items()), F.lit(0.0)) / sum(weights.values())
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), blend - F.when(F.col("direct") > 0, CONTRADICTION).otherwise(0.0)), 5))


def propagation(edges: DataFrame) -> DataFrame:
    """node, degree_residual, hub_contact: degree against the mean of the neighbours' (1 at least), and the share of neighbours among the top fifth by degree (ties by name)."""
    from linkloom.operators.graph import degrees, undirected

    d = degrees(edges).select("node", "degree")
    n = d.count()
    hubs = d.orderBy(F.desc("degree"), "node").limit(max(1, n // 5)).select(F.col("node").alias("v"), F.lit(1.0).alias("hub"))
    adj = undirected(edges).select("u", "v").join(d.select(F.col("node").alias("v"), F.col("degree").alias("dv")), "v").join(hubs, "v", "left")
    near = adj.groupBy(F.col("u").alias("node")).agg(F.avg("dv").alias("m"), F.avg(F.coalesce("hub", F.lit(0.0))).alias("hub_contact"))
    return d.join(near, "node").select("node", F.round((F.col("degree") - F.col("m")) / F.greatest(F.lit(1.0), F.col("m")), 6).alias("degree_residual"), F.round("hub_contact", 6).alias("hub_contact"))


def features(edges: DataFrame, members: DataFrame, holes: DataFrame, betweenness: DataFrame, touched: DataFrame) -> DataFrame:
    """One row a node: degrees, neighbours, hole score, betweenness, communities it reaches, its community's size, shared anchors by category, distinct days of contact."""
    from linkloom.operators.graph import degrees, undirected

    d = degrees(edges).select("node", "degree", "in_degree", "out_degree")
    adj = undirected(edges).select(F.col("u").alias("node"), "v")
    n = adj.groupBy("node").agg(F.count(F.lit(1)).alias("neighbour_count"))
    reach = adj.join(members.select(F.col("node").alias("v"), "community"), "v").groupBy("node").agg(F.countDistinct("community").alias("communities_reached"))
    size = members.join(members.groupBy("community").agg(F.count(F.lit(1)).alias("community_size")), "community").select("node", "community_size")
    a = touched.join(shared_anchors(touched).select("category", "anchor", "community"), ["category", "anchor", "community"], "left_semi")
    per = a.groupBy("node").agg(*(F.countDistinct(F.when(F.col("category") == c, F.col("anchor"))).alias(f"{c}_anchors") for c in TAXONOMY), F.countDistinct(F.to_date("ts")).alias("contact_days"))
    out = d.join(n, "node", "left").join(reach, "node", "left").join(size, "node", "left").join(holes, "node", "left").join(betweenness.select("node", "betweenness"), "node", "left").join(per, "node", "left").na.fill(0)
    return out.withColumn("bridges_communities", F.col("communities_reached") >= 2)
