"""Profiles of nodes, pairs, communities, cases and data quality over an edge table.

Edges are (edge_id, src, dst, relation, ts, confidence, value); edges may lack a time or a confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.numbers import binary_round, exact_round
from linkloom.functions.text import cosine
from linkloom.operators.intervals import band_semi_join, seconds

#: Layers of relations, SOCIAL for any other.
LAYERS = {
    "COMMUNICATION": ("CALLED", "MESSED"),
    "FINANCIAL": ("TRANSFERRED_TO", "TRANSFERRED_FUNDS", "USES_ACCOUNT"),
    "LOCATION": ("LOCATED_IN", "LOCATED_AT"),
    "ORGANIZATIONAL": ("MEMBER_OF", "LEADS", "WORKS_FOR", "REGISTERED_TO"),
}
#: Older names of relations.
ALIASES = {"TRANSFERRED_FUNDS": "TRANSFERRED_TO", "TRANSFER": "TRANSFERRED_TO", "TRANSFERRED": "TRANSFERRED_TO", "LOCATED_AT": "LOCATED_IN"}


def layer(relation: str | Column = "relation") -> Column:
    name = F.upper(F.trim(F.col(relation) if isinstance(relation, str) else relation))
    out = F.lit("SOCIAL")
    for label, held in LAYERS.items():
        out = F.when(name.isin(*held), label).otherwise(out)
    return out


def relation_name(relation: str = "relation") -> Column:
    """The canonical name of a relation: RELATED_TO for a missing one."""
    name = F.upper(F.trim(F.coalesce(relation, F.lit(""))))
    out = F.when(name == "", "RELATED_TO").otherwise(name)
    for old, new in ALIASES.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """node, other, outgoing and the columns: each edge from both of its ends."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("outgoing")))
    return edges.select(F.explode(ends).alias("e"), *columns).select("e.*", *columns)


def _days(late: Column, early: Column) -> Column:
    return (seconds(late) - seconds(early)) / 86400


def pair_features(edges: DataFrame, now: str) -> DataFrame:
    """Per unordered pair: interactions, first and last, persistence (active days over the span of a day at least), days to now, layers."""
    a, b = F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    rows = edges.select(a, b, "ts", layer().alias("layer"))
    out = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.array_join(F.sort_array(F.collect_set("layer")), ",").alias("layers"))
    span = _days(F.col("last_ts"), F.col("first_ts"))
    persistence = F.when(F.col("last_ts") > F.col("first_ts"), binary_round(F.col("active_days") / F.greatest(span, F.lit(1.0)), 4)).otherwise(0.0)
    recency = binary_round(F.greatest(_days(F.lit(now).cast("timestamp_ntz"), F.col("last_ts")), F.lit(0.0)), 2)
    return out.select("a", "b", "n", "first_ts", "last_ts", persistence.alias("persistence"), F.coalesce(recency, F.lit(0.0)).alias("recency_days"), "layers")


def timeline_statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, dated edges, their share, first and last, nodes with dated edges, new edges a day."""
    out = edges.agg(F.count(F.lit(1)).alias("edges"), F.count("ts").alias("dated"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    active = edges.where("ts IS NOT NULL").select(F.explode(F.array("src", "dst")).alias("n")).agg(F.countDistinct("n").alias("active_nodes"))
    rate = F.when(_days(F.col("last_ts"), F.col("first_ts")) > 0, F.col("dated") / F.greatest(_days(F.col("last_ts"), F.col("first_ts")), F.lit(1.0))).otherwise(0.0)
    return out.join(F.broadcast(active)).withColumns({"coverage": F.round(F.col("dated") / F.greatest("edges", F.lit(1)), 4), "per_day": F.round(rate, 4)})  # one row


def layer_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(layer().alias("layer")).agg(F.count(F.lit(1)).alias("n"))


def community_ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, community, internal for each end of each edge at a member; a node without a community is outside of all."""
    own = members.select("node", "community")
    other = members.select(F.col("node").alias("other"), F.col("community").alias("__c"))
    rows = endpoints(edges).join(own, "node").join(other, "other", "left")
    return rows.select("node", "community", F.coalesce(F.col("community") == F.col("__c"), F.lit(False)).alias("internal"))


def community_details(edges: DataFrame, members: DataFrame, top: int = 12) -> DataFrame:
    """Size, internal and external edges, density, and the ids of the busiest members and bridges (external edges); ties by id."""
    ends = community_ends(edges, members)
    degree = ends.groupBy("community", "node").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.when(F.col("internal"), 1).otherwise(0)).alias("inside"))
    all_members = members.select("community", "node").join(degree, ["community", "node"], "left").na.fill(0)
    out = all_members.groupBy("community").agg(F.count(F.lit(1)).alias("size"), (F.sum("inside") / 2).cast("long").alias("internal_edges"), F.sum(F.col("degree") - F.col("inside")).alias("external_edges"))

    def busiest(rows: DataFrame, name: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
        first = rows.withColumn("rank", rank).where(F.col("rank") <= top)
        return first.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"]), ",").alias(name))

    most = F.col("size") * (F.col("size") - 1) / 2
    out = out.withColumn("density", F.when(most > 0, F.round(F.col("internal_edges") / most, 4)).otherwise(0.0))
    out = out.join(busiest(all_members, "key_entities"), "community", "left")
    return out.join(busiest(all_members.where("degree > inside"), "bridge_entities"), "community", "left").na.fill("", ["bridge_entities"])


def community_roles(edges: DataFrame, members: DataFrame, betweenness: DataFrame, broker: float = 0.05) -> DataFrame:
    """community, node, role, degree, external_edges: BROKER, BRIDGE, CORE, PERIPHERAL or ISOLATE."""
    d = community_ends(edges, members).groupBy("community", "node").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.when(F.col("internal"), 0).otherwise(1)).alias("external_edges"))
    rows = members.select("community", "node").join(d, ["community", "node"], "left").join(betweenness, "node", "left").na.fill(0)
    role = F.when((F.col("external_edges") >= 2) & (F.col("betweenness") > broker), "BROKER").when(F.col("external_edges") >= 1, "BRIDGE").when(F.col("degree") >= 3, "CORE").when(F.col("degree") >= 1, "PERIPHERAL").otherwise("ISOLATE")
    return rows.select("community", "node", role.alias("role"), "degree", "external_edges")


def type_shares(nodes: DataFrame, kind: str = "entity_type") -> DataFrame:
    rows = nodes.groupBy(F.coalesce(kind, F.lit("UNKNOWN")).alias(kind)).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # one row a type


def monthly_variation(edges: DataFrame) -> DataFrame:
    """One row: sample deviation of the monthly counts over their mean (1 at least); 0 for a single month."""
    m = edges.where("ts IS NOT NULL").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).count()
    return m.agg(F.round(F.coalesce(F.stddev_samp("count"), F.lit(0.0)) / F.greatest(F.coalesce(F.avg("count"), F.lit(0.0)), F.lit(1.0)), 4).alias("burst_index"), F.count(F.lit(1)).alias("months"))


def _rows(one: DataFrame) -> DataFrame:
    return one.unpivot([], one.columns, "dimension", "score")


def quality_dimensions(nodes: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """The seven dimensions and their mean (OVERALL). nodes: id, label, entity_type, aliases; findings: evidence (a count)."""
    share = lambda c: F.round(F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0)), 4)
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    completeness = nodes.agg(F.round(F.coalesce(F.sum(filled("label") + filled("entity_type")) / (2 * F.count(F.lit(1))), F.lit(0.0)), 4).alias("COMPLETENESS"), F.round(F.least(F.lit(1.0), 0.7 + 0.3 * F.avg(F.when(F.size("aliases") > 0, 1.0).otherwise(0.0))), 4).alias("ENTITY_RESOLUTION"))
    names = nodes.where("label IS NOT NULL").groupBy("id").agg(F.countDistinct("label").alias("k")).agg(F.round(1 - F.coalesce(F.avg(F.when(F.col("k") > 1, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("CONSISTENCY"))
    twins = nodes.where("trim(label) <> ''").groupBy(F.lower(F.trim("label")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.round(1 - F.coalesce(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), F.lit(0.0)), 4).alias("DUPLICATE_RISK"))
    tied = edges.agg(share(F.col("ts").isNotNull()).alias("TEMPORAL"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("EXTRACTION_CONFIDENCE"))
    shown = findings.agg(share(F.col("evidence") > 0).alias("EVIDENCE_COVERAGE"))
    out = _rows(completeness)
    for part in (names, twins, tied, shown):
        out = out.unionByName(_rows(part))
    return out.unionByName(out.agg(F.lit("OVERALL").alias("dimension"), F.round(F.avg("score"), 4).alias("score")))


def entity_quality(nodes: DataFrame, edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per node: identity and relationship confidence, evidence and temporal coverage. Outgoing edges count; evidence: node, evidence_id."""
    mentions = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("mentions"))
    out_edges = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("edges"), F.count("ts").alias("dated"), F.avg("confidence").alias("sure"))
    seen = evidence.groupBy(F.col("node").alias("id")).agg(F.countDistinct("evidence_id").alias("records"))
    rows = nodes.select("id").join(mentions, "id", "left").join(out_edges, "id", "left").join(seen, "id", "left")
    return rows.select(
        "id", F.round(F.least(F.lit(1.0), 0.5 + F.greatest(F.coalesce("mentions", F.lit(1)), F.lit(1)) / 20), 4).alias("identity_confidence"), F.round(F.least(F.lit(1.0), F.coalesce("records", F.lit(0)) / 5), 4).alias("evidence_coverage"),
        F.round(F.coalesce("dated", F.lit(0)) / F.greatest(F.coalesce("edges", F.lit(0)), F.lit(1)), 4).alias("temporal_coverage"), exact_round(F.coalesce("sure", F.lit(0.5)), 4).alias("relationship_confidence"),
    )


def behaviour(edges: DataFrame, incidents: DataFrame, hours: int = 24) -> DataFrame:
    """Per node: calls, contacts, mean duration, meetings, money in and out, transfers, places, degree, edges within `hours` of an incident (ts)."""
    near = band_semi_join(edges.where("ts IS NOT NULL").select("edge_id", "src", "dst", "ts"), incidents.select("ts"), [], "ts", hours * 3600)
    overlaps = endpoints(near, "edge_id").groupBy("node").agg(F.countDistinct("edge_id").alias("incident_overlaps"))
    rel = relation_name()
    e = endpoints(edges.withColumn("r", rel), "r", "value")
    is_ = lambda name: F.col("r") == name
    money = lambda c: F.round(F.coalesce(F.sum(F.when(is_("TRANSFERRED_TO") & c, F.col("value").cast("decimal(18,4)"))), F.lit(0)), 2).cast("double")
    out = e.groupBy("node").agg(
        F.count(F.when(is_("CALLED"), 1)).alias("calls"), F.countDistinct(F.when(is_("CALLED") | is_("MET"), F.col("other"))).alias("contacts"), exact_round(F.coalesce(F.avg(F.when(is_("CALLED"), F.col("value"))), F.lit(0.0)), 4).alias("mean_duration"),
        F.count(F.when(is_("MET"), 1)).alias("met"), money(~F.col("outgoing")).alias("incoming"), money(F.col("outgoing")).alias("sent"), F.count(F.when(is_("TRANSFERRED_TO"), 1)).alias("transfers"),
        F.countDistinct(F.when(is_("LOCATED_IN") & F.col("outgoing"), F.col("other"))).alias("places"), F.count(F.lit(1)).alias("degree"),
    )
    return out.join(overlaps, "node", "left").na.fill(0, ["incident_overlaps"])


def normalized_delta(before: Column, after: Column) -> Column:
    """Relative change within 0 and 1; from nothing to a it is a / (a + 1)."""
    before, after = F.coalesce(before, F.lit(0)).cast("double"), F.coalesce(after, F.lit(0)).cast("double")
    return F.when((before == 0) & (after == 0), 0.0).when(before == 0, F.least(F.lit(1.0), after / (after + 1))).otherwise(F.least(F.lit(1.0), F.abs(after - before) / F.greatest(before, after)))


def profile_change(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Per key: the changed measures with their normalised deltas, and the mean of those that changed (0 for none)."""
    a = before.select(key, *(F.col(m).alias(f"__a_{m}") for m in measures))
    b = after.select(key, *(F.col(m).alias(f"__b_{m}") for m in measures))
    rows = a.join(b, key, "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    changed = {m: zero(F.col(f"__a_{m}")) != zero(F.col(f"__b_{m}")) for m in measures}
    deltas = {m: F.when(changed[m], normalized_delta(F.col(f"__a_{m}"), F.col(f"__b_{m}"))) for m in measures}
    held = F.array_compact(F.array(*deltas.values()))
    mean = F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)).otherwise(0.0)
    return rows.select(key, *(F.round(F.coalesce(d, F.lit(0.0)), 6).alias(f"{m}_delta") for m, d in deltas.items()), F.round(F.least(F.lit(1.0), mean), 4).alias("change"))


def signal_confidence(signals: DataFrame, penalties: DataFrame | None = None) -> DataFrame:
    """signals (subject, family, value, weight): weighted mean by family, then over families by their weights, less the penalty (subject, penalty).

    Values are cut to 0..1 and rounded to four places first, as are weights.
    """
    value = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))), 4)
    weight = F.round(F.greatest(F.lit(0.0), F.col("weight")), 4)
    families = signals.select("subject", "family", value.alias("v"), weight.alias("w")).groupBy("subject", "family").agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("w")).where("w > 0")
    total = families.groupBy("subject").agg(F.sum("vw").alias("vw"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("families"))
    total = total.withColumn("penalty", F.lit(0.0)) if penalties is None else total.join(penalties, "subject", "left").na.fill(0.0, ["penalty"])
    return total.select("subject", "families", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("vw") / F.col("w") - F.col("penalty"))), 4).alias("confidence"))


#: Components of the priority score and their weights.
PRIORITY = {"network_influence": 0.25, "bridge_potential": 0.20, "communication_anomaly": 0.15, "financial_anomaly": 0.15, "temporal_correlation": 0.10, "cross_case_linkage": 0.05, "evidence_strength": 0.10}


def priority_components(metrics: DataFrame, key: str = "node") -> DataFrame:
    """The seven components from pagerank, degree_centrality, betweenness, ghost, communication, financial (confidences or null), proximity, cases, records.

    A component without anything to measure is null; evidence is 0.5 where there is none.
    """
    rows = metrics if "top" in metrics.columns else metrics.join(F.broadcast(metrics.agg(F.max("pagerank").alias("top"))))  # one row
    cut = lambda c: F.bround(F.least(F.lit(1.0), c), 4)
    return rows.select(
        key, cut(0.6 * F.when(F.col("top") > 0, F.col("pagerank") / F.col("top")).otherwise(0.0) + 0.4 * F.col("degree_centrality")).alias("network_influence"),
        cut(0.65 * F.col("betweenness") + 0.35 * F.coalesce("ghost", F.lit(0.0))).alias("bridge_potential"), cut(F.col("communication")).alias("communication_anomaly"), cut(F.col("financial")).alias("financial_anomaly"),
        F.when(F.col("proximity") > 0, F.bround("proximity", 4)).alias("temporal_correlation"), F.when(F.col("cases") > 0, 1.0).alias("cross_case_linkage"), F.when(F.coalesce("records", F.lit(0)) == 0, 0.5).otherwise(cut(0.5 + F.col("records") / 60.0)).alias("evidence_strength"),
    )


def priority_score(components: DataFrame, key: str = "node", weights: dict[str, float] | None = None) -> DataFrame:
    """key, priority (weighted mean of the components that are there, times 100, rounded to even) and its tier."""
    weights = weights or PRIORITY
    total = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    value = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    score = F.when(total > 0, exact_round(100 * value / total, 2, even=True)).otherwise(0.0)
    out = components.withColumn("priority", score)
    return out.select(key, "priority", F.when(F.col("priority") >= 75, "CRITICAL").when(F.col("priority") >= 50, "HIGH").when(F.col("priority") >= 25, "MEDIUM").otherwise("LOW").alias("tier"))


def fingerprint(edges: DataFrame, case: str, kinds: DataFrame) -> DataFrame:
    """Per case of edges (with a column `case`): counts, degree statistics, centralisation, density, fans, shares of layers, burst index, confidence, features.

    kinds: node, entity_type. Communities, bridges and cycles are joined by the caller where wanted.
    """
    e = endpoints(edges.withColumn("case", F.col(case)), "case")
    degree = e.groupBy("case", "node").agg(F.count(F.lit(1)).alias("d"), F.sum(F.when(F.col("outgoing"), 1).otherwise(0)).alias("o"))
    per = degree.groupBy("case").agg(F.count(F.lit(1)).alias("entities"), F.avg("d").alias("mean"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"), F.max("d").alias("top"), F.count(F.when(F.col("d") - F.col("o") >= 3, 1)).alias("fan_in"), F.count(F.when(F.col("o") >= 3, 1)).alias("fan_out"))
    hubs = degree.join(per, "case").where("d >= mean + 2 * sd").groupBy("case").agg(F.count(F.lit(1)).alias("hubs"))
    of = edges.withColumn("case", F.col(case))
    simple = of.where("src <> dst").groupBy("case").agg(F.countDistinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("pairs"))
    tied = of.groupBy("case").agg(F.count(F.lit(1)).alias("relations"), F.count(F.when(layer() == "FINANCIAL", 1)).alias("financial"), F.count(F.when(layer() == "COMMUNICATION", 1)).alias("communication"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("sure"))
    monthly = of.where("ts IS NOT NULL").groupBy("case", F.date_format("ts", "yyyy-MM").alias("month")).count().groupBy("case").agg((F.coalesce(F.stddev_samp("count"), F.lit(0.0)) / F.greatest(F.avg("count"), F.lit(1.0))).alias("burst"))
    people = degree.join(kinds, "node", "left").groupBy("case").agg(F.count(F.when(F.col("entity_type") == "PERSON", 1)).alias("persons"))
    rows = per.join(tied, "case").join(simple, "case", "left").join(hubs, "case", "left").join(monthly, "case", "left").join(people, "case", "left").na.fill(0)
    n, m = F.col("entities"), F.col("relations")
    r = lambda c, k=6: F.round(c, k)
    return rows.select(
        F.col("case"), "entities", "relations", r(F.col("mean"), 4).alias("avg_degree"), r(F.col("sd"), 4).alias("degree_std"), r(F.col("top") / F.greatest(n - 1, F.lit(1)), 4).alias("centralization"), r(F.when(n > 1, 2 * F.col("pairs") / (n * (n - 1))).otherwise(0.0)).alias("density"),
        "fan_in", "fan_out", F.col("hubs").cast("long").alias("hubs"), "financial", "communication", r(F.col("financial") / m).alias("financial_share"), r(F.col("communication") / m).alias("communication_share"), r(F.col("burst"), 4).alias("burst_index"), r(F.col("sure"), 4).alias("avg_confidence"), r(F.col("persons") / n).alias("person_share"),
    )


def case_similarity(prints: DataFrame) -> DataFrame:
    """Pairs of cases: similarity of five dimensions and their weighted mean (0.35, 0.20, 0.15, 0.15, 0.15)."""
    feats = {
        "structural": ("least(entities / 500.0, 1.0)", "least(relations / 2000.0, 1.0)", "least(avg_degree / 20.0, 1.0)", "centralization", "density", "fan_in / entities", "fan_out / entities"),
        "composition": ("person_share", "1 - person_share"),
        "motif": ("hubs / entities", "fan_in / entities", "fan_out / entities"),
    }
    rows = prints.select("case", "financial_share", "burst_index", *(F.array(*(F.expr(f"CAST({x} AS DOUBLE)") for x in xs)).alias(name) for name, xs in feats.items()))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, F.col("a.case") < F.col("b.case"))  # all pairs of cases: the comparison itself; cases are few
    sims = {name: F.round(cosine(F.col(f"a.{name}"), F.col(f"b.{name}")), 6) for name in feats}
    sims["financial"] = F.round(1 - F.abs(F.col("a.financial_share") - F.col("b.financial_share")), 6)
    sims["temporal"] = F.round(F.greatest(F.lit(0.0), 1 - F.abs(F.col("a.burst_index") - F.col("b.burst_index")) / 2), 6)
    out = pairs.select(F.col("a.case").alias("a"), F.col("b.case").alias("b"), *(c.alias(k) for k, c in sims.items()))
    w = {"structural": 0.35, "financial": 0.20, "temporal": 0.15, "composition": 0.15, "motif": 0.15}
    return out.withColumn("similarity", F.round(sum((F.col(k) * x for k, x in w.items()), F.lit(0.0)), 4))


def min_max(rows: DataFrame, column: str, constant: float = 0.0, inverse: bool = False) -> DataFrame:
    """rows with <column>_norm in 0..1; NaN counts as the smallest value, a constant column gives `constant`."""
    clean = F.when(~F.isnan(column), F.col(column))
    bounds = rows.agg(F.min(clean).alias("__lo"), F.max(clean).alias("__hi"))
    value = (F.coalesce(clean, "__lo") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    value = F.when(F.col("__hi") > F.col("__lo"), 1 - value if inverse else value).otherwise(constant)
    return rows.join(F.broadcast(bounds)).withColumn(f"{column}_norm", F.round(value, 6)).drop("__lo", "__hi")  # one row


def pick_canonical(mentions: DataFrame, group: str, name: str) -> DataFrame:
    """group, canonical, aliases: the most frequent name, then the one of most words, the longest, the first in order."""
    names = mentions.groupBy(group, name).agg(F.count(F.lit(1)).alias("n"))
    order = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.size(F.split(name, " "))), F.desc(F.length(name)), name))
    return names.withColumn("r", order).groupBy(group).agg(F.max(F.when(F.col("r") == 1, F.col(name))).alias("canonical"), F.count(F.lit(1)).alias("names"), F.sum("n").alias("mentions"))


def mode(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The commonest value of each group, ties to the first in order."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value))
    return counts.withColumn("r", first).where("r = 1").select(group, value, "n")


def last_wins(rows: DataFrame, group: str, key: str, value: str, order: list[str]) -> DataFrame:
    """group, key, value: of several values of a key the last in order."""
    return rows.groupBy(group, key).agg(F.max_by(value, F.struct(*order)).alias(value))


def gang_report(members: DataFrame, edges: DataFrame, meetings: DataFrame) -> DataFrame:
    """members (node, community): members, calls, transfers, meetings and money that touch each gang; risk 0.02 c + 0.05 t + sum / 1e5, levels above 80, 200, 400.

    An edge counts once for a gang, also with both ends in it.
    """
    own = members.select("node", F.col("community").alias("gang"))
    e = edges.select("edge_id", "src", "dst", "relation", "value")
    at = lambda end: e.join(own.withColumnRenamed("node", end), end).select("gang", "edge_id", "relation", "value")
    touched = at("src").union(at("dst")).distinct()
    paid = relation_name() == "TRANSFERRED_TO"
    counts = touched.groupBy("gang").agg(F.count(F.when(F.col("relation") == "CALLED", 1)).alias("calls"), F.count(F.when(paid, 1)).alias("txns"), F.round(F.sum(F.when(paid, F.col("value").cast("decimal(18,4)"))), 2).cast("double").alias("amount"))
    met = meetings.select("meeting_id", F.explode("attendees").alias("node")).join(own, "node").groupBy("gang").agg(F.countDistinct("meeting_id").alias("meetings"))
    out = own.groupBy("gang").agg(F.count(F.lit(1)).alias("members")).join(counts, "gang", "left").join(met, "gang", "left").na.fill(0)
    out = out.withColumn("risk", F.round(0.02 * F.col("calls") + 0.05 * F.col("txns") + F.col("amount") / 100000, 4))
    return out.withColumn("level", F.when(F.col("risk") > 400, "CRITICAL").when(F.col("risk") > 200, "HIGH").when(F.col("risk") > 80, "MEDIUM").otherwise("LOW"))


def flows_with_evidence(edges: DataFrame, least: float = 0.0, start: str | None = None, end: str | None = None, top: int | None = None) -> DataFrame:
    """Sum, count and the first ten edge ids of each (src, dst); undated edges pass a date range; with top the largest only."""
    inside = F.lit(True)
    if start is not None:
        inside &= F.col("ts") >= F.lit(start).cast("timestamp_ntz")
    if end is not None:
        inside &= F.col("ts") <= F.lit(end).cast("timestamp_ntz")
    rows = edges.where(F.col("ts").isNull() | inside)
    first = rows.select("src", "dst", "edge_id", F.row_number().over(Window.partitionBy("src", "dst").orderBy("edge_id")).alias("r")).where("r <= 10")  # cut before the exchange
    first = first.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_list("edge_id")), ",").alias("evidence"))
    out = rows.groupBy("src", "dst").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("s"), F.count(F.lit(1)).alias("transaction_count"))
    out = out.where(F.col("s") >= least).join(first, ["src", "dst"]).select("src", "dst", F.round("s", 2).cast("double").alias("total_amount"), "transaction_count", "evidence")
    return out if top is None else out.orderBy(F.desc("total_amount"), "src", "dst").limit(top)


def polarity_balance(items: DataFrame) -> DataFrame:
    """items (finding, polarity): counts and the share of supporting among classified ones."""
    n = lambda p: F.count(F.when(F.col("polarity") == p, 1))
    out = items.groupBy("finding").agg(n("SUPPORTING").alias("support_count"), n("CONTRADICTORY").alias("contradiction_count"), n("UNKNOWN").alias("unknown_count"))
    return out.withColumn("balance", F.round(F.col("support_count") / F.greatest(F.col("support_count") + F.col("contradiction_count"), F.lit(1)), 4))
