"""Queries on communities, snapshots, removals, bridges, layers, replay, motifs and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import network, paths, profiles
from linkloom.operators.graph import modularity, pagerank, relationship_gaps, removal_fragmentation
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, places, table, transfers

CALL = ("v_call",)
EDGE = ("v_call", "v_loc", "v_edge")
#: A small dense graph from whole tables: market segments and nations of customers, nations and regions.
SMALL = """s AS (SELECT DISTINCT 'M:' || c_mktsegment AS src, 'N:' || c_nationkey AS dst FROM customer UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation), a AS (SELECT src AS u, dst AS v FROM s UNION SELECT dst, src FROM s), nodes AS (SELECT DISTINCT u AS node FROM a)"""


def _small(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    s = c.select(F.concat(F.lit("M:"), "c_mktsegment").alias("src"), F.concat(F.lit("N:"), "c_nationkey").alias("dst"))
    return s.unionByName(n.select(F.concat(F.lit("N:"), "n_nationkey").alias("src"), F.concat(F.lit("R:"), "n_regionkey").alias("dst"))).distinct()


def _small_members(spark, sf):
    """Regions as communities; segments are one of their own."""
    n = table(spark, sf, "nation")
    nations = n.select(F.concat(F.lit("N:"), "n_nationkey").alias("node"), F.concat(F.lit("R:"), "n_regionkey").alias("community"))
    regions = n.select(F.concat(F.lit("R:"), "n_regionkey").alias("node")).distinct().withColumn("community", F.col("node"))
    segments = table(spark, sf, "customer").select(F.concat(F.lit("M:"), "c_mktsegment").alias("node")).distinct().withColumn("community", F.lit("M"))
    return nations.unionByName(regions).unionByName(segments)


MEMBERS = "mem AS (SELECT 'N:' || n_nationkey AS node, 'R:' || n_regionkey AS community FROM nation UNION SELECT 'R:' || n_regionkey, 'R:' || n_regionkey FROM nation UNION SELECT 'M:' || c_mktsegment, 'M' FROM customer)"


def _bfs(graph: str, name: str, tag: str = "", most: int = 8) -> str:
    """CTEs of breadth-first levels of a graph with columns (tag,) u, v: name(tag, s, node, d)."""
    t, on = (f"{tag}, ", f"AND e.{tag} = x.{tag}") if tag else ("", "")
    out = f"{name}0 AS (SELECT DISTINCT {t}u AS s, u AS node FROM {graph})"
    for d in range(1, most + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM {name}{i} o WHERE o.s = x.s AND o.node = e.v{f' AND o.{tag} = x.{tag}' if tag else ''})" for i in range(max(0, d - 2), d))
        out += f", {name}{d} AS (SELECT DISTINCT {f'x.{tag}, ' if tag else ''}x.s, e.v AS node FROM {name}{d - 1} x JOIN {graph} e ON e.u = x.node {on} WHERE TRUE {seen})"
    return out + f", {name} AS (" + " UNION ALL ".join(f"SELECT {t}s, node, {d} AS d FROM {name}{d}" for d in range(most + 1)) + ")"


@query()
def grf_louvain(spark, sf):
    """GRF-11: communities of the users. No oracle: local moves are no SQL; unit tests of modularity and reruns."""
    return network.louvain(calls(spark, sf))


@query(f"""WITH {SMALL}, {_bfs('a', 'b')}, c AS (SELECT s, min(node) AS comp FROM b GROUP BY s), z AS (SELECT comp, count(*) AS n FROM c GROUP BY 1), k AS (SELECT count(*) AS nodes FROM nodes)
SELECT k.nodes, (SELECT count(*) // 2 FROM a) AS edges, round((SELECT count(*) FROM a) / (k.nodes * (k.nodes - 1))::DOUBLE, 6) AS density, (SELECT count(*) FROM z) AS components, (SELECT max(n) FROM z) AS giant, round(1 - (SELECT max(n) FROM z) / k.nodes::DOUBLE, 6) AS fragmentation, round((SELECT sum(1.0::DOUBLE / d) FROM b WHERE d > 0) / (k.nodes * (k.nodes - 1)), 6) AS efficiency, round((SELECT avg(d) FROM b WHERE d > 0), 6) AS path_length FROM k""")
def grf_snapshot_metrics(spark, sf):
    """GRF-14, GRF-15, AGG-12: the battery on a dense small graph."""
    return network.snapshot(_small(spark, sf)).drop("label")


def _drop(prefix: str) -> str:
    return f"(SELECT sum(i / m - power(k / m, 2)) FROM {prefix})"


REMOVAL = f"""{SMALL}, {MEMBERS}, {_bfs('a', 'b')}, vic AS (SELECT node AS removed FROM nodes WHERE node LIKE 'M:%' OR node LIKE 'R:%'), ax AS (SELECT removed, u, v FROM a, vic WHERE u <> removed AND v <> removed), {_bfs('ax', 'x', 'removed')},
lf AS (SELECT removed, node FROM nodes, vic WHERE node <> removed), cp AS (SELECT lf.removed, lf.node, coalesce((SELECT min(x.node) FROM x WHERE x.removed = lf.removed AND x.s = lf.node), lf.node) AS comp FROM lf), zz AS (SELECT removed, max(n) AS gcc, count(*) AS pieces FROM (SELECT removed, comp, count(*) AS n FROM cp GROUP BY 1, 2) GROUP BY 1),
jt AS (SELECT removed, community, comp, count(*)::DOUBLE AS c FROM cp JOIN mem USING (node) GROUP BY 1, 2, 3), jn AS (SELECT *, sum(c) OVER (PARTITION BY removed, community) AS cc, sum(c) OVER (PARTITION BY removed) AS n FROM jt),
en AS (SELECT removed, -sum(c / n * ln(c / n)) AS h1, -sum(c / n * ln(cc / n)) AS h0, count(DISTINCT CASE WHEN c < cc THEN community END) AS split_communities FROM jn GROUP BY 1),
q0 AS (SELECT sum(i / m - power(k / m, 2)) AS q FROM (SELECT cu, sum((cu = cv)::INT) AS i, count(*) AS k, sum(count(*)) OVER () AS m FROM (SELECT x.community AS cu, y.community AS cv FROM a JOIN mem x ON x.node = u JOIN mem y ON y.node = v) GROUP BY cu)),
q1 AS (SELECT removed, sum(i / m - power(k / m, 2)) AS q FROM (SELECT removed, cu, sum((cu = cv)::INT) AS i, count(*) AS k, sum(count(*)) OVER (PARTITION BY removed) AS m FROM (SELECT removed, x.community AS cu, y.community AS cv FROM ax JOIN mem x ON x.node = u JOIN mem y ON y.node = v) GROUP BY removed, cu) GROUP BY 1),
g AS (SELECT count(*) AS n0, (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY s)) AS g0, round((SELECT sum(1.0::DOUBLE / d) FROM b WHERE d > 0) / (count(*) * (count(*) - 1)), 6) AS e0, round((SELECT avg(d) FROM b WHERE d > 0), 6) AS p0 FROM nodes), pl AS (SELECT removed, sum(1.0::DOUBLE / d) AS near, round(avg(d), 6) AS p, count(DISTINCT s) AS n FROM x WHERE d > 0 GROUP BY 1),
pp AS (SELECT zz.removed, pieces, split_communities, round(greatest(0, (1 - gcc / (n0 - 1)::DOUBLE) - round(1 - g0 / n0::DOUBLE, 6)), 6) AS fragmentation_increase, round(greatest(0, (e0 - round(near / (pl.n * (pl.n - 1)), 6) * pl.n * (pl.n - 1) / ((n0 - 1) * (n0 - 2))) / e0), 6) AS efficiency_loss, round(greatest(0, 1 - CASE WHEN h1 > 0 AND h0 > 0 THEN sqrt(h0 / h1) WHEN h1 = h0 THEN 1 ELSE 0 END), 6) AS community_disruption,
 round(greatest(0, (g0 - gcc) / n0::DOUBLE), 6) AS gcc_loss, round(greatest(0, coalesce((p - p0) / p0, 0)), 6) AS path_length_increase, round(least(1, greatest(0, (q0.q - q1.q) / greatest(abs(q0.q), 1e-9))), 6) AS modularity_drop FROM zz JOIN en USING (removed) JOIN pl USING (removed) JOIN q1 USING (removed), g, q0)"""


@query(f"""WITH {REMOVAL}, im AS (SELECT *, round(0.25::DOUBLE * fragmentation_increase + 0.25::DOUBLE * efficiency_loss + 0.2::DOUBLE * community_disruption + 0.15::DOUBLE * gcc_loss + 0.1::DOUBLE * path_length_increase + 0.05::DOUBLE * modularity_drop, 4) AS impact FROM pp)
SELECT removed, pieces, split_communities, fragmentation_increase, efficiency_loss, round(community_disruption, 5) AS community_disruption, gcc_loss, path_length_increase, round(modularity_drop, 5) AS modularity_drop, round(impact, 3) AS impact, CASE WHEN impact >= 0.3 THEN 'critical' WHEN impact >= 0.15 THEN 'high' WHEN impact >= 0.07 THEN 'medium' ELSE 'low' END AS disruption FROM im""")
def grf_removal_effects(spark, sf):
    """GRF-17, GRF-19, GRF-20: what each segment's and region's removal does to the small graph."""
    s = _small(spark, sf)
    victims = s.select(F.explode(F.array("src", "dst")).alias("removed")).where("removed LIKE 'M:%' OR removed LIKE 'R:%'").distinct()
    out = network.removal_effects(s, _small_members(spark, sf), victims)
    return out.drop("rank", "note").withColumns({"community_disruption": F.round("community_disruption", 5), "modularity_drop": F.round("modularity_drop", 5), "impact": F.round("impact", 3)})


@query("""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_call), e AS (SELECT a AS u, b AS v FROM p UNION ALL SELECT b, a FROM p), n AS (SELECT v FROM e WHERE u = 'U:7'), r AS (SELECT * FROM e WHERE u <> 'U:7' AND v <> 'U:7'), d AS (SELECT u AS a, v AS b FROM r WHERE u < v AND u IN (SELECT v FROM n) AND v IN (SELECT v FROM n)),
t AS (SELECT DISTINCT x.u AS a, y.u AS b FROM r x JOIN r y ON x.v = y.v AND x.u < y.u WHERE x.u IN (SELECT v FROM n) AND y.u IN (SELECT v FROM n)), k AS (SELECT count(*) AS kept FROM (SELECT * FROM d UNION SELECT * FROM t)), c AS (SELECT count(*) AS n FROM n)
SELECT 'U:7' AS removed, c.n AS neighbours, (SELECT count(*) FROM v_call WHERE src = 'U:7' OR dst = 'U:7') AS incident_edges, c.n * (c.n - 1) // 2 AS pairs, kept AS rerouted_pairs, round(kept / (c.n * (c.n - 1) // 2)::DOUBLE, 6) AS rerouting_score FROM c, k""", CALL)
def grf_removal_payload(spark, sf):
    """GRF-18: a user's neighbours and their ways around."""
    return network.removal_payload(calls(spark, sf), "U:7")


@query("""WITH d AS (SELECT node, count(*)::DOUBLE AS degree, count(CASE WHEN o THEN 1 END)::DOUBLE AS pagerank, sum(CAST(value AS DECIMAL(18,4)))::DOUBLE AS betweenness FROM (SELECT src AS node, TRUE AS o, value FROM v_call UNION ALL SELECT dst, FALSE, value FROM v_call) GROUP BY 1), m AS (SELECT min(degree) AS a, max(degree) AS b, min(pagerank) AS c, max(pagerank) AS e, min(betweenness) AS f, max(betweenness) AS g FROM d)
SELECT node, round(0.4::DOUBLE * (pagerank - c) / (e - c) + 0.4::DOUBLE * (betweenness - f) / (g - f) + 0.2::DOUBLE * (degree - a) / (b - a), 6) AS score FROM d, m""", CALL)
def grf_baseline_ranking(spark, sf):
    """GRF-16: three scaled scores in one; calls made and money stand in for page rank and betweenness."""
    e = profiles.endpoints(calls(spark, sf), "value")
    d = e.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("degree"), F.count(F.when(F.col("outgoing"), 1)).cast("double").alias("pagerank"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("betweenness"))
    return network.baseline_ranking(d)


@query("""WITH d AS (SELECT node FROM (SELECT src AS node FROM v_loc UNION ALL SELECT dst FROM v_loc) GROUP BY node) SELECT least(src, dst) AS a, greatest(src, dst) AS b FROM v_loc""", ("v_loc",))
def grf_bridges(spark, sf):
    """GRF-22: in a tree, as places are, every edge is a bridge."""
    return network.bridges(places(spark, sf))


@query(f"""WITH {SMALL}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM s), ax AS (SELECT e.a || '~' || e.b AS k, x.u, x.v FROM e, a x WHERE NOT ((x.u = e.a AND x.v = e.b) OR (x.u = e.b AND x.v = e.a))), {_bfs('ax', 'x', 'k', 7)} SELECT e.a, e.b FROM e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = e.a || '~' || e.b AND x.s = e.a AND x.node = e.b)""")
def grf_bridges_dense(spark, sf):
    """GRF-22: bridges among cycles, against the removal of each edge."""
    return network.bridges(_small(spark, sf))


@query(f"""WITH {SMALL}, ax AS (SELECT n.node AS k, u, v FROM a, nodes n WHERE u <> n.node AND v <> n.node), {_bfs('ax', 'x', 'k', 7)}, c AS (SELECT k, s, min(node) AS comp FROM x GROUP BY 1, 2) SELECT k AS removed, count(DISTINCT comp) AS components, count(*) AS nodes_left FROM c GROUP BY 1""")
def grf_resilience(spark, sf):
    """GRF-20, GRF-22: components that the removal of each node leaves; more than one part marks an articulation point."""
    s = _small(spark, sf)
    return removal_fragmentation(s, s.select(F.explode(F.array("src", "dst")).alias("removed")).distinct())


LAYER = "CASE relation WHEN 'CALLED' THEN 'COMMUNICATION' WHEN 'TRANSFERRED_FUNDS' THEN 'FINANCIAL' WHEN 'LOCATED_AT' THEN 'LOCATION' WHEN 'MEMBER_OF' THEN 'ORGANIZATIONAL' ELSE 'SOCIAL' END"


@query(f"SELECT edge_id, {LAYER} AS layer FROM v_edge WHERE {LAYER} IN ('FINANCIAL', 'LOCATION')", EDGE)
def grf_layers(spark, sf):
    """GRF-25: two layers of the whole graph."""
    e = views.edges(spark, sf)
    return network.layer_view(e, "FINANCIAL").unionByName(network.layer_view(e, "LOCATION")).select("edge_id", "layer")


@query("""SELECT 'cumulative' AS mode, count(*) AS edges FROM v_edge WHERE date_trunc('second', ts) <= TIMESTAMP '2024-01-20' UNION ALL SELECT 'sliding', count(*) FROM v_edge WHERE date_trunc('second', ts) <= TIMESTAMP '2024-01-20' AND date_trunc('second', ts) > TIMESTAMP '2024-01-15'
UNION ALL SELECT 'exact', count(*) FROM v_edge WHERE date_trunc('second', ts) = (SELECT date_trunc('second', min(ts)) FROM v_edge)""", EDGE)
def grf_replay(spark, sf):
    """GRF-26: three modes; undated edges never show."""
    e = views.edges(spark, sf)
    first = e.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    n = lambda d, mode: d.agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("edges"))
    return n(network.replay(e, "2024-01-20 00:00:00"), "cumulative").unionByName(n(network.replay(e, "2024-01-20 00:00:00", "sliding", 5), "sliding")).unionByName(n(network.replay(e, first, "exact"), "exact"))


@query("""WITH x AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_edge WHERE ts <= TIMESTAMP '2024-01-10'), y AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_edge WHERE ts > TIMESTAMP '2024-01-20')
SELECT a, b, 'REMOVED' AS change FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.a = x.a AND y.b = x.b) UNION ALL SELECT a, b, 'ADDED' FROM y WHERE NOT EXISTS (SELECT 1 FROM x WHERE y.a = x.a AND y.b = x.b)""", EDGE)
def grf_snapshot_delta(spark, sf):
    """GRF-27, SET-02: pairs that come and go between two snapshots."""
    e = views.edges(spark, sf)
    return network.snapshot_delta(e.where("ts <= timestamp_ntz '2024-01-10'"), e.where("ts > timestamp_ntz '2024-01-20'"))


@query("""WITH b AS (SELECT unnest([1, 2, 3, 4]) AS bucket), t AS (SELECT bucket, TIMESTAMP '2024-01-01' + to_hours(CAST(bucket AS INTEGER)) AS bound FROM b), e AS (SELECT bucket, src AS u, dst AS v FROM v_call, t WHERE ts <= bound UNION ALL SELECT bucket, dst, src FROM v_call, t WHERE ts <= bound), r(bucket, s, n) AS (SELECT DISTINCT bucket, u, u FROM e UNION SELECT r.bucket, r.s, e.v FROM r JOIN e ON e.bucket = r.bucket AND e.u = r.n),
c AS (SELECT bucket, s, min(n) AS comp FROM r GROUP BY 1, 2), z AS (SELECT bucket, comp, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT bucket, count(*) AS communities, sum(n) AS nodes FROM z GROUP BY 1)
SELECT CAST(bucket AS BIGINT) AS bucket, communities, CAST(communities - coalesce(lag(communities) OVER (ORDER BY bucket), 0) AS BIGINT) AS change, CAST(nodes - coalesce(lag(nodes) OVER (ORDER BY bucket), 0) AS BIGINT) AS new_nodes FROM k""".replace("WITH b AS", "WITH RECURSIVE b AS"), CALL)
def grf_community_evolution(spark, sf):
    """GRF-23, GRF-28: parts of the graph hour by hour, all hours as one labelled graph."""
    hours = spark.range(1, 5).select(F.col("id").alias("bucket"), (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    return network.community_changes(network.bucketed_components(calls(spark, sf), hours))


@query("SELECT other, relation, direction, count(*) AS edges FROM (SELECT dst AS other, relation, 'OUT' AS direction FROM v_edge WHERE src = 'U:7' UNION ALL SELECT src, relation, 'IN' FROM v_edge WHERE dst = 'U:7') WHERE relation = 'CALLED' GROUP BY ALL", EDGE)
def grf_neighbours(spark, sf):
    """GRF-03: by direction and relation."""
    return network.neighbours(views.edges(spark, sf), "U:7", relation="CALLED")


@query("""WITH p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM v_call), n AS (SELECT b AS node FROM p WHERE a = 'U:7' UNION SELECT a FROM p WHERE b = 'U:7'), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_call UNION ALL SELECT dst FROM v_call) GROUP BY 1), k AS (SELECT 'U:7' AS node UNION ALL SELECT node FROM (SELECT node FROM n JOIN d USING (node) ORDER BY degree DESC, node LIMIT 14))
SELECT event_id, src, dst FROM v_call WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k)""", CALL)
def grf_ego(spark, sf):
    """GRF-04, TOP-03: a node and its fourteen most relevant neighbours; the cap is the feature."""
    c = calls(spark, sf)
    none = c.sparkSession.range(0).select(F.lit("").alias("node"), F.lit(0.0).alias("score"))
    return network.ego(c, "U:7", 1, 15, none).select("event_id", "src", "dst")


@query("SELECT node, count(DISTINCT community) AS communities FROM (SELECT e.node, m.community FROM (SELECT src AS node, dst AS other FROM v_call UNION ALL SELECT dst, src FROM v_call) e JOIN v_member m ON m.node = e.other UNION ALL SELECT node, community FROM v_member) GROUP BY node HAVING count(DISTINCT community) >= 5", ("v_call", "v_member"))
def grf_connectors(spark, sf):
    """GRF-34: nodes tied to all five communities."""
    return network.connectors(calls(spark, sf), views.members(spark, sf), 5)


@query("""WITH e AS (SELECT src AS node, dst AS other FROM v_call UNION ALL SELECT dst, src FROM v_call), x AS (SELECT e.node, count(*) AS external_edges FROM e JOIN v_member a ON a.node = e.node LEFT JOIN v_member b ON b.node = e.other WHERE b.community IS DISTINCT FROM a.community GROUP BY 1), d AS (SELECT src AS node, count(DISTINCT dst)::DOUBLE AS betweenness FROM v_call GROUP BY 1)
SELECT node, betweenness, external_edges FROM d JOIN x USING (node) ORDER BY betweenness DESC, node LIMIT 10""", ("v_call", "v_member"))
def grf_brokers(spark, sf):
    """GRF-30: the ten are the feature; distinct callees stand in for betweenness."""
    c = calls(spark, sf)
    b = c.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").cast("double").alias("betweenness"))
    return network.brokers(c, views.members(spark, sf), b, 10)


@query("""WITH p AS (SELECT DISTINCT src, dst FROM v_loc WHERE src <> dst) SELECT x.src || '>' || x.dst || '>' || y.dst AS path, 3::BIGINT AS nodes FROM p x JOIN p y ON y.src = x.dst WHERE y.dst <> x.src""", ("v_loc",))
def grf_chains(spark, sf):
    """GRF-31: chains of three to six nodes; places are three deep."""
    return paths.chains(places(spark, sf), 3, 6)


@query("""WITH p AS (SELECT DISTINCT src, dst FROM v_loc WHERE src <> dst), z AS (SELECT DISTINCT src FROM p WHERE src NOT IN (SELECT dst FROM p)) SELECT x.src || '>' || x.dst || '>' || y.dst AS path, 3::BIGINT AS nodes, 0.6::DOUBLE AS confidence FROM p x JOIN z ON z.src = x.src JOIN p y ON y.src = x.dst""", ("v_loc",))
def grf_layering_paths(spark, sf):
    """GRF-36: chains from nodes that nothing points at."""
    return paths.layering(places(spark, sf))


FLOW = "f AS (SELECT src, dst, sum(CAST(value AS DECIMAL(18,4))) AS amount FROM v_call WHERE relation = 'purchase' AND src <> dst GROUP BY 1, 2)"


def _flows(spark, sf):
    c = calls(spark, sf).where("relation = 'purchase' AND src <> dst")
    return c.groupBy("src", "dst").agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("amount"))


@query(f"""WITH {FLOW}, c AS (SELECT a.src || '>' || a.dst AS cycle, 2 AS nodes, a.amount + b.amount AS total FROM f a JOIN f b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || '>' || b.src || '>' || c.src, 3, a.amount + b.amount + c.amount FROM f a JOIN f b ON b.src = a.dst JOIN f c ON c.src = b.dst AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src
UNION ALL SELECT a.src || '>' || b.src || '>' || c.src || '>' || d.src, 4, a.amount + b.amount + c.amount + d.amount FROM f a JOIN f b ON b.src = a.dst JOIN f c ON c.src = b.dst JOIN f d ON d.src = c.dst AND d.dst = a.src WHERE a.src < b.src AND a.src < c.src AND a.src < d.src AND b.src <> d.src)
SELECT cycle, CAST(nodes AS BIGINT) AS nodes, CAST(round(total, 2) AS DOUBLE) AS total, round(nodes / 5.0::DOUBLE, 6) AS confidence FROM c""", CALL)
def grf_circular_flows(spark, sf):
    """GRF-37, GRF-33: all cycles of two to four purchases with the money along them."""
    return paths.circular_flows(_flows(spark, sf), 2, 4)


@query("""WITH f AS (SELECT src, dst, CAST(arg_min(value, (ts, event_id)) AS DECIMAL(18,4)) AS amount FROM v_call WHERE relation = 'purchase' AND src <> dst GROUP BY 1, 2), m AS (SELECT greatest(median(CAST(value AS DECIMAL(18,4))::DOUBLE), 1) AS median FROM v_call WHERE relation = 'purchase'),
c AS (SELECT a.src || '>' || a.dst AS cycle, a.amount + b.amount AS total FROM f a JOIN f b ON b.src = a.dst AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT a.src || '>' || b.src || '>' || c.src, a.amount + b.amount + c.amount FROM f a JOIN f b ON b.src = a.dst JOIN f c ON c.src = b.dst AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src),
r AS (SELECT cycle, CAST(round(total, 2) AS DOUBLE) AS total, round(total::DOUBLE / median, 6) AS ratio FROM c, m) SELECT cycle, total, ratio, CASE WHEN ratio > 50 THEN 'HIGH' WHEN ratio > 10 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(least(1, ratio / 100), 6) AS confidence FROM r WHERE ratio > 6""", CALL)
def grf_round_trips(spark, sf):
    """GRF-40: cycles of up to three whose first amounts are far above the median; a factor that the data reach."""
    c = calls(spark, sf).where("relation = 'purchase'").select("src", "dst", "ts", F.col("event_id").alias("edge_id"), F.col("value").cast("decimal(18,4)").alias("amount"))
    return paths.round_trips(c, 3, 6.0)


@query(f"""WITH {FLOW}, s AS (SELECT * FROM f WHERE amount >= 20), p AS (SELECT src || '>' || dst AS path, 1 AS hops, amount AS total, amount AS low, dst AS e FROM s WHERE src = 'U:7'), q AS (SELECT path || '>' || dst AS path, 2 AS hops, total + amount AS total, least(low, amount) AS low, dst AS e FROM p JOIN s ON s.src = p.e), r AS (SELECT path || '>' || dst AS path, 3 AS hops, total + amount AS total, least(low, amount) AS low, dst AS e FROM q JOIN s ON s.src = q.e)
SELECT path, CAST(hops AS BIGINT) AS hops, CAST(round(total, 2) AS DOUBLE) AS total, CAST(round(low, 2) AS DOUBLE) AS smallest_hop FROM (FROM p UNION ALL FROM q UNION ALL FROM r) ORDER BY total DESC, path LIMIT 200""", CALL)
def grf_fund_paths(spark, sf):
    """GRF-38: the 200 richest ways of up to three hops from an account, each hop at least 20; accounts may recur."""
    return paths.fund_paths(_flows(spark, sf), "U:7", 3, 20)


@query(f"""WITH {FLOW}, s AS (SELECT * FROM f WHERE amount >= 20), l1 AS (SELECT dst AS account, max(amount) AS m FROM s WHERE src = 'U:7' GROUP BY 1), l2 AS (SELECT dst AS account, max(amount) AS m FROM s JOIN l1 ON src = account WHERE dst <> 'U:7' AND dst NOT IN (SELECT account FROM l1) GROUP BY 1), r AS (SELECT account, 1 AS level, m FROM l1 WHERE account <> 'U:7' UNION ALL SELECT account, 2, m FROM l2),
i AS (SELECT dst AS account, sum(amount) AS i, count(*) AS n FROM s GROUP BY 1), o AS (SELECT src AS account, sum(amount) AS o, count(*) AS n FROM s GROUP BY 1)
SELECT account, CAST(level AS BIGINT) AS level, CAST(round(m, 2) AS DOUBLE) AS largest_hop, concat_ws(',', CASE WHEN coalesce(o::DOUBLE / i::DOUBLE, 0) BETWEEN 0.9 AND 1.1 THEN 'RAPID_PASS_THROUGH' END, CASE WHEN i.n >= 3 THEN 'FAN_IN' END, CASE WHEN o.n >= 3 THEN 'FAN_OUT' END) AS flags FROM r LEFT JOIN i USING (account) LEFT JOIN o USING (account)""", CALL)
def grf_fund_trace(spark, sf):
    """GRF-39: what money reaches in two hops, with its flags."""
    return paths.trace(_flows(spark, sf), "U:7", 2, 20)


@query("""WITH p AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), x AS (SELECT 'U:1>U:2' AS path, 1 AS hops FROM p WHERE u = 'U:1' AND v = 'U:2' UNION ALL SELECT 'U:1>' || a.v || '>U:2', 2 FROM p a JOIN p b ON b.u = a.v AND b.v = 'U:2' WHERE a.u = 'U:1' AND a.v <> 'U:2') SELECT path, CAST(hops AS BIGINT) AS hops FROM x ORDER BY hops, path LIMIT 12""", ("v_call", "pairs"))
def grf_shortest_paths(spark, sf):
    """GRF-05: the twelve shortest ways of up to two hops between two users; the twelve are the feature."""
    return paths.shortest(calls(spark, sf), "U:1", "U:2", 12, 2)


@query("""WITH p AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs), x AS (SELECT a.v AS z FROM p a JOIN p b ON b.u = a.v AND b.v = 'U:2' WHERE a.u = 'U:1' AND a.v <> 'U:2' ORDER BY 'U:1>' || a.v || '>U:2' LIMIT 5), h AS (SELECT 'U:1>' || z || '>U:2' AS path, 1 AS hop, 'U:1' AS a, z AS b FROM x UNION ALL SELECT 'U:1>' || z || '>U:2', 2, z, 'U:2' FROM x)
SELECT path, CAST(hop AS BIGINT) AS hop, arg_min(edge_id, (-coalesce(confidence, 0), edge_id)) AS edge_id FROM h JOIN v_edge e ON least(e.src, e.dst) = least(a, b) AND greatest(e.src, e.dst) = greatest(a, b) GROUP BY 1, 2""", ("v_call", "v_loc", "v_edge", "pairs"))
def grf_path_edges(spark, sf):
    """GRF-05, JN-22: the surest edge of each hop of five ways; the five are the feature."""
    found = paths.shortest(calls(spark, sf), "U:1", "U:2", 1000, 2).where("hops = 2").orderBy("path").limit(5)
    return paths.hop_edges(found, views.edges(spark, sf))


@query("""WITH p AS (SELECT DISTINCT src, dst FROM v_call WHERE src <> dst), one AS (SELECT 'U:3>U:4' AS path, 1 AS hops FROM p WHERE src = 'U:3' AND dst = 'U:4'), two AS (SELECT 'U:3>' || a.dst || '>U:4' AS path, 2 AS hops FROM p a JOIN p b ON b.src = a.dst AND b.dst = 'U:4' WHERE a.src = 'U:3' AND a.dst <> 'U:4'), x AS (FROM one UNION ALL FROM two)
SELECT path, CAST(hops AS BIGINT) AS hops FROM x WHERE hops = (SELECT min(hops) FROM x) ORDER BY path LIMIT 5""", CALL)
def grf_all_shortest(spark, sf):
    """GRF-06: the first five directed shortest ways; the five are the feature."""
    return paths.all_shortest(calls(spark, sf), "U:3", "U:4", 2)


@query("""WITH e AS (SELECT src, dst, count(*)::DOUBLE AS w FROM v_call GROUP BY 1, 2), o AS (SELECT src, sum(w) AS t FROM e GROUP BY 1), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r0 AS (SELECT node, CASE WHEN node = 'U:7' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM n),
r1 AS (SELECT n.node, 0.85::DOUBLE * (coalesce((SELECT sum(x.r * e.w / o.t) FROM e JOIN o ON o.src = e.src JOIN r0 x ON x.node = e.src WHERE e.dst = n.node), 0) + CASE WHEN n.node = 'U:7' THEN coalesce((SELECT sum(r) FROM r0 WHERE node NOT IN (SELECT src FROM o)), 0) ELSE 0 END) + 0.15::DOUBLE * (n.node = 'U:7')::INT AS r FROM n),
r2 AS (SELECT n.node, 0.85::DOUBLE * (coalesce((SELECT sum(x.r * e.w / o.t) FROM e JOIN o ON o.src = e.src JOIN r1 x ON x.node = e.src WHERE e.dst = n.node), 0) + CASE WHEN n.node = 'U:7' THEN coalesce((SELECT sum(r) FROM r1 WHERE node NOT IN (SELECT src FROM o)), 0) ELSE 0 END) + 0.15::DOUBLE * (n.node = 'U:7')::INT AS r FROM n) SELECT node, round(r, 9) AS rank FROM r2""", CALL)
def grf_personal_pagerank(spark, sf):
    """GRF-08: two rounds of walks that restart at one user."""
    return pagerank(calls(spark, sf), 2, restart="U:7").select("node", F.round("rank", 9).alias("rank"))


@query("""WITH d AS (SELECT u, count(*) AS d FROM adj GROUP BY 1), s AS (SELECT x.v AS x, y.v AS y, count(*) AS common, sum(1.0::DOUBLE / d.d) AS ra FROM adj x JOIN adj y ON x.u = y.u AND x.v < y.v JOIN d ON d.u = x.u GROUP BY 1, 2) SELECT x, y, common, round(ra, 6) AS resource_allocation FROM s WHERE common >= 3 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = s.x AND p.b = s.y)""", ("v_call", "pairs", "adj"))
def grf_gaps(spark, sf):
    """GRF-43: pairs with three shared neighbours and no edge."""
    return relationship_gaps(calls(spark, sf), 3).select("x", "y", "common", "resource_allocation")


@query("""WITH t AS (SELECT 'HUB' AS motif_type, node AS subject, n AS size FROM (SELECT node, count(*) AS n FROM (SELECT src AS node FROM v_loc UNION ALL SELECT dst FROM v_loc) GROUP BY 1) WHERE n >= 5 AND n >= (SELECT avg(n) + 2 * stddev_samp(n) FROM (SELECT count(*) AS n FROM (SELECT src AS node FROM v_loc UNION ALL SELECT dst FROM v_loc) GROUP BY node))
UNION ALL SELECT 'FAN_IN', dst, count(*) FROM v_loc GROUP BY dst HAVING count(*) >= 3) SELECT motif_type, subject, size, 'MOTIF-' || motif_type || '-' || row_number() OVER (PARTITION BY motif_type ORDER BY size DESC, subject) AS motif_id FROM t""", ("v_loc",))
def grf_motif_report(spark, sf):
    """GRF-35, SET-01: motifs of the places, numbered; a tree has no rings, and one community no connectors."""
    p = places(spark, sf)
    m = p.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("community", F.lit("0"))
    return network.motif_report(p, m)


@query(f"""WITH {SMALL}, {MEMBERS}, e AS (SELECT x.community AS cu, y.community AS cv FROM a JOIN mem x ON x.node = u JOIN mem y ON y.node = v), p AS (SELECT cu, sum((cu = cv)::INT) AS i, count(*) AS k, sum(count(*)) OVER () AS m FROM e GROUP BY cu) SELECT round(sum(i / m - power(k / m, 2)), 6) AS modularity FROM p""")
def grf_partition_modularity(spark, sf):
    """GRF-13: of the small graph's regions."""
    return modularity(_small(spark, sf), _small_members(spark, sf))


@query("SELECT src, dst, CAST(round(sum(amount), 2) AS DOUBLE) AS total, count(*) AS n FROM v_tx GROUP BY src, dst HAVING sum(amount) >= 150000", ("v_tx",))
def grf_multiplex(spark, sf):
    """GRF-25: the weight of money between accounts, as a layer of its own."""
    t = transfers(spark, sf).groupBy("src", "dst").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n")).where("s >= 150000")
    return t.select("src", "dst", F.round("s", 2).cast("double").alias("total"), "n")
