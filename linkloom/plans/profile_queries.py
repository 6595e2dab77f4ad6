"""Queries on profiles of nodes, pairs, communities, cases and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import profiles, search
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table

EDGE = ("v_call", "v_loc", "v_edge")
LAYER = "CASE relation WHEN 'CALLED' THEN 'COMMUNICATION' WHEN 'TRANSFERRED_FUNDS' THEN 'FINANCIAL' WHEN 'LOCATED_AT' THEN 'LOCATION' WHEN 'MEMBER_OF' THEN 'ORGANIZATIONAL' ELSE 'SOCIAL' END"
ENDS = "ends AS (SELECT src AS node, dst AS other, TRUE AS o, * FROM v_edge UNION ALL SELECT dst, src, FALSE, * FROM v_edge)"


@query(f"SELECT relation, {LAYER} AS layer, CASE relation WHEN 'TRANSFERRED_FUNDS' THEN 'TRANSFERRED_TO' WHEN 'LOCATED_AT' THEN 'LOCATED_IN' ELSE relation END AS name, count(*) AS n FROM v_edge GROUP BY ALL", EDGE)
def flt_relation_layers(spark, sf):
    """FLT-14, FLT-15: layers and canonical names of the relations."""
    e = views.edges(spark, sf)
    return e.groupBy("relation", profiles.layer().alias("layer"), profiles.relation_name().alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT community AS gang, count(*) AS members FROM v_member GROUP BY 1),
e AS (SELECT DISTINCT m.community AS gang, e.edge_id, e.relation, e.value FROM v_edge e JOIN v_member m ON m.node = e.src OR m.node = e.dst),
c AS (SELECT gang, count(CASE WHEN relation = 'CALLED' THEN 1 END) AS calls, count(CASE WHEN relation = 'TRANSFERRED_FUNDS' THEN 1 END) AS txns, CAST(round(sum(CASE WHEN relation = 'TRANSFERRED_FUNDS' THEN CAST(value AS DECIMAL(18,4)) END), 2) AS DOUBLE) AS amount FROM e GROUP BY gang),
t AS (SELECT community AS gang, count(DISTINCT meeting_id) AS meetings FROM (SELECT meeting_id, unnest(attendees) AS node FROM v_meet) JOIN v_member USING (node) GROUP BY 1)
SELECT gang, members, calls, txns, coalesce(meetings, 0) AS meetings, amount, round(0.02 * calls + 0.05 * txns + amount / 100000, 4)::DOUBLE AS risk, CASE WHEN round(0.02 * calls + 0.05 * txns + amount / 100000, 4) > 400 THEN 'CRITICAL' WHEN round(0.02 * calls + 0.05 * txns + amount / 100000, 4) > 200 THEN 'HIGH' WHEN round(0.02 * calls + 0.05 * txns + amount / 100000, 4) > 80 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM g JOIN c USING (gang) LEFT JOIN t USING (gang)""", (*EDGE, "v_member", "v_meet"))
def agg_gang_report(spark, sf):
    """AGG-02, JN-03: calls, transfers, meetings and money that touch a gang, with the risk ladder."""
    return profiles.gang_report(views.members(spark, sf), views.edges(spark, sf), views.meetings(spark, sf))


@query("""SELECT src, dst, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS total_amount, count(*) AS transaction_count, array_to_string(list_slice(list_sort(list(edge_id)), 1, 10), ',') AS evidence FROM v_edge
WHERE relation = 'TRANSFERRED_FUNDS' AND (ts IS NULL OR ts >= TIMESTAMP '2024-01-05') GROUP BY src, dst HAVING sum(CAST(value AS DECIMAL(18,4))) >= 100 ORDER BY total_amount DESC, src, dst LIMIT 200""", EDGE)
def agg_flow_evidence(spark, sf):
    """AGG-05, TOP-04: the 200 largest flows of a date range with up to ten pieces of evidence; both limits are the feature."""
    e = views.edges(spark, sf).where("relation = 'TRANSFERRED_FUNDS'")
    return profiles.flows_with_evidence(e, least=100, start="2024-01-05 00:00:00", top=200)


@query("""WITH n AS (SELECT account, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS volume FROM (SELECT src AS account, amount FROM v_tx UNION ALL SELECT dst, amount FROM v_tx) GROUP BY account), m AS (SELECT greatest(1.2 * median(n), 10.0) AS cut FROM n),
c AS (SELECT 'C:' || c_custkey AS account, (1.0 + (c_custkey % 2) + (c_nationkey % 2)) / 3 AS completeness FROM customer)
SELECT account, n, volume, CAST(round(coalesce(completeness, 0), 6) AS DOUBLE) AS completeness, CAST(round(1 - coalesce(completeness, 0), 6) AS DOUBLE) AS confidence FROM n LEFT JOIN c USING (account), m WHERE n > cut AND coalesce(completeness, 0) < 0.5""", ("v_tx",))
def agg_shell_accounts(spark, sf):
    """AGG-08: busy accounts with little known of their holder; a factor that the data reach."""
    from linkloom.operators import flows
    from linkloom.sources.tables import transfers

    c = table(spark, sf, "customer")
    known = c.select(F.concat(F.lit("C:"), "c_custkey").alias("account"), F.lit(True).alias("has_name"), (F.col("c_custkey") % 2 == 1).alias("has_phone"), (F.col("c_nationkey") % 2 == 1).alias("has_location"))
    return flows.shell_accounts(transfers(spark, sf), known, factor=1.2)


@query(f"""SELECT a, b, n, first_ts, last_ts, CASE WHEN last_ts > first_ts THEN round(days / greatest((epoch(date_trunc('second', last_ts)) - epoch(date_trunc('second', first_ts))) / 86400, 1), 4) ELSE 0.0 END AS persistence,
coalesce(round(greatest((epoch(TIMESTAMP '2024-12-31 23:59:59') - epoch(date_trunc('second', last_ts))) / 86400, 0), 2), 0.0) AS recency_days, layers FROM
(SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT CAST(ts AS DATE)) AS days, array_to_string(list_sort(list(DISTINCT {LAYER})), ',') AS layers FROM v_edge GROUP BY 1, 2)""", EDGE)
def agg_pair_temporal(spark, sf):
    """AGG-14: how lasting and how recent each tie is."""
    return profiles.pair_features(views.edges(spark, sf), "2024-12-31 23:59:59")


@query("""SELECT edges, dated, first_ts, last_ts, active_nodes, round(dated / CAST(edges AS DOUBLE), 4) AS coverage, round(dated / greatest((epoch(date_trunc('second', last_ts)) - epoch(date_trunc('second', first_ts))) / 86400, 1), 4) AS per_day
FROM (SELECT count(*) AS edges, count(ts) AS dated, min(ts) AS first_ts, max(ts) AS last_ts FROM v_edge), (SELECT count(DISTINCT n) AS active_nodes FROM (SELECT src AS n FROM v_edge WHERE ts IS NOT NULL UNION ALL SELECT dst FROM v_edge WHERE ts IS NOT NULL))""", EDGE)
def agg_timeline_statistics(spark, sf):
    """AGG-15, AGG-16: range, coverage, active nodes and new edges a day."""
    return profiles.timeline_statistics(views.edges(spark, sf))


@query(f"SELECT {LAYER} AS layer, count(*) AS n FROM v_edge GROUP BY 1", EDGE)
def agg_layer_counts(spark, sf):
    """AGG-15: edges by layer."""
    return profiles.layer_counts(views.edges(spark, sf))


COMMUNITY = f"""{ENDS}, x AS (SELECT e.node, m.community, coalesce(o.community = m.community, FALSE) AS inside FROM ends e JOIN v_member m ON m.node = e.node LEFT JOIN v_member o ON o.node = e.other),
d AS (SELECT community, node, count(*) AS degree, count(CASE WHEN inside THEN 1 END) AS ins FROM x GROUP BY 1, 2), a AS (SELECT m.community, m.node, coalesce(degree, 0) AS degree, coalesce(ins, 0) AS ins FROM v_member m LEFT JOIN d USING (community, node))"""


@query(f"""WITH {COMMUNITY}, s AS (SELECT community, count(*) AS size, CAST(sum(ins) / 2 AS BIGINT) AS internal_edges, CAST(sum(degree - ins) AS BIGINT) AS external_edges FROM a GROUP BY 1),
k AS (SELECT community, string_agg(node, ',' ORDER BY degree DESC, node) AS key_entities FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) <= 12) GROUP BY 1),
b AS (SELECT community, string_agg(node, ',' ORDER BY degree DESC, node) AS bridge_entities FROM (SELECT * FROM a WHERE degree > ins QUALIFY row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) <= 12) GROUP BY 1)
SELECT community, size, internal_edges, external_edges, round(internal_edges / (size * (size - 1) / 2.0), 4)::DOUBLE AS density, key_entities, coalesce(bridge_entities, '') AS bridge_entities FROM s JOIN k USING (community) LEFT JOIN b USING (community)""", (*EDGE, "v_member"))
def agg_community_details(spark, sf):
    """AGG-17: with the twelve busiest members and bridges; the twelve are the feature."""
    return profiles.community_details(views.edges(spark, sf), views.members(spark, sf))


@query(f"""WITH {COMMUNITY}, n AS (SELECT CAST(sum(degree) AS DOUBLE) AS total FROM a)
SELECT community, node, CASE WHEN degree - ins >= 2 AND degree / total > 0.007 THEN 'BROKER' WHEN degree - ins >= 1 THEN 'BRIDGE' WHEN degree >= 3 THEN 'CORE' WHEN degree >= 1 THEN 'PERIPHERAL' ELSE 'ISOLATE' END AS role, degree, degree - ins AS external_edges FROM a, n""", (*EDGE, "v_member"))
def agg_community_roles(spark, sf):
    """AGG-18: roles of members; the share of all ends stands in for betweenness."""
    e, m = views.edges(spark, sf), views.members(spark, sf)
    ends = profiles.endpoints(e).join(m, "node")
    total = ends.agg(F.count(F.lit(1)).alias("total"))
    share = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("node", (F.col("n") / F.col("total")).alias("betweenness"))  # one row
    return profiles.community_roles(e, m, share, broker=0.007)


@query("SELECT entity_type, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM v_node GROUP BY 1", ("v_node",))
def agg_type_shares(spark, sf):
    """AGG-19."""
    return profiles.type_shares(views.nodes(spark, sf))


@query("SELECT round(coalesce(stddev_samp(n), 0) / greatest(avg(n), 1), 4) AS burst_index, count(*) AS months FROM (SELECT strftime(ts, '%Y-%m') AS m, count(*) AS n FROM v_tx GROUP BY 1)", ("v_tx",))
def agg_monthly_variation(spark, sf):
    """AGG-20."""
    from linkloom.sources.tables import transfers

    return profiles.monthly_variation(transfers(spark, sf))


@query("""WITH f AS (SELECT node, count(DISTINCT evidence_id) AS evidence FROM (SELECT evidence_id, source_type, unnest(nodes) AS node FROM v_evidence) WHERE source_type = 'CONVERSATION' GROUP BY node),
u AS (SELECT v_node.id, label, entity_type, coalesce(evidence, 0) AS evidence FROM v_node LEFT JOIN f ON f.node = v_node.id),
d AS (SELECT 'COMPLETENESS' AS dimension, round(sum((label IS NOT NULL AND label <> '')::INT + (entity_type IS NOT NULL)::INT) / (2.0 * count(*)), 4)::DOUBLE AS score FROM u
UNION ALL SELECT 'ENTITY_RESOLUTION', round(least(1.0, 0.7 + 0.3 * avg((entity_type = 'LOCATION')::INT)), 4) FROM u
UNION ALL SELECT 'CONSISTENCY', round(1 - avg((k > 1)::INT), 4) FROM (SELECT id, count(DISTINCT label) AS k FROM u GROUP BY id)
UNION ALL SELECT 'DUPLICATE_RISK', round(1 - avg((n > 1)::INT), 4) FROM (SELECT lower(trim(label)) AS k, count(*) AS n FROM u GROUP BY 1)
UNION ALL SELECT 'TEMPORAL', round(avg((ts IS NOT NULL)::INT), 4) FROM v_edge UNION ALL SELECT 'EXTRACTION_CONFIDENCE', round(avg(confidence), 4) FROM v_edge
UNION ALL SELECT 'EVIDENCE_COVERAGE', round(avg((evidence > 0)::INT), 4) FROM u WHERE id LIKE 'U:%') SELECT * FROM d UNION ALL SELECT 'OVERALL', round(avg(score), 4) FROM d""", (*EDGE, "v_node", "v_evidence"))
def agg_quality_report(spark, sf):
    """AGG-21: the seven dimensions and their mean; users stand for findings, places have an alias."""
    n = views.nodes(spark, sf).withColumn("aliases", F.when(F.col("entity_type") == "LOCATION", F.array("id")).otherwise(F.array().cast("array<string>")))
    linked = search.evidence_nodes(views.evidence(spark, sf).where("source_type = 'CONVERSATION'"), n).groupBy(F.col("node").alias("id")).agg(F.countDistinct("evidence_id").alias("k"))
    found = n.where("id LIKE 'U:%'").join(linked, "id", "left").select(F.coalesce("k", F.lit(0)).alias("evidence"))
    return profiles.quality_dimensions(n, views.edges(spark, sf), found)


@query(f"""WITH {ENDS}, m AS (SELECT node AS id, count(*) AS mentions FROM ends GROUP BY 1), o AS (SELECT src AS id, count(*) AS edges, count(ts) AS dated, avg(confidence) AS sure FROM v_edge GROUP BY 1),
s AS (SELECT node AS id, count(DISTINCT evidence_id) AS records FROM (SELECT evidence_id, unnest(nodes) AS node FROM v_evidence) GROUP BY 1)
SELECT id, round(least(1.0, 0.5 + greatest(coalesce(mentions, 1), 1) / 20.0), 4)::DOUBLE AS identity_confidence, round(least(1.0, coalesce(records, 0) / 5.0), 4)::DOUBLE AS evidence_coverage, round(coalesce(dated, 0) / greatest(coalesce(edges, 0), 1), 4)::DOUBLE AS temporal_coverage, round(CAST(coalesce(sure, 0.5) AS DECIMAL(24,10)), 4)::DOUBLE AS relationship_confidence
FROM v_node LEFT JOIN m USING (id) LEFT JOIN o USING (id) LEFT JOIN s USING (id)""", (*EDGE, "v_node", "v_evidence"))
def agg_entity_quality(spark, sf):
    """AGG-22."""
    linked = views.evidence(spark, sf).select("evidence_id", F.explode("nodes").alias("node"))
    return profiles.entity_quality(views.nodes(spark, sf), views.edges(spark, sf), linked)


@query(f"""WITH {ENDS}, i AS (SELECT epoch(date_trunc('second', ts)) AS t FROM events WHERE event_type = 'error' AND event_id % 500 = 0),
v AS (SELECT node, count(DISTINCT edge_id) AS incident_overlaps FROM ends WHERE ts IS NOT NULL AND EXISTS (SELECT 1 FROM i WHERE abs(epoch(date_trunc('second', ends.ts)) - i.t) <= 86400) GROUP BY node)
SELECT node, count(CASE WHEN relation = 'CALLED' THEN 1 END) AS calls, count(DISTINCT CASE WHEN relation IN ('CALLED', 'MET') THEN other END) AS contacts, CAST(round(CAST(coalesce(avg(CASE WHEN relation = 'CALLED' THEN value END), 0) AS DECIMAL(24,10)), 4) AS DOUBLE) AS mean_duration, count(CASE WHEN relation = 'MET' THEN 1 END) AS met,
CAST(round(coalesce(sum(CASE WHEN relation = 'TRANSFERRED_FUNDS' AND NOT o THEN CAST(value AS DECIMAL(18,4)) END), 0), 2) AS DOUBLE) AS incoming, CAST(round(coalesce(sum(CASE WHEN relation = 'TRANSFERRED_FUNDS' AND o THEN CAST(value AS DECIMAL(18,4)) END), 0), 2) AS DOUBLE) AS sent, count(CASE WHEN relation = 'TRANSFERRED_FUNDS' THEN 1 END) AS transfers,
count(DISTINCT CASE WHEN relation = 'LOCATED_AT' AND o THEN other END) AS places, count(*) AS degree, coalesce(any_value(incident_overlaps), 0) AS incident_overlaps FROM ends LEFT JOIN v USING (node) GROUP BY node""", EDGE)
def agg_behaviour(spark, sf):
    """AGG-23, JN-08: what each node does, and its edges within a day of an incident."""
    incidents = table(spark, sf, "events").where("event_type = 'error' AND event_id % 500 = 0")  # every such error is an incident
    return profiles.behaviour(views.edges(spark, sf), incidents)


@query("""WITH s AS (SELECT src AS subject, CASE relation WHEN 'CALLED' THEN 'temporal' WHEN 'MET' THEN 'behavioral' WHEN 'TRANSFERRED_FUNDS' THEN 'evidence' ELSE 'structural' END AS family, round(greatest(0, least(1, coalesce(confidence, 0.25) * 1.2)), 4) AS v, round(least(value, 50) / 10, 4) AS w FROM v_edge WHERE value IS NOT NULL),
f AS (SELECT subject, family, sum(v * w) AS vw, sum(w) AS w FROM s GROUP BY 1, 2 HAVING sum(w) > 0) SELECT subject, count(*) AS families, round(greatest(0, least(1, sum(vw) / sum(w) - 0.05)), 4) AS confidence FROM f GROUP BY 1""", EDGE)
def agg_signal_confidence(spark, sf):
    """AGG-26: signals by family, then over families, less a penalty."""
    e = views.edges(spark, sf).where("value IS NOT NULL")
    family = F.when(F.col("relation") == "CALLED", "temporal").when(F.col("relation") == "MET", "behavioral").when(F.col("relation") == "TRANSFERRED_FUNDS", "evidence").otherwise("structural")
    s = e.select(F.col("src").alias("subject"), family.alias("family"), (F.coalesce("confidence", F.lit(0.25)) * 1.2).alias("value"), (F.least("value", F.lit(50.0)) / 10).alias("weight"))
    return profiles.signal_confidence(s, s.select("subject", F.lit(0.05).alias("penalty")).distinct())


@query(f"""WITH {ENDS}, n AS (SELECT CAST(count(DISTINCT node) AS DOUBLE) AS n FROM ends), d AS (SELECT node, count(*) AS d, count(CASE WHEN NOT o THEN 1 END) AS din, max(CASE WHEN relation = 'CALLED' THEN confidence END) AS communication, max(CASE WHEN relation = 'TRANSFERRED_FUNDS' THEN confidence END) AS financial, count(DISTINCT CASE WHEN relation = 'MEMBER_OF' THEN other END) AS cases FROM ends GROUP BY node),
s AS (SELECT node, count(DISTINCT evidence_id) AS records FROM (SELECT evidence_id, unnest(nodes) AS node FROM v_evidence) GROUP BY 1),
c AS (SELECT node, round_even(least(1.0, 0.6 * din / CAST(max(din) OVER () AS DOUBLE) + 0.4 * d / (n - 1) / 10), 4) AS a, round_even(least(1.0, 0.65 * (d / n / 10)), 4) AS b, round_even(least(1.0, communication), 4) AS c, round_even(least(1.0, financial), 4) AS f, CASE WHEN cases > 0 THEN 1.0::DOUBLE END AS x, CASE WHEN coalesce(records, 0) = 0 THEN 0.5::DOUBLE ELSE round_even(least(1.0, 0.5 + records / 60.0::DOUBLE), 4) END AS e FROM d LEFT JOIN s USING (node), n),
w AS (SELECT node, 0.25::DOUBLE + 0.2 + 0.1 + CASE WHEN c IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN f IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN x IS NULL THEN 0 ELSE 0.05::DOUBLE END AS total, a * 0.25::DOUBLE + b * 0.2::DOUBLE + coalesce(c, 0) * 0.15::DOUBLE + coalesce(f, 0) * 0.15::DOUBLE + coalesce(x, 0) * 0.05::DOUBLE + e * 0.1::DOUBLE AS value FROM c)
, z AS (SELECT node, CAST(100 * value / total AS DECIMAL(24,10)) AS x FROM w), y AS (SELECT node, CAST(CASE WHEN x * 100 - floor(x * 100) = 0.5 AND CAST(floor(x * 100) AS BIGINT) % 2 = 0 THEN floor(x * 100) / 100 ELSE round(x, 2) END AS DOUBLE) AS priority FROM z)
SELECT node, priority, CASE WHEN priority >= 75 THEN 'CRITICAL' WHEN priority >= 50 THEN 'HIGH' WHEN priority >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM y""", (*EDGE, "v_evidence"))
def agg_priority_seven(spark, sf):
    """AGG-27: the seven components over those that are there; in-degree and degree stand in for page rank and betweenness."""
    e = profiles.endpoints(views.edges(spark, sf), "relation", "confidence")
    only = lambda r, c: F.max(F.when(F.col("relation") == r, F.col(c)))
    d = e.groupBy("node").agg(F.count(F.lit(1)).alias("d"), F.count(F.when(~F.col("outgoing"), 1)).cast("double").alias("pagerank"), only("CALLED", "confidence").alias("communication"), only("TRANSFERRED_FUNDS", "confidence").alias("financial"), F.countDistinct(F.when(F.col("relation") == "MEMBER_OF", F.col("other"))).alias("cases"))
    n = d.agg(F.count(F.lit(1)).alias("n"), F.max("pagerank").alias("top"))
    seen = views.evidence(spark, sf).select("evidence_id", F.explode("nodes").alias("node")).groupBy("node").agg(F.countDistinct("evidence_id").alias("records"))
    m = d.join(F.broadcast(n)).join(seen, "node", "left")  # one row
    m = m.withColumns({"degree_centrality": F.col("d") / (F.col("n") - 1) / 10, "betweenness": F.col("d") / F.col("n") / 10, "ghost": F.lit(0.0), "proximity": F.lit(0.0)})
    return profiles.priority_score(profiles.priority_components(m))


CASE = "'K' || (CAST(substr(src, 3) AS BIGINT) % 8)"
PRINT = f"""x AS (SELECT *, {CASE} AS c FROM v_edge WHERE src LIKE 'U:%'), pe AS (SELECT c, src AS node, TRUE AS o FROM x UNION ALL SELECT c, dst, FALSE FROM x), g AS (SELECT c, node, count(*) AS d, count(CASE WHEN o THEN 1 END) AS od FROM pe GROUP BY 1, 2),
p AS (SELECT c, count(*) AS entities, avg(d) AS mean, coalesce(stddev_samp(d), 0) AS sd, max(d) AS top, count(CASE WHEN d - od >= 3 THEN 1 END) AS fan_in, count(CASE WHEN od >= 3 THEN 1 END) AS fan_out FROM g GROUP BY 1), h AS (SELECT c, count(*) AS hubs FROM g JOIN p USING (c) WHERE d >= mean + 2 * sd GROUP BY 1),
s AS (SELECT c, count(DISTINCT least(src, dst) || '|' || greatest(src, dst)) AS pairs FROM x WHERE src <> dst GROUP BY 1),
t AS (SELECT c, count(*) AS relations, count(CASE WHEN relation = 'TRANSFERRED_FUNDS' THEN 1 END) AS financial, count(CASE WHEN relation = 'CALLED' THEN 1 END) AS communication, avg(confidence) AS sure FROM x GROUP BY 1),
m AS (SELECT c, coalesce(stddev_samp(n), 0) / greatest(avg(n), 1) AS burst FROM (SELECT c, strftime(ts, '%Y-%m') AS mm, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
prints AS (SELECT c AS "case", entities, relations, round(mean, 4) AS avg_degree, round(sd, 4) AS degree_std, round(top / greatest(entities - 1, 1)::DOUBLE, 4) AS centralization, round(2 * pairs / (entities * (entities - 1))::DOUBLE, 6) AS density, fan_in, fan_out, coalesce(hubs, 0) AS hubs, financial, communication,
round(financial / relations::DOUBLE, 6) AS financial_share, round(communication / relations::DOUBLE, 6) AS communication_share, round(burst, 4) AS burst_index, round(sure, 4) AS avg_confidence, 1.0::DOUBLE AS person_share FROM p JOIN t USING (c) JOIN s USING (c) LEFT JOIN h USING (c) JOIN m USING (c))"""


def _prints(spark, sf):
    e = views.edges(spark, sf).where("src LIKE 'U:%'")
    e = e.withColumn("k", F.concat(F.lit("K"), F.substring("src", 3, 20).cast("long") % 8))
    return profiles.fingerprint(e, "k", views.nodes(spark, sf).select(F.col("id").alias("node"), "entity_type"))


@query(f"WITH {PRINT} SELECT * FROM prints", EDGE)
def agg_fingerprint(spark, sf):
    """AGG-28: one structural fingerprint a case."""
    return _prints(spark, sf)


def _cos(*xs: str) -> str:
    dot = lambda p, q: " + ".join(f"({x.format(p)}) * ({x.format(q)})" for x in xs)
    return f"round(({dot('x', 'y')}) / (sqrt({dot('x', 'x')}) * sqrt({dot('y', 'y')})), 6)"


_S = _cos("least({0}.entities / 500.0::DOUBLE, 1)", "least({0}.relations / 2000.0::DOUBLE, 1)", "least({0}.avg_degree / 20, 1)", "{0}.centralization", "{0}.density", "{0}.fan_in / {0}.entities::DOUBLE", "{0}.fan_out / {0}.entities::DOUBLE")
_M = _cos("{0}.hubs / {0}.entities::DOUBLE", "{0}.fan_in / {0}.entities::DOUBLE", "{0}.fan_out / {0}.entities::DOUBLE")


@query(f"""WITH {PRINT}, z AS (SELECT x."case" AS a, y."case" AS b, {_S} AS structural, 1.0::DOUBLE AS composition, {_M} AS motif, round(1 - abs(x.financial_share - y.financial_share), 6) AS financial, round(greatest(0, 1 - abs(x.burst_index - y.burst_index) / 2), 6) AS temporal FROM prints x JOIN prints y ON x."case" < y."case")
SELECT *, round(structural * 0.35::DOUBLE + financial * 0.2::DOUBLE + temporal * 0.15::DOUBLE + composition * 0.15::DOUBLE + motif * 0.15::DOUBLE, 4) AS similarity FROM z""", EDGE)
def grf_case_similarity(spark, sf):
    """GRF-53: cases compared along five dimensions."""
    return profiles.case_similarity(_prints(spark, sf))


@query("""WITH s AS (SELECT src AS finding, count(CASE WHEN event_id % 3 <> 0 THEN 1 END) AS support_count, count(CASE WHEN event_id % 9 = 0 THEN 1 END) AS contradiction_count, count(CASE WHEN event_id % 3 = 0 AND event_id % 9 <> 0 THEN 1 END) AS unknown_count FROM v_call GROUP BY 1)
SELECT *, round(support_count / greatest(support_count + contradiction_count, 1)::DOUBLE, 4) AS balance FROM s""", ("v_call",))
def agg_polarity_balance(spark, sf):
    """AGG-29: supporting against contradicting evidence of each finding."""
    label = F.when(F.col("event_id") % 9 == 0, "CONTRADICTORY").when(F.col("event_id") % 3 == 0, "UNKNOWN").otherwise("SUPPORTING")
    return profiles.polarity_balance(calls(spark, sf).select(F.col("src").alias("finding"), label.alias("polarity")))


@query("""WITH n AS (SELECT p_brand AS g, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, len(string_split(name, ' ')) DESC, length(name) DESC, name) AS r FROM n)
SELECT g AS brand, max(CASE WHEN r = 1 THEN name END) AS canonical, count(*) AS names, CAST(sum(n) AS BIGINT) AS mentions FROM r GROUP BY g""")
def agg_canonical_names(spark, sf):
    """AGG-30: the most frequent, then the completest name."""
    return profiles.pick_canonical(table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_name"), "brand", "p_name")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1")
def agg_mode(spark, sf):
    """AGG-30: the commonest type, ties to the first by name."""
    return profiles.mode(table(spark, sf, "events"), "user_id", "event_type")


@query("SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def agg_last_wins(spark, sf):
    """AGG-31: of an attribute's values the last."""
    return profiles.last_wins(table(spark, sf, "events"), "user_id", "event_type", "value", ["ts", "event_id"])


@query("SELECT s_suppkey, s_acctbal, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS s_acctbal_norm FROM supplier")
def agg_min_max(spark, sf):
    """AGG-38."""
    return profiles.min_max(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal")


@query("""WITH w AS (SELECT src AS node, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS p, count(*) AS calls, count(DISTINCT dst) AS contacts, count(CASE WHEN hour(ts) < 6 THEN 1 END) AS night FROM v_call GROUP BY 1, 2),
z AS (SELECT coalesce(a.node, b.node) AS node, coalesce(a.calls, 0)::DOUBLE AS c0, coalesce(b.calls, 0)::DOUBLE AS c1, coalesce(a.contacts, 0)::DOUBLE AS k0, coalesce(b.contacts, 0)::DOUBLE AS k1, coalesce(a.night, 0)::DOUBLE AS n0, coalesce(b.night, 0)::DOUBLE AS n1 FROM (FROM w WHERE p = 0) a FULL JOIN (FROM w WHERE p = 1) b ON a.node = b.node),
d AS (SELECT node, CASE WHEN c0 <> c1 THEN CASE WHEN c0 = 0 THEN c1 / (c1 + 1) ELSE least(1, abs(c1 - c0) / greatest(c0, c1)) END END AS x, CASE WHEN k0 <> k1 THEN CASE WHEN k0 = 0 THEN k1 / (k1 + 1) ELSE least(1, abs(k1 - k0) / greatest(k0, k1)) END END AS y, CASE WHEN n0 <> n1 THEN CASE WHEN n0 = 0 THEN n1 / (n1 + 1) ELSE least(1, abs(n1 - n0) / greatest(n0, n1)) END END AS z FROM z)
SELECT node, round(coalesce(x, 0), 6) AS calls_delta, round(coalesce(y, 0), 6) AS contacts_delta, round(coalesce(z, 0), 6) AS night_delta, round(coalesce(list_avg([x, y, z]), 0), 4) AS change FROM d""", ("v_call",))
def win_profile_change(spark, sf):
    """WIN-15: the two halves of the month compared."""
    c = calls(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")

    def profile(rows):
        return rows.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("dst").alias("contacts"), F.count(F.when(F.hour("ts") < 6, 1)).alias("night"))

    return profiles.profile_change(profile(c.where(F.col("ts") < cut)), profile(c.where(F.col("ts") >= cut)), "node", ["calls", "contacts", "night"])
