"""Queries on filters, lookups, conflicts and set joins over the graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import conflicts, flows, search
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table, transfers

EDGE = ("v_call", "v_loc", "v_edge")


@query("SELECT meeting_id, location, CAST(len(attendees) AS BIGINT) AS n FROM v_meet WHERE list_contains(attendees, 'U:7')", ("v_meet",))
def flt_array_member(spark, sf):
    """FLT-03: meetings that a person attends."""
    return views.meetings(spark, sf).where(F.array_contains("attendees", "U:7")).select("meeting_id", "location", F.size("attendees").cast("long").alias("n"))


@query("SELECT edge_id, src, dst, confidence FROM v_edge WHERE relation = 'CALLED' AND coalesce(confidence, 0) >= 0.9", EDGE)
def flt_triplets(spark, sf):
    """FLT-05: by relation and least confidence, null as 0."""
    return search.triplets(views.edges(spark, sf), relation="CALLED", least=0.9).select("edge_id", "src", "dst", "confidence")


@query("SELECT id, label, mentions FROM (SELECT id, label, entity_type, count(e.node) AS mentions FROM v_node LEFT JOIN (SELECT src AS node FROM v_edge UNION ALL SELECT dst FROM v_edge) e ON e.node = id GROUP BY ALL) WHERE entity_type = 'LOCATION' AND mentions >= 3", (*EDGE, "v_node"))
def flt_entities(spark, sf):
    """FLT-06: by type and least number of mentions."""
    return search.entities(views.nodes(spark, sf), views.edges(spark, sf), "LOCATION", 3).select("id", "label", "mentions")


def _patterns(spark, sf):
    """Smurfing and layering as one table of patterns; windows wide enough for the test data."""
    tx = transfers(spark, sf)
    a = flows.smurfing(tx, threshold=20000, days=30).select(F.lit("SMURFING").alias("pattern_type"), F.col("dst").alias("account"), "severity", "confidence")
    b = flows.layering(tx, days=60).select(F.lit("LAYERING").alias("pattern_type"), "account", "severity", "confidence")
    return a.unionByName(b)


#: The patterns again: first windows by row over range frames.
PATTERNS = """s AS (SELECT dst AS account, ts, count(*) OVER w AS n, sum(amount) OVER w AS total FROM v_tx WHERE amount < 20000 WINDOW w AS (PARTITION BY dst ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAY FOLLOWING)),
s1 AS (SELECT account, min_by(total, ts) AS total FROM s WHERE n >= 3 AND total > 60000 GROUP BY account),
e AS (SELECT src AS account, ts, amount, 1 AS o FROM v_tx UNION ALL SELECT dst, ts, amount, 0 FROM v_tx),
l AS (SELECT account, ts, count(CASE WHEN o = 0 THEN 1 END) OVER w AS ni, count(CASE WHEN o = 1 THEN 1 END) OVER w AS no, sum(CASE WHEN o = 0 THEN amount END) OVER w AS si, sum(CASE WHEN o = 1 THEN amount END) OVER w AS so FROM e WINDOW w AS (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 60 DAY FOLLOWING)),
l1 AS (SELECT account, round(abs(1 - CAST(min_by(so, ts) AS DOUBLE) / greatest(CAST(min_by(si, ts) AS DOUBLE), 1)), 6) AS r FROM l WHERE ni >= 5 AND no >= 5 GROUP BY account),
patterns AS (SELECT 'SMURFING' AS pattern_type, account, CASE WHEN total > 100000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(least(1.0, CAST(round(total, 2) AS DOUBLE) / 60000), 6) AS confidence FROM s1
UNION ALL SELECT 'LAYERING', account, CASE WHEN r < 0.05 THEN 'HIGH' WHEN r < 0.2 THEN 'MEDIUM' ELSE 'LOW' END, round(greatest(0, least(1.0, 1 - 5 * r)), 6) FROM l1)"""


@query(f"WITH {PATTERNS} SELECT pattern_type, account, confidence FROM patterns WHERE pattern_type = upper('smurfing') AND severity = 'MEDIUM'", ("v_tx",))
def flt_patterns(spark, sf):
    """FLT-08: by type, whatever its case, and severity."""
    return search.patterns(_patterns(spark, sf), kind="smurfing", severity="MEDIUM").select("pattern_type", "account", "confidence")


@query(f"WITH {PATTERNS} SELECT account, CAST(round(least(1.0, sum(CASE severity WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.5 ELSE 0.2 END * confidence) / count(*)), 6) AS DOUBLE) AS risk, count(*) AS patterns FROM patterns GROUP BY account", ("v_tx",))
def agg_account_risk(spark, sf):
    """AGG-09: mean severity weight times confidence of an account's patterns."""
    return flows.account_risk(_patterns(spark, sf))


FINDINGS = """f AS (SELECT src AS subject, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'VERIFIED' ELSE 'HYPOTHESIS' END AS status, least(1.0, count(*) / 80.0) AS confidence FROM v_call GROUP BY src)"""


def _findings(spark, sf):
    out = calls(spark, sf).groupBy(F.col("src").alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumns({"status": F.when(F.col("n") >= 60, "VERIFIED").otherwise("HYPOTHESIS"), "confidence": F.least(F.lit(1.0), F.col("n") / 80.0)})


@query(f"WITH {FINDINGS} SELECT subject, status, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM f WHERE status = 'HYPOTHESIS' AND confidence >= 0.5", ("v_call",))
def flt_findings(spark, sf):
    """FLT-09: by status and least confidence."""
    return search.findings(_findings(spark, sf), status="HYPOTHESIS", least=0.5).select("subject", "status", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {FINDINGS} SELECT subject, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM f WHERE status = 'HYPOTHESIS' AND confidence >= 0.2 ORDER BY f.confidence DESC, subject LIMIT 20", ("v_call",))
def flt_hypotheses(spark, sf):
    """FLT-10: as FLT-09, the 20 surest; the limit is the feature."""
    return search.findings(_findings(spark, sf), status="HYPOTHESIS", least=0.2, limit=20, key="subject").select("subject", F.round("confidence", 6).alias("confidence"))


@query("""WITH e AS (SELECT evidence_id AS id, source_type AS kind, text FROM v_evidence), h AS (SELECT 0 AS part, 'node' AS result_type, id, entity_type AS kind FROM v_node WHERE contains(lower(label || ' ' || id), 'user 1')
UNION ALL SELECT 2, 'evidence', id, kind FROM e WHERE contains(lower(text), 'user 1') OR contains(lower(text), 'u:1 ')) SELECT result_type, id, kind FROM h ORDER BY part, id LIMIT 100""", ("v_call", "v_node", "v_evidence"))
def flt_search(spark, sf):
    """FLT-11: names before evidence under one limit, the feature."""
    return search.everywhere(views.nodes(spark, sf), None, views.evidence(spark, sf), ["user 1", "u:1 "], 100)


@query("SELECT src, dst, CAST(round(sum(amount), 2) AS DOUBLE) AS total, count(*) AS n FROM v_tx WHERE src LIKE 'C:%' AND dst LIKE 'S:%' GROUP BY src, dst HAVING sum(amount) >= 50000", ("v_tx",))
def flt_account_subgraph(spark, sf):
    """FLT-12: transfers whose two ends are accounts of the wanted kinds."""
    accounts = views.nodes(spark, sf).where("entity_type IN ('PERSON', 'ORGANIZATION')").select("id", "entity_type")
    rows = search.subgraph(transfers(spark, sf), accounts.where("entity_type = 'PERSON'").select("id"), accounts.where("entity_type = 'ORGANIZATION'").select("id"))
    return rows.groupBy("src", "dst").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n")).where("s >= 50000").select("src", "dst", flows.money(F.col("s")).alias("total"), "n")


@query("SELECT relation, count(*) AS n FROM v_edge WHERE regexp_matches(upper(relation), 'TRANSFER|FINANCIAL|PAID') GROUP BY relation", EDGE)
def flt_transfer_edges(spark, sf):
    """FLT-13: relations that name a transfer."""
    return search.transfer_edges(views.edges(spark, sf)).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT meeting_id, location, ts FROM (SELECT meeting_id, location, ts, unnest(attendees) AS a FROM v_meet) JOIN v_member ON node = a WHERE role = 'boss'", ("v_meet", "v_member"))
def jn_array_overlap(spark, sf):
    """JN-04: meetings with at least one of a set of people."""
    bosses = views.members(spark, sf).where("role = 'boss'").select("node")
    return search.meets_any(views.meetings(spark, sf), "attendees", "meeting_id", bosses).select("meeting_id", "location", "ts")


@query("SELECT e.edge_id, m.community, m.role FROM v_edge e JOIN v_member m ON m.node = e.src WHERE e.relation = 'MET' UNION SELECT e.edge_id, m.community, m.role FROM v_edge e JOIN v_member m ON m.node = e.dst WHERE e.relation = 'MET'", (*EDGE, "v_member"))
def jn_either_semi(spark, sf):
    """JN-03: rows that touch a member with either end, once a group."""
    met = views.edges(spark, sf).where("relation = 'MET'")
    m = views.members(spark, sf)
    return search.touching(met, m.select("node", "community", "role")).select("edge_id", "community", "role")


@query("""WITH s AS (SELECT event_id, 'U:' || user_id AS entity, date_trunc('minute', ts) AS ts, event_type AS place FROM events)
SELECT 'CONF-' || substr(sha256('SPATIAL-' || a.event_id || '-' || b.event_id), 1, 12) AS conflict_id, a.entity, a.place AS value_1, b.place AS value_2 FROM s a JOIN s b ON a.entity = b.entity AND a.ts = b.ts AND CAST(a.event_id AS VARCHAR) < CAST(b.event_id AS VARCHAR) AND a.place <> b.place""")
def jn_same_instant(spark, sf):
    """JN-16: one entity at two places in the same minute."""
    s = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("evidence"), F.concat(F.lit("U:"), "user_id").alias("entity"), F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("place"))
    return conflicts.simultaneous(s).select("conflict_id", F.get("entities", F.lit(0)).alias("entity"), "value_1", "value_2")


IDENTITY = """n AS (SELECT 'P:' || (c_nationkey * 10 + c_custkey % 10) AS holder, lower(c_name) AS k, min('E' || c_custkey) AS e, arg_min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END, 'E' || c_custkey) AS name FROM customer GROUP BY 1, 2),
ident AS (SELECT 'CONF-' || substr(sha256('IDENTITY-' || a.e || '-' || b.e), 1, 12) AS conflict_id, 'IDENTITY' AS conflict_type, 'MEDIUM' AS severity, a.e AS evidence_1, b.e AS evidence_2, a.holder AS entity, a.name AS value_1, b.name AS value_2 FROM n a JOIN n b ON a.holder = b.holder AND a.k < b.k)"""
RELATION = """h AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, CASE relation WHEN 'CALLED' THEN 'TRUSTS' WHEN 'MET' THEN 'DISTRUSTS' ELSE relation END AS r, min(edge_id) AS e FROM v_edge GROUP BY ALL),
rel AS (SELECT 'CONF-' || substr(sha256('RELATIONSHIP-' || a.e || '-' || b.e), 1, 12) AS conflict_id, 'RELATIONSHIP' AS conflict_type, 'LOW' AS severity, a.e AS evidence_1, b.e AS evidence_2, a.x || ',' || a.y AS entity, a.r AS value_1, b.r AS value_2 FROM h a JOIN h b ON a.x = b.x AND a.y = b.y AND a.r = 'DISTRUSTS' AND b.r = 'TRUSTS')"""
ALL = f"{IDENTITY}, {RELATION}, c AS (SELECT * FROM ident UNION ALL SELECT * FROM rel)"


def _claims(spark, sf):
    c = table(spark, sf, "customer")
    holder = F.concat(F.lit("P:"), F.col("c_nationkey") * 10 + F.col("c_custkey") % 10)
    name = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
    return c.select(F.concat(F.lit("E"), "c_custkey").alias("evidence"), holder.alias("holder"), name.alias("name"))


def _identity(spark, sf):
    return conflicts.identity(_claims(spark, sf))


def _contradicting(spark, sf):
    return views.edges(spark, sf).withColumn("relation", F.when(F.col("relation") == "CALLED", "TRUSTS").when(F.col("relation") == "MET", "DISTRUSTS").otherwise(F.col("relation")))


def _conflicts(spark, sf):
    return _identity(spark, sf).unionByName(conflicts.relationship(_contradicting(spark, sf)))


@query(f"WITH {IDENTITY} SELECT conflict_id, entity, value_1, value_2 FROM ident")
def jn_identity_clash(spark, sf):
    """JN-18: one phone under different names."""
    return _identity(spark, sf).select("conflict_id", F.get("entities", F.lit(0)).alias("entity"), "value_1", "value_2")


@query(f"WITH {RELATION} SELECT conflict_id, entity, value_1, value_2 FROM rel", EDGE)
def jn_contradicting_claims(spark, sf):
    """JN-17: the contradiction table against the relations of a pair, in either order."""
    rows = _conflicts(spark, sf).where("conflict_type = 'RELATIONSHIP'")
    return rows.select("conflict_id", F.array_join("entities", ",").alias("entity"), "value_1", "value_2")


@query(f"WITH {ALL} SELECT conflict_id, severity FROM c WHERE severity IN ('MEDIUM', 'HIGH', 'CRITICAL')", EDGE)
def flt_severity(spark, sf):
    """FLT-17: a severity or a worse one."""
    return conflicts.at_least(_conflicts(spark, sf), "MEDIUM").select("conflict_id", "severity")


@query(f"WITH {ALL} SELECT conflict_id, conflict_type FROM c WHERE list_contains(string_split(entity, ','), 'U:7') OR evidence_1 = 'E10' OR evidence_2 = 'E10'", EDGE)
def flt_conflict_scope(spark, sf):
    """FLT-18: conflicts of an entity, and of a piece of evidence."""
    c = _conflicts(spark, sf)
    return conflicts.of_entity(c, "U:7").unionByName(conflicts.of_evidence(c, "E10")).select("conflict_id", "conflict_type")


@query(f"WITH {ALL} SELECT conflict_type, severity, count(*) AS n, grouping_id(conflict_type, severity) AS level FROM c GROUP BY GROUPING SETS ((conflict_type), (severity), ())", EDGE)
def agg_conflict_summary(spark, sf):
    """AGG-10: conflicts by type and by severity."""
    return conflicts.summary(conflicts.identity_counts(_claims(spark, sf)).unionByName(conflicts.relationship_counts(_contradicting(spark, sf))))


@query("SELECT meeting_id, ts, (SELECT count(*) FROM v_meet WHERE list_contains(attendees, 'U:7')) AS total FROM v_meet WHERE list_contains(attendees, 'U:7') ORDER BY ts, meeting_id LIMIT 5 OFFSET 5", ("v_meet",))
def flt_events_of_entity(spark, sf):
    """FLT-20: the second page of the meetings a person takes part in; the page is the feature."""
    m = views.meetings(spark, sf).select("meeting_id", "ts", F.transform("attendees", lambda a: F.struct(a.alias("name"))).alias("participants"))
    return search.page(search.events_of(m, "U:7"), ["ts", "meeting_id"], 2, 5).select("meeting_id", "ts", "total")


@query("SELECT e.evidence_id, e.source_type, n.id AS node FROM (SELECT evidence_id, source_type, unnest(nodes) AS id FROM v_evidence) e JOIN v_node n ON n.id = e.id WHERE n.entity_type = 'PERSON' AND e.source_type = 'CONVERSATION'", ("v_call", "v_evidence", "v_node"))
def jn_evidence_nodes(spark, sf):
    """JN-21: evidence linked to the nodes it names."""
    rows = search.evidence_nodes(views.evidence(spark, sf).where("source_type = 'CONVERSATION'"), views.nodes(spark, sf).where("entity_type = 'PERSON'"))
    return rows.select("evidence_id", "source_type", "node")


@query("SELECT src, dst, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence, count(*) AS n FROM v_call JOIN v_evidence ON record_id = 'CALL-' || event_id WHERE v_call.relation = 'purchase' GROUP BY src, dst HAVING count(*) >= 2", ("v_call", "v_evidence"))
def jn_edge_evidence(spark, sf):
    """JN-22: each edge with the evidence for it."""
    e = views.edges(spark, sf).where("relation = 'TRANSFERRED_FUNDS'")
    return search.edge_evidence(e, views.evidence(spark, sf)).where("n >= 2").select("src", "dst", F.array_join("evidence", ",").alias("evidence"), "n")


@query("""WITH t AS (SELECT o_orderkey AS i, upper('customer  #' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS source, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'supplier-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 9, '0') END AS target, o_orderpriority AS relation FROM orders),
n AS (SELECT min(id) AS guid, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS k FROM v_node GROUP BY 2)
SELECT i, a.guid AS src, b.guid AS dst, relation FROM t JOIN n a ON a.k = trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) JOIN n b ON b.k = trim(regexp_replace(lower(target), '[^a-z0-9]+', ' ', 'g'))""", ("v_node",))
def jn_resolve_endpoints(spark, sf):
    """JN-23: names of triplets resolved to ids; triplets with an unknown end are dropped."""
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("i"), F.upper(F.concat(F.lit("customer  #"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("source"), F.when(F.col("o_orderkey") % 3 == 0, "Unknown").otherwise(F.concat(F.lit("supplier-"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 9, "0"))).alias("target"), F.col("o_orderpriority").alias("relation"))
    return search.resolve_endpoints(t, views.nodes(spark, sf)).select("i", "src", "dst", "relation")


@query("""WITH r AS (SELECT c_custkey AS id, CAST(c_custkey % 400 AS VARCHAR) AS phone, lower(c_mktsegment) || (c_custkey % 90) AS email, c_nationkey || '-' || (c_custkey // 3) AS ident FROM customer),
p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.phone = b.phone AND a.id < b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.email = b.email AND a.id < b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.ident = b.ident AND a.id < b.id)
SELECT a, b FROM p""")
def jn_multi_blocking(spark, sf):
    """JN-13: candidates that share a phone, an email or an identifier."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 400).cast("string").alias("phone"), F.concat(F.lower("c_mktsegment"), F.col("c_custkey") % 90).alias("email"), F.concat("c_nationkey", F.lit("-"), F.floor(F.col("c_custkey") / 3)).alias("ident"))
    keys = c.select("id", F.explode(F.array(*(F.concat(F.lit(f"{k}:"), k) for k in ("phone", "email", "ident")))).alias("k"))
    return search.shared_key_pairs(keys, "id", "k")


@query("SELECT a.community AS a, b.community AS b, count(*) AS shared FROM (SELECT DISTINCT community, dst AS anchor FROM v_edge JOIN v_member ON node = src WHERE relation = 'CALLED') a JOIN (SELECT DISTINCT community, dst AS anchor FROM v_edge JOIN v_member ON node = src WHERE relation = 'CALLED') b ON a.anchor = b.anchor AND a.community < b.community GROUP BY 1, 2", (*EDGE, "v_member"))
def jn_shared_anchors(spark, sf):
    """JN-14, SET-03: pairs of communities by the anchors they share."""
    e = views.edges(spark, sf).where("relation = 'CALLED'")
    anchors = e.join(views.members(spark, sf), F.col("src") == F.col("node")).select("community", F.col("dst").alias("anchor"))
    return search.overlapping_sets(anchors, "community", "anchor")


@query("""WITH p AS (SELECT id, CAST(('0x' || substr(md5(label), 1, 6)) AS BIGINT) % 400 / 100.0 AS lat, CAST(('0x' || substr(md5(label), 7, 6)) AS BIGINT) % 400 / 100.0 AS lon FROM v_node WHERE id LIKE 'C:%')
SELECT a.id AS a, b.id AS b, CAST(round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS DOUBLE) AS km
FROM p a JOIN p b ON a.id < b.id AND abs(a.lat - b.lat) <= 0.1 WHERE round(2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))), 3) <= 5""", ("v_node",))
def jn_nearby(spark, sf):
    """JN-15, SCL-31, SCL-32: places of names by hash, and pairs within five kilometres by grid cell."""
    n = views.nodes(spark, sf).where("id LIKE 'C:%'")
    cut = lambda at: F.conv(F.substring(F.md5("label"), at, 6), 16, 10).cast("long") % 400 / 100.0
    return search.within_km(n.select("id", cut(1).alias("lat"), cut(7).alias("lon")), 5.0)


@query("""WITH x AS (SELECT DISTINCT 'K' || (o_custkey % 40) AS c, l_partkey AS entity, p_type AS mo FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 49),
es AS (SELECT c, count(DISTINCT entity) AS n FROM x GROUP BY c), ms AS (SELECT c, count(DISTINCT mo) AS n FROM x GROUP BY c),
e AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM (SELECT DISTINCT c, entity FROM x) a JOIN (SELECT DISTINCT c, entity FROM x) b ON a.entity = b.entity AND a.c < b.c GROUP BY 1, 2),
m AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM (SELECT DISTINCT c, mo FROM x) a JOIN (SELECT DISTINCT c, mo FROM x) b ON a.mo = b.mo AND a.c < b.c GROUP BY 1, 2),
j AS (SELECT coalesce(e.a, m.a) AS a, coalesce(e.b, m.b) AS b, coalesce(e.n, 0) AS en, coalesce(m.n, 0) AS mn FROM e FULL JOIN m ON e.a = m.a AND e.b = m.b),
s AS (SELECT a, b, round(en / CAST(ea.n + eb.n - en AS DOUBLE), 6) AS entity_overlap, round(mn / CAST(ma.n + mb.n - mn AS DOUBLE), 6) AS mo_overlap FROM j JOIN es ea ON ea.c = a JOIN es eb ON eb.c = b JOIN ms ma ON ma.c = a JOIN ms mb ON mb.c = b)
SELECT a, b, entity_overlap, mo_overlap, CAST(round(CAST((entity_overlap + mo_overlap) / 2 AS DECIMAL(24,10)), 6) AS DOUBLE) AS score FROM s WHERE mo_overlap >= 0.5 OR entity_overlap >= 0.6""")
def jn_case_links(spark, sf):
    """JN-19: cases linked by shared entities or by a shared way of working."""
    rows = table(spark, sf, "lineitem").where("l_quantity >= 49").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = rows.select(F.concat(F.lit("K"), F.col("o_custkey") % 40).alias("case_id"), F.col("l_partkey").alias("entity"), F.col("p_type").alias("mo"))
    return search.case_links(rows)
