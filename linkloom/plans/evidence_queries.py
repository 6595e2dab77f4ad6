"""Queries on evidence, retrieval, findings and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import evidence, graph
from linkloom.plans.record_queries import _first_vector
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table

EV = ("v_call", "v_evidence")
EDGE = ("v_call", "v_loc", "v_edge")


@query("SELECT evidence_id, ts FROM v_evidence WHERE list_contains(nodes, 'U:7')", EV)
def ret_by_node(spark, sf):
    """RET-01: what names a node."""
    return evidence.by_node(views.evidence(spark, sf), "U:7").select("evidence_id", "ts")


@query("SELECT edge_id, evidence_id FROM v_edge JOIN v_evidence ON record_id = edge_id WHERE v_edge.relation = 'TRANSFERRED_FUNDS'", (*EDGE, "v_evidence"))
def ret_by_edge(spark, sf):
    """RET-01: the evidence behind edges."""
    e = views.edges(spark, sf).where("relation = 'TRANSFERRED_FUNDS'")
    return evidence.by_edge(views.evidence(spark, sf), e.select("edge_id", F.col("edge_id").alias("record_id")))


@query("SELECT evidence_id, source_type FROM v_evidence WHERE record_id IN (SELECT 'CALL-' || event_id FROM v_call WHERE src = 'U:9')", EV)
def ret_by_finding(spark, sf):
    """RET-01: what a finding cites; a caller's calls stand for a finding."""
    ev = views.evidence(spark, sf)
    c = calls(spark, sf).select(F.col("src").alias("finding"), F.concat(F.lit("CALL-"), "event_id").alias("record_id"))
    return evidence.by_finding(ev, c.join(ev, "record_id").select("finding", "evidence_id"), "U:9").select("evidence_id", "source_type")


@query("SELECT evidence_id, ts FROM v_evidence WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' AND (list_contains(nodes, 'U:7') OR list_contains(nodes, 'U:9'))", EV)
def ret_timeline(spark, sf):
    """RET-01: dated evidence on two nodes within a week."""
    return evidence.timeline(views.evidence(spark, sf), ["U:7", "U:9"], "2024-01-05 00:00:00", "2024-01-12 00:00:00").select("evidence_id", "ts")


@query("SELECT token, count(*) AS n FROM (SELECT DISTINCT evidence_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS token FROM v_evidence) GROUP BY token", EV)
def ret_postings(spark, sf):
    """SRC-23, SCL-29: the inverted index, by how many records hold a token."""
    return evidence.postings(views.evidence(spark, sf)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT evidence_id, len(list_filter(['purchase', 'call', 'made', 'call-77'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'), t))) + CASE WHEN record_id = 'CALL-77' THEN 3 ELSE 0 END AS score FROM v_evidence WHERE source_type = 'CALL') SELECT evidence_id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, evidence_id LIMIT 40""", EV)
def ret_search_source(spark, sf):
    """RET-02: by source type, an exact record id above all; the 40 are the feature."""
    return evidence.search(views.evidence(spark, sf), ["purchase", "call", "made", "CALL-77"], "CALL", 40)


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, CASE WHEN label % 3 = 0 THEN round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) ELSE -1.0::DOUBLE END AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 25")
def ret_similar_allowed(spark, sf):
    """RET-04: with a filter of entities; the 25 are the feature."""
    return evidence.similar(table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), 25, F.col("label") % 3 == 0)


@query()
def ret_text_vectors(spark, sf):
    """RET-03: TF-IDF vectors of all evidence. No oracle: terms are hashed; unit tests."""
    v = evidence.text_vectors(views.evidence(spark, sf))
    return v.select("evidence_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("norm"))


RELEVANT = "rel AS (SELECT evidence_id, round(len(list_filter(['purchase', 'made', 'call'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]{3,}'), t))) / 3.0::DOUBLE, 6) AS relevance FROM v_evidence WHERE list_contains(nodes, 'U:7') ORDER BY 2 DESC, 1 LIMIT 10)"


@query(f"""WITH {RELEVANT}, last AS (SELECT evidence_id, ts FROM v_evidence WHERE list_contains(nodes, 'U:7') AND ts IS NOT NULL ORDER BY ts DESC, evidence_id LIMIT 5),
u AS (SELECT evidence_id, relevance, 0.0::DOUBLE AS recency, 'semantic' AS signal FROM rel UNION ALL SELECT evidence_id, 0.0::DOUBLE, 1.0::DOUBLE / greatest(1, date_diff('day', CAST(ts AS DATE), DATE '2024-03-01')), 'recency' FROM last WHERE evidence_id NOT IN (SELECT evidence_id FROM rel))
SELECT evidence_id, signal, round(0.6::DOUBLE * relevance + 0.4::DOUBLE * recency, 6) AS rank_score FROM u ORDER BY rank_score DESC, evidence_id LIMIT 30""", EV)
def ret_dossier_retrieval(spark, sf):
    """RET-05: relevant records and the latest ones; both limits are the feature."""
    ev = views.evidence(spark, sf)
    found = evidence.search(evidence.by_node(ev, "U:7"), ["purchase", "made", "call"])
    rel = found.select("evidence_id", F.round(F.col("score") / 3, 6).alias("relevance")).orderBy(F.desc("relevance"), "evidence_id").limit(10)
    return evidence.for_dossier(rel, ev, "U:7", "2024-03-01 00:00:00").select("evidence_id", "signal", "rank_score")


@query(f"""WITH kw AS (SELECT evidence_id AS id, text FROM v_evidence WHERE source_type = 'CALL' AND len(list_filter(['purchase', 'made'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'), t))) = 2 ORDER BY id LIMIT 10),
nb AS (SELECT DISTINCT v AS node FROM adj WHERE u = 'U:7'), g AS (SELECT 'U:7' AS node, 0 AS level, 0 AS place UNION ALL SELECT node, 1, row_number() OVER (ORDER BY node) FROM nb),
u AS (SELECT id AS chunk_id, text AS content, 0.7::DOUBLE AS score, 'keyword' AS method FROM kw UNION ALL SELECT 'GR-' || node, node, CASE WHEN level = 0 THEN 0.9 ELSE 0.85::DOUBLE / (place + 1) END, 'graph' FROM g UNION ALL SELECT 'CS-' || node, node, 0.75::DOUBLE, 'case' FROM v_member WHERE community = 'G2'),
t AS (SELECT chunk_id, method, round(score, 6) AS score, length(content) AS n FROM u ORDER BY score DESC, chunk_id LIMIT 20), r AS (SELECT *, sum(n) OVER (ORDER BY score DESC, chunk_id) AS upto FROM t) SELECT chunk_id, method, score FROM r WHERE upto <= 100""", (*EV, "pairs", "adj", "v_member"))
def ret_chunks(spark, sf):
    """RET-06: keywords, neighbourhood and case within 20 chunks and 100 characters, the feature."""
    from pyspark.sql import Window

    ev = views.evidence(spark, sf)
    kw = evidence.search(ev, ["purchase", "made"], "CALL", 10).join(ev, "evidence_id").select(F.col("evidence_id").alias("chunk_id"), F.col("text").alias("content"))
    hop = graph.k_hop(calls(spark, sf), "U:7", 1)
    hop = hop.withColumn("place", F.when(F.col("level") == 0, 0).otherwise(F.row_number().over(Window.partitionBy("level").orderBy("node"))))  # one node's neighbours
    m = views.members(spark, sf).where("community = 'G2'")
    out = evidence.chunks(kw, hop.select(F.concat(F.lit("GR-"), "node").alias("chunk_id"), F.col("node").alias("content"), "level", "place"), m.select(F.concat(F.lit("CS-"), "node").alias("chunk_id"), F.col("node").alias("content")), 20, 100)
    return out.select("chunk_id", "method", "score")


GHOSTS = """gh AS (SELECT 'GH-' || (user_id % 12) AS ghost_id, max(value) / 100 AS confidence, CAST(count(*) % 3 AS BIGINT) AS direct_edges FROM events WHERE event_id % 2 = 0 GROUP BY 1), an AS (SELECT DISTINCT 'GH-' || (user_id % 12) AS ghost_id, CASE WHEN event_id % 50 = 0 THEN 'X:' || (user_id % 5) ELSE 'U:' || user_id END AS node FROM events WHERE event_id % 25 = 0),
ln AS (SELECT evidence_id, unnest(nodes) AS node FROM v_evidence WHERE source_type = 'CONVERSATION'), ag AS (SELECT ghost_id, list_sort(list(DISTINCT evidence_id) FILTER (evidence_id IS NOT NULL)) AS supporting, list_sort(list(DISTINCT an.node) FILTER (evidence_id IS NULL)) AS unknown FROM an LEFT JOIN ln ON ln.node = an.node GROUP BY 1),
fd AS (SELECT 'FD-' || substr(sha256('hidden_intermediary|' || ghost_id), 1, 12) AS finding_id, ghost_id, CAST(round(CAST(confidence AS DECIMAL(24,10)), 4) AS DOUBLE) AS confidence, coalesce(supporting, []) AS supporting, CASE WHEN direct_edges > 0 THEN 'COUNTER:direct_edges:' || direct_edges ELSE '' END AS counter, coalesce(unknown, []) AS unknown FROM gh LEFT JOIN ag USING (ghost_id))"""


def _findings(spark, sf):
    e = table(spark, sf, "events")
    ghost = F.concat(F.lit("GH-"), F.col("user_id") % 12)
    gh = e.where("event_id % 2 = 0").groupBy(ghost.alias("ghost_id")).agg((F.max("value") / 100).alias("confidence"), (F.count(F.lit(1)) % 3).alias("direct_edges"))
    an = e.where("event_id % 25 = 0").select(ghost.alias("ghost_id"), F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("X:"), F.col("user_id") % 5)).otherwise(F.concat(F.lit("U:"), "user_id")).alias("node")).distinct()
    ev = views.evidence(spark, sf)
    ln = ev.where("source_type = 'CONVERSATION'").select("evidence_id", F.explode("nodes").alias("node"))
    return evidence.findings(gh, an, ln), ev


@query(f"WITH {GHOSTS} SELECT finding_id, confidence, array_to_string(supporting, ',') AS supporting, counter, array_to_string(unknown, ',') AS unknown, CASE WHEN len(supporting) > 0 THEN 'OBSERVED' ELSE 'INFERRED' END AS claim_label FROM fd", EV)
def ret_findings(spark, sf):
    """RET-07: findings with what supports, weakens and is missing of them."""
    return _findings(spark, sf)[0].select("finding_id", "confidence", F.array_join("supporting", ",").alias("supporting"), F.array_join("counter", ",").alias("counter"), F.array_join("unknown", ",").alias("unknown"), "claim_label")


@query(f"WITH {GHOSTS} SELECT finding_id, 'CONFIDENCE_OUT_OF_RANGE' AS rule, 'ERROR' AS severity FROM fd WHERE confidence > 1 UNION ALL SELECT finding_id, 'NO_COUNTER_EVIDENCE', 'WARNING' FROM fd WHERE counter = '' UNION ALL SELECT finding_id, 'NO_UNKNOWNS', 'WARNING' FROM fd WHERE len(unknown) = 0", EV)
def ret_integrity(spark, sf):
    """RET-07: the rules that findings break."""
    f, ev = _findings(spark, sf)
    return evidence.integrity(f, ev)


@query("""WITH o AS (SELECT event_id AS output_id, event_id % 6 AS k, user_id FROM events), v AS (SELECT DISTINCT 'U:' || user_id AS id FROM events)
SELECT output_id, 'UNKNOWN_STATUS' AS violation FROM o WHERE k = 0 UNION ALL SELECT output_id, 'UPGRADED_STATUS' FROM o WHERE k = 1 UNION ALL SELECT output_id, 'COUNTER_EVIDENCE_DROPPED' FROM o WHERE k = 2 UNION ALL SELECT output_id, 'FORBIDDEN_LANGUAGE' FROM o WHERE k = 3 UNION ALL SELECT output_id, 'UNKNOWN_EVIDENCE' FROM o WHERE k = 4 OR output_id NOT IN (SELECT event_id FROM v_call)
UNION ALL SELECT output_id, 'UNKNOWN_ENTITY' FROM o WHERE k = 5""", EV)
def ret_guardrails(spark, sf):
    """RET-11: what is wrong with generated outputs; events stand for them."""
    e = table(spark, sf, "events")
    k = F.col("event_id") % 6
    cited = F.concat(F.lit("E-"), F.substring(F.sha2(F.concat(F.lit("CALL|CALL-"), "event_id"), 256), 1, 16))
    o = e.select(F.col("event_id").alias("output_id"), F.when(k == 3, "This proves that the user is guilty.").otherwise("A summary.").alias("summary"), F.when(k == 0, "CERTAIN").when(k == 1, "OBSERVED").otherwise("INFERRED").alias("status"), F.when(k == 1, "INFERRED").alias("source_status"), F.array(F.when(k == 4, F.lit("E-0")).otherwise(cited)).alias("evidence_ids"), F.array(F.when(k == 5, F.lit("U:none")).otherwise(F.concat(F.lit("U:"), "user_id"))).alias("entity_ids"), (k == 2).alias("has_counter"), F.array().cast("array<string>").alias("counter_ids"))
    return evidence.guardrails(o, views.evidence(spark, sf), views.nodes(spark, sf))


@query("""WITH p AS (SELECT evidence_id, nodes[1] AS finding, regexp_matches(lower(text), '\\b(no|not|never|denied|denies|refused|rejected|false|untrue|wrong|unrelated)\\b') AS neg, len(regexp_extract_all(lower(text), '\\b(no|not|never|denied|denies|refused|rejected|false|untrue|wrong|unrelated)\\b')) AS nn, contains(lower(text), 'click')::INT + contains(lower(text), 'tion')::INT AS m,
regexp_matches(lower(text), '\\b(confirmed|admitted|acknowledged|verified|stated|reported|found|observed|evidence|recorded|seen|matched|called|met|transferred)\\b') AS yes FROM v_evidence), s AS (SELECT *, CASE WHEN neg THEN 'CONTRADICTS' WHEN m > 0 THEN 'SUPPORTS' ELSE 'UNKNOWN' END AS polarity, round(CASE WHEN neg AND m > 0 THEN least(1, 0.4 + 0.2 * nn) WHEN neg THEN 0.3 WHEN yes AND m > 0 THEN least(1, 0.4 + 0.15 * m) WHEN m > 0 THEN least(0.6, 0.3 + 0.1 * m) ELSE 0 END, 6) AS w FROM p)
SELECT finding, count(CASE WHEN polarity = 'SUPPORTS' THEN 1 END) AS supporting, count(CASE WHEN polarity = 'CONTRADICTS' THEN 1 END) AS contradicting, count(CASE WHEN polarity = 'UNKNOWN' THEN 1 END) AS unknown, CAST(round(coalesce(sum(CASE WHEN polarity = 'SUPPORTS' THEN CAST(w AS DECIMAL(10,6)) END), 0) - coalesce(sum(CASE WHEN polarity = 'CONTRADICTS' THEN CAST(w AS DECIMAL(10,6)) END), 0), 4) AS DOUBLE) AS net_support,
count(CASE WHEN polarity = 'SUPPORTS' THEN 1 END) > 0 AND count(CASE WHEN polarity = 'CONTRADICTS' THEN 1 END) > 0 AS has_conflict FROM s GROUP BY finding""", EV)
def ret_panel(spark, sf):
    """RET-09: what speaks for and against each caller's calls."""
    ev = views.evidence(spark, sf)
    return evidence.panel(ev.select(F.get("nodes", F.lit(0)).alias("finding"), "evidence_id"), ev, ["click", "tion"])


@query("""WITH t AS (SELECT DISTINCT m.community AS finding, e.edge_id FROM v_edge e JOIN v_member m ON m.node = e.src OR m.node = e.dst WHERE m.role = 'boss'), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY finding ORDER BY edge_id) <= 12), p AS (SELECT f.finding, f.edge_id, count(evidence_id) AS n FROM f LEFT JOIN v_evidence ON record_id = edge_id GROUP BY 1, 2)
SELECT finding, string_agg(edge_id, ',' ORDER BY edge_id) AS edges, CAST(sum(n) AS BIGINT) AS evidence, bool_and(n > 0) AS provenance_verified FROM p GROUP BY 1""", (*EDGE, "v_member", "v_evidence"))
def ret_chain(spark, sf):
    """RET-13: from findings to edges to evidence, twelve edges each, the feature."""
    m = views.members(spark, sf).where("role = 'boss'").select(F.col("community").alias("finding"), "node")
    return evidence.chain(m, views.edges(spark, sf), views.evidence(spark, sf))


@query("""WITH h AS (SELECT DISTINCT 'H' || user_id AS id, 'HYPOTHESIS' AS status FROM events), d AS (SELECT 'H' || user_id AS id, CASE event_id % 5 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'REJECT' WHEN 2 THEN 'DEFER' WHEN 3 THEN 'REQUEST_EVIDENCE' END AS v, ts, event_id FROM events WHERE event_type = 'view' AND event_id % 5 <> 4),
l AS (SELECT id, arg_max(v, (ts, event_id)) AS v, count(*) AS n FROM d GROUP BY 1) SELECT h.id, CASE v WHEN 'CONFIRM' THEN 'SUPPORTED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'DEFER' THEN 'UNDER_REVIEW' WHEN 'REQUEST_EVIDENCE' THEN 'UNDER_REVIEW' ELSE h.status END AS status, coalesce(n, 0) AS history FROM h LEFT JOIN l USING (id)""")
def ret_dispositions(spark, sf):
    """RET-14: the latest verdict decides; unknown verdicts don't."""
    e = table(spark, sf, "events")
    h = e.select(F.concat(F.lit("H"), "user_id").alias("id"), F.lit("HYPOTHESIS").alias("status")).distinct()
    k = F.col("event_id") % 5
    d = e.where("event_type = 'view'").select(F.concat(F.lit("H"), "user_id").alias("id"), F.when(k == 0, "confirm").when(k == 1, "REJECT").when(k == 2, "Defer").when(k == 3, "REQUEST_EVIDENCE").otherwise("SHRUG").alias("disposition"), F.lit("a").alias("analyst"), "ts", F.col("event_id").alias("seq"))
    return evidence.hypothesis_status(h, d)


@query("""WITH e AS (SELECT *, CASE WHEN src = 'U:7' THEN dst ELSE src END AS other FROM v_edge WHERE src = 'U:7' OR dst = 'U:7'), r AS (SELECT string_agg(relation || '=' || n, ',' ORDER BY relation) AS ties FROM (SELECT relation, count(*) AS n FROM e GROUP BY 1)), nb AS (SELECT string_agg(other, ',' ORDER BY n DESC, other) AS neighbours FROM (SELECT other, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, other LIMIT 10)),
m AS (SELECT * FROM v_evidence WHERE list_contains(nodes, 'U:7')), s AS (SELECT string_agg(evidence_id, ',' ORDER BY ts DESC NULLS LAST, evidence_id) AS evidence FROM (SELECT * FROM m ORDER BY ts DESC NULLS LAST, evidence_id LIMIT 10)), c AS (SELECT count(*) AS records, count(CASE WHEN ts IS NULL THEN 1 END) AS undated FROM m)
SELECT id, label, ties, neighbours, evidence, records, CASE WHEN undated > 0 THEN undated || ' records without a time' ELSE '' END AS unknown, TRUE AS valid FROM v_node, r, nb, s, c WHERE id = 'U:7'""", (*EDGE, "v_node", "v_evidence"))
def ret_dossier(spark, sf):
    """RET-08: a subject on one page; the tens are the feature."""
    return evidence.dossier(views.nodes(spark, sf), views.edges(spark, sf), views.evidence(spark, sf), "U:7").drop("entity_type", "status")


@query("""SELECT community, 'Community ' || community || ': ' || count(DISTINCT node) || ' entities with ' || count(*) || ' recorded ends of relations between ' || min(CAST(ts AS DATE)) || ' and ' || max(CAST(ts AS DATE)) || '.' AS brief FROM (SELECT src AS node, ts FROM v_edge UNION ALL SELECT dst, ts FROM v_edge) JOIN v_member USING (node) GROUP BY 1""", (*EDGE, "v_member"))
def ret_brief(spark, sf):
    """RET-12: a sentence a community, by template."""
    return evidence.brief(views.nodes(spark, sf), views.edges(spark, sf), views.members(spark, sf)).drop("status")


@query("""WITH n AS (SELECT community, count(*) AS nodes FROM v_member GROUP BY 1), i AS (SELECT a.community, count(*) AS edges, min(ts) AS first_ts, max(ts) AS last_ts FROM v_edge JOIN v_member a ON a.node = src JOIN v_member b ON b.node = dst AND b.community = a.community GROUP BY 1),
h AS (SELECT community, count(DISTINCT evidence_id) AS evidence FROM (SELECT evidence_id, unnest(nodes) AS node FROM v_evidence) JOIN v_member USING (node) GROUP BY 1), f AS (SELECT community, count(DISTINCT node) AS findings FROM v_member WHERE role = 'boss' GROUP BY 1)
SELECT community, nodes, edges, first_ts, last_ts, evidence, coalesce(findings, 0) AS findings FROM n JOIN i USING (community) JOIN h USING (community) LEFT JOIN f USING (community)""", (*EDGE, "v_member", "v_evidence"))
def ret_pack(spark, sf):
    """RET-15: what an export of each case holds; bosses stand for findings."""
    m = views.members(spark, sf)
    return evidence.pack(m.select("node", "community"), views.edges(spark, sf), views.evidence(spark, sf), m.where("role = 'boss'").select(F.col("node").alias("finding"), "node"))
