"""Queries on link prediction, hidden intermediaries, learned models and questions in English."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import casework, centrality, ghosts, links, metrics, profiles
from linkloom.operators.graph import as_of, degrees, link_scores, structural_holes
from linkloom.operators.materialize import checkpointed
from linkloom.plans.metric_queries import _scored
from linkloom.plans.nlq import Engine
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table, transfers

CALL = ("v_call",)
ADJ = ("v_call", "pairs", "adj")
EDGE = ("v_call", "v_loc", "v_edge")


@query("""WITH k1 AS (SELECT u AS s, v AS node, 0.005::DOUBLE AS x FROM adj WHERE u IN ('U:1', 'U:2')), k2 AS (SELECT s, v AS node, 0.005::DOUBLE * sum(x) AS x FROM k1 JOIN adj ON u = node GROUP BY 1, 2), k3 AS (SELECT s, v AS node, 0.005::DOUBLE * sum(x) AS x FROM k2 JOIN adj ON u = node GROUP BY 1, 2), k4 AS (SELECT s, v AS node, 0.005::DOUBLE * sum(x) AS x FROM k3 JOIN adj ON u = node GROUP BY 1, 2)
SELECT s, node, round(sum(x), 9) AS katz FROM (FROM k1 UNION ALL FROM k2 UNION ALL FROM k3 UNION ALL FROM k4) WHERE s <> node GROUP BY 1, 2""", ADJ)
def grf_katz(spark, sf):
    """GRF-42: four terms from two users."""
    sources = spark.createDataFrame([("U:1",), ("U:2",)], "node string")
    return links.katz(calls(spark, sf), sources, terms=4).select("s", "node", F.round("katz", 9).alias("katz"))


SCORES = """dg AS (SELECT u, count(*) AS d FROM adj GROUP BY 1), sc AS (SELECT x.v AS x, y.v AS y, count(*) AS common, round(sum(CASE WHEN d > 1 THEN 1 / ln(d) END), 6) AS aa, round(sum(1.0::DOUBLE / d), 6) AS ra FROM adj x JOIN adj y ON x.u = y.u AND x.v < y.v JOIN dg ON dg.u = x.u GROUP BY 1, 2),
sp AS (SELECT sc.*, round(common / (a.d + b.d - common)::DOUBLE, 6) AS jaccard, a.d * b.d AS preferential, p.a IS NOT NULL AS linked FROM sc JOIN dg a ON a.u = x JOIN dg b ON b.u = y LEFT JOIN pairs p ON p.a = x AND p.b = y)"""


@query(f"WITH {SCORES} SELECT x, y, round(ra + jaccard, 6) AS score FROM sp WHERE NOT linked ORDER BY score DESC, x, y LIMIT 500", ADJ)
def grf_candidates(spark, sf):
    """GRF-45: the 500 best pairs without an edge; the 500 are the feature."""
    return links.candidates(calls(spark, sf), 500)


SIG = "round(1 / (1 + exp(-least({}, 20))), 4)"


@query(f"""WITH {SCORES}, v AS (SELECT x, y, linked, [{SIG.format('common')}, {SIG.format('jaccard')}, {SIG.format('aa')}, {SIG.format('ra')}, {SIG.format('preferential')}] AS h FROM sp), m AS (SELECT *, list_sum(h) / 5 AS m FROM v), d AS (SELECT *, least(0.5, list_sum(list_transform(h, lambda z: abs(z - m))) / 5) AS d FROM m)
SELECT x, y, round(greatest(0, least(1, m - 0.5::DOUBLE * d)), 5) AS probability, CASE WHEN linked THEN 'OBSERVED' WHEN m >= 0.85 THEN 'INFERRED' WHEN m >= 0.35 THEN 'PREDICTED_FUTURE' ELSE 'HYPOTHETICAL' END AS status FROM d""", ADJ)
def ml_link_ensemble(spark, sf):
    """ML-01: five baselines as probabilities, their mean less half their spread."""
    return links.ensemble(link_scores(calls(spark, sf)), threshold=0.85).select("x", "y", F.round("probability", 5).alias("probability"), "status")


@query("""WITH e AS (SELECT src, dst, ts FROM v_call WHERE ts < TIMESTAMP '2024-01-20'), a AS (SELECT DISTINCT src AS u, dst AS v FROM e WHERE src <> dst UNION SELECT DISTINCT dst, src FROM e WHERE src <> dst), dg AS (SELECT u, count(*) AS d FROM a GROUP BY 1), n AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1),
p AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM v_call WHERE ts >= TIMESTAMP '2024-01-20'), c AS (SELECT p.x, p.y, count(*) AS common, sum(1.0::DOUBLE / d) AS ra FROM p JOIN a m ON m.v = p.x JOIN a k ON k.u = m.u AND k.v = p.y JOIN dg ON dg.u = m.u GROUP BY 1, 2), t AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 1 END) AS n, max(ts) AS last FROM e GROUP BY 1, 2),
s AS (SELECT src AS node, count(*) AS act, list(DISTINCT CAST(ts AS DATE)) FILTER (ts >= TIMESTAMP '2024-01-10') AS days FROM e GROUP BY 1)
SELECT p.x, p.y, coalesce(common, 0) AS common_neighbors, round(coalesce(round(ra, 6), 0), 4) AS resource_allocation, coalesce(nx.degree, 0) AS source_degree, coalesce(ny.degree, 0) AS target_degree, round(coalesce(n, 0) / 10.0::DOUBLE, 4) AS interaction_frequency, coalesce(sx.act, 0) AS source_activity, coalesce(sy.act, 0) AS target_activity,
round(coalesce((epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', last))) / 86400, 0), 2) AS recency_days, round(CASE WHEN len(sx.days) > 0 AND len(sy.days) > 0 THEN len(list_intersect(sx.days, sy.days)) / len(list_distinct(list_concat(sx.days, sy.days)))::DOUBLE ELSE 0 END, 4) AS temporal_overlap
FROM p LEFT JOIN c USING (x, y) LEFT JOIN t USING (x, y) LEFT JOIN n nx ON nx.node = p.x LEFT JOIN n ny ON ny.node = p.y LEFT JOIN s sx ON sx.node = p.x LEFT JOIN s sy ON sy.node = p.y""", CALL)
def grf_pair_features(spark, sf):
    """GRF-44, EVA-01 task G: features of later pairs from earlier edges only."""
    c = calls(spark, sf)
    pairs = c.where("ts >= timestamp_ntz '2024-01-20'").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return links.pair_features(c, pairs, "2024-01-20 00:00:00", 10).drop("jaccard", "adamic_adar", "preferential_attachment")


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT CAST(a.vec_id AS VARCHAR) AS x, CAST(b.vec_id AS VARCHAR) AS y, round((list_cosine_similarity(a.v, b.v) + 1) / 2, 6) AS similarity, round(1 / (1 + exp(-2 * list_cosine_similarity(a.v, b.v))), 6) AS probability FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def ml_embedding_links(spark, sf):
    """ML-08, UDF-02: neighbouring vectors as pairs."""
    e = table(spark, sf, "embeddings")
    v = e.select(F.col("vec_id").cast("string").alias("node"), F.col("embedding").alias("vector"))
    pairs = e.select(F.col("vec_id").cast("string").alias("x"), (F.col("vec_id") + 1).cast("string").alias("y"))
    return links.embedding_links(pairs, v)


def _training(spark, sf):
    """Pairs with a label: whether they meet again after the moment that features are from."""
    c = calls(spark, sf)
    moment = "2024-01-20 00:00:00"
    early = link_scores(c.where("ts < timestamp_ntz '2024-01-20'")).where("common >= 2").select("x", "y")
    later = c.where("ts >= timestamp_ntz '2024-01-20'").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct().withColumn("label", F.lit(1))
    return checkpointed(links.pair_features(c, early, moment, 10).join(later, ["x", "y"], "left").na.fill(0, ["label"]))  # a fit reads them many times


FEATURES = ["common_neighbors", "jaccard", "adamic_adar", "resource_allocation", "preferential_attachment", "interaction_frequency", "recency_days", "temporal_overlap"]


@query()
def ml_supervised_links(spark, sf):
    """ML-02: a logistic model of later meetings. No oracle: learned weights; unit tests."""
    rows = _training(spark, sf)
    return links.probability(links.train(rows, FEATURES), rows).select("x", "y", "label", F.round("probability", 6).alias("probability"))


@query(f"""WITH s AS (SELECT doc_id, round(least(0.999999, (n_chars % 1000) / 1000.0), 3)::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id)) SELECT count(*) AS n, round(sum(label), 4)::DOUBLE AS total, CAST(0 AS BIGINT) AS falls FROM s""")
def ml_isotonic(spark, sf):
    """ML-05: calibrated scores keep the sum of the labels and never fall with the score."""
    from pyspark.sql import Window

    c = metrics.isotonic(_scored(spark, sf)).withColumn("prev", F.lag("calibrated").over(Window.orderBy("score", "doc_id")))  # labelled rows
    return c.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("calibrated"), 4).alias("total"), F.count(F.when(F.col("calibrated") < F.col("prev") - 1e-9, 1)).alias("falls"))


@query()
def grf_embeddings(spark, sf):
    """GRF-46: skip-grams over walks, aggregated over neighbours. No oracle: learned vectors; unit tests."""
    c = calls(spark, sf)
    v = links.mean_aggregated(c, links.embeddings(c), 1)
    return v.select("node", F.size("vector").cast("long").alias("size"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@query()
def grf_new_hubs(spark, sf):
    """GRF-41: betweenness of the first half against all. No oracle: see grf_betweenness_all."""
    c = calls(spark, sf)
    early = centrality.betweenness(as_of(c, "2024-01-02 00:00:00"))
    return links.new_hubs(early, centrality.betweenness(c), 0.002)


# --- hidden intermediaries ----------------------------------------------------------------------


def _case(spark, sf):
    """Customers in four communities a segment, tied by where they live and whom they pay."""
    c = table(spark, sf, "customer")
    lives = c.select(F.concat(F.lit("C:"), "c_custkey").alias("src"), F.concat(F.lit("N:"), "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("relation"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    pays = transfers(spark, sf).where("src LIKE 'C:%' AND amount >= 90000").select("src", "dst", F.lit("PAYS").alias("relation"), "ts")
    knows = c.where("c_custkey % 40 = 0 AND c_custkey > 0").select(F.concat(F.lit("C:"), "c_custkey").alias("src"), F.concat(F.lit("C:"), F.col("c_custkey") - 1).alias("dst"), F.lit("KNOWS").alias("relation"), F.lit(None).cast("timestamp_ntz").alias("ts"))  # every fortieth knows the one before
    members = c.select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey") % 4).alias("community"))
    holes = c.select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.round((F.col("c_custkey") % 11) / 11.0, 6).alias("hole"))
    return lives.unionByName(pays).unionByName(knows), views.nodes(spark, sf), members, holes


GHOST = """e AS (SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst, 'LIVES_IN' AS relation, NULL::TIMESTAMP AS ts FROM customer UNION ALL SELECT src, dst, 'PAYS', ts FROM v_tx WHERE src LIKE 'C:%' AND amount >= 90000 UNION ALL SELECT 'C:' || c_custkey, 'C:' || (c_custkey - 1), 'KNOWS', NULL FROM customer WHERE c_custkey % 40 = 0 AND c_custkey > 0),
mb AS (SELECT 'C:' || c_custkey AS node, c_mktsegment || '-' || (c_custkey % 4) AS community, round((c_custkey % 11) / 11.0::DOUBLE, 6) AS hole FROM customer), t AS (SELECT CASE relation WHEN 'LIVES_IN' THEN 'locations' ELSE 'money_routes' END AS cat, dst AS anchor, community, ts FROM e JOIN mb ON node = src WHERE relation <> 'KNOWS'),
k AS (SELECT cat, anchor, count(DISTINCT community) AS k FROM t GROUP BY 1, 2 HAVING count(DISTINCT community) >= 2), an AS (SELECT DISTINCT t.cat, t.anchor, t.community, 1.0::DOUBLE / greatest(1, k - 1) AS r FROM t JOIN k USING (cat, anchor)), sz AS (SELECT cat, community, sum(r) AS w FROM an GROUP BY 1, 2),
pc AS (SELECT x.cat, x.community AS a, y.community AS b, sum(x.r) AS w, max(x.r) AS peak, count(*) AS s FROM an x JOIN an y ON x.cat = y.cat AND x.anchor = y.anchor AND x.community < y.community GROUP BY 1, 2, 3),
pt AS (SELECT pc.*, CASE pc.cat WHEN 'locations' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END * (0.5::DOUBLE * pc.w / (p.w + q.w - pc.w) + 0.5::DOUBLE * least(1, peak)) * s / (s + 1) AS part FROM pc JOIN sz p ON p.cat = pc.cat AND p.community = a JOIN sz q ON q.cat = pc.cat AND q.community = b),
af AS (SELECT a, b, CAST(sum(s) AS BIGINT) AS shared, sum(part) * (1 + 0.12::DOUBLE * (count(CASE WHEN part > 1e-9 THEN 1 END) - 1)) AS affinity FROM pt GROUP BY 1, 2), fr AS (SELECT community, count(*) AS n FROM mb GROUP BY 1),
dr AS (SELECT least(x.community, y.community) AS a, greatest(x.community, y.community) AS b, count(*) AS d FROM e JOIN mb x ON x.node = src JOIN mb y ON y.node = dst WHERE x.community <> y.community GROUP BY 1, 2), hl AS (SELECT community, avg(hole) AS h FROM (SELECT community, hole FROM mb QUALIFY row_number() OVER (PARTITION BY community ORDER BY hole DESC, node) <= 5) GROUP BY 1),
ta AS (SELECT DISTINCT anchor, community, epoch(date_trunc('second', ts)) AS t FROM t JOIN an USING (cat, anchor, community) WHERE ts IS NOT NULL), tp AS (SELECT x.anchor, x.community AS a, y.community AS b, bool_or(abs(x.t - y.t) <= 14400) AS hit FROM ta x JOIN ta y ON x.anchor = y.anchor AND x.community < y.community GROUP BY 1, 2, 3), te AS (SELECT a, b, avg(hit::INT) AS temporal FROM tp GROUP BY 1, 2),
z AS (SELECT af.a, af.b, shared, coalesce(d, 0) AS direct_edges, coalesce(temporal, 0) AS temporal, CASE WHEN coalesce(temporal, 0) > 0 THEN least(1, affinity * (0.85::DOUBLE + 0.15::DOUBLE * temporal)) ELSE affinity END AS attr, coalesce(d, 0) / (x.n * y.n)::DOUBLE AS density, (p.h + q.h) / 2 AS hole FROM af LEFT JOIN dr USING (a, b) LEFT JOIN te USING (a, b) JOIN fr x ON x.community = af.a JOIN fr y ON y.community = af.b JOIN hl p ON p.community = af.a JOIN hl q ON q.community = af.b),
cf AS (SELECT *, least(0.3, 0.15::DOUBLE * density / 0.002::DOUBLE) AS penalty FROM z)"""


@query(f"""WITH {GHOST} SELECT a, b, shared, direct_edges, round(attr, 6) AS affinity, round(penalty, 6) AS penalty, round((0.5::DOUBLE * greatest(0, attr - penalty) + 0.1::DOUBLE * hole + 0.2::DOUBLE * temporal) / 0.8::DOUBLE, 6) AS confidence, direct_edges > 2 AND density > 0.002 AS connected FROM cf""", ("v_tx",))
def grf_ghosts(spark, sf):
    """GRF-47, JN-14: pairs of communities by shared surfaces, time and direct edges, given the communities."""
    out = ghosts.evaluate(*_case(spark, sf))
    return out.select("a", "b", "shared", "direct_edges", "affinity", "penalty", "confidence", "connected")


@query()
def grf_ghost_edges(spark, sf):
    """GRF-48: where proposed ghosts would attach, beside the real edges. Rows follow grf_ghosts; unit tests."""
    e, n, m, h = _case(spark, sf)
    found = ghosts.evaluate(e, n, m, h, least_affinity=0.1, least_confidence=0.1)
    predicted = ghosts.broker_edges(found, e, m, h, ghosts.contacts(e, n, m))
    return ghosts.augmented(e, predicted).groupBy("relation", "inferred").agg(F.count(F.lit(1)).alias("n"))


@query()
def grf_second_opinion(spark, sf):
    """GRF-49: all pairs of communities by their brokers. No oracle: it would repeat eight joins; unit tests."""
    c = calls(spark, sf)
    d = degrees(c)
    return ghosts.second_opinion(c, views.members(spark, sf).select("node", "community"), views.nodes(spark, sf), d.select("node", F.col("centrality").alias("betweenness")))


@query("""WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_call UNION ALL SELECT dst FROM v_call) GROUP BY 1), n AS (SELECT count(*) AS n FROM d), h AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT (SELECT greatest(1, n // 5) FROM n)), m AS (SELECT u AS node, avg(degree) AS m, avg((v IN (SELECT node FROM h))::INT) AS hub_contact FROM adj JOIN d ON d.node = v GROUP BY 1)
SELECT node, round((degree - m) / greatest(1, m), 6) AS degree_residual, round(hub_contact, 6) AS hub_contact FROM d JOIN m USING (node)""", ADJ)
def grf_propagation(spark, sf):
    """GRF-50: degrees against the neighbours', and contact with hubs."""
    return ghosts.propagation(calls(spark, sf))


@query("""WITH e AS (SELECT 'C:' || c_custkey AS src, 'N:' || c_nationkey AS dst FROM customer), g AS (SELECT node, count(*) AS degree, count(CASE WHEN o THEN 1 END) AS out_degree FROM (SELECT src AS node, TRUE AS o FROM e UNION ALL SELECT dst, FALSE FROM e) GROUP BY 1), mb AS (SELECT 'C:' || c_custkey AS node, c_mktsegment AS community FROM customer),
r AS (SELECT dst AS node, count(DISTINCT community) AS communities_reached FROM e JOIN mb ON node = src GROUP BY 1), s AS (SELECT node, count(*) OVER (PARTITION BY community) AS community_size FROM mb), a AS (SELECT dst AS anchor FROM e JOIN mb ON node = src GROUP BY dst HAVING count(DISTINCT community) >= 2), p AS (SELECT src AS node, count(DISTINCT dst) AS locations_anchors FROM e WHERE dst IN (SELECT anchor FROM a) GROUP BY 1)
SELECT node, degree, out_degree, coalesce(communities_reached, 0) AS communities_reached, coalesce(community_size, 0) AS community_size, coalesce(locations_anchors, 0) AS locations_anchors, coalesce(communities_reached, 0) >= 2 AS bridges_communities FROM g LEFT JOIN r USING (node) LEFT JOIN s USING (node) LEFT JOIN p USING (node)""")
def grf_ghost_features(spark, sf):
    """GRF-51: features of nodes for the learned detector."""
    c = table(spark, sf, "customer")
    e = c.select(F.concat(F.lit("C:"), "c_custkey").alias("src"), F.concat(F.lit("N:"), "c_nationkey").alias("dst"), F.lit("LIVES_IN").alias("relation"), F.lit(None).cast("timestamp_ntz").alias("ts"))
    m = c.select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_mktsegment").alias("community"))
    zero = m.select("node", F.lit(0.0).alias("hole"))
    out = ghosts.features(e, m, zero, m.select("node", F.lit(0.0).alias("betweenness")), ghosts.contacts(e, views.nodes(spark, sf), m))
    return out.select("node", "degree", "out_degree", "communities_reached", "community_size", "locations_anchors", "bridges_communities")


@query("""WITH g AS (SELECT 'GHOST-' || (user_id % 9) AS s, max(value) / 100 AS c FROM events GROUP BY 1), l AS (SELECT DISTINCT src || '→' || dst AS s, 0.5::DOUBLE AS c FROM v_call WHERE relation = 'signup' AND event_id % 10 = 0), d AS (SELECT node, count(*) AS degree, count(CASE WHEN o THEN 1 END)::DOUBLE AS b FROM (SELECT src AS node, TRUE AS o FROM v_call UNION ALL SELECT dst, FALSE FROM v_call) GROUP BY 1), n AS (SELECT c_nationkey AS h, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1),
u AS (SELECT 'POTENTIAL_HIDDEN_INTERMEDIARY' AS hypothesis_type, s AS subject, c FROM g UNION ALL SELECT 'POTENTIAL_MISSING_LINK', s, c FROM l UNION ALL SELECT 'NETWORK_FRAGMENTATION_POINT', 'R:' || r_regionkey, 0.4::DOUBLE + 0.1::DOUBLE * r_regionkey FROM region WHERE r_regionkey > 1 UNION ALL SELECT 'UNUSUAL_COORDINATOR', node, 0.5::DOUBLE + b / degree FROM d WHERE b > 0.5::DOUBLE * (SELECT max(b) FROM d) UNION ALL SELECT 'ENTITY_COLLISION', 'N:' || h, 0.3::DOUBLE + 0.1::DOUBLE * k FROM n WHERE k > 1)
SELECT 'HYP-' || substr(sha256(hypothesis_type || '|' || subject), 1, 12) AS id, hypothesis_type, subject, round(greatest(0, least(1, c)), 4) AS confidence FROM u""", CALL)
def grf_hypotheses(spark, sf):
    """GRF-52: five kinds of hypotheses in one table."""
    e, c = table(spark, sf, "events"), calls(spark, sf)
    g = e.groupBy(F.concat(F.lit("GHOST-"), F.col("user_id") % 9).alias("ghost_id")).agg((F.max("value") / 100).alias("confidence"))
    ln = c.where("relation = 'signup' AND event_id % 10 = 0").select(F.col("src").alias("x"), F.col("dst").alias("y"), F.lit(0.5).alias("probability")).distinct()
    parts = table(spark, sf, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("removed"), F.col("r_regionkey").alias("components"))
    ends = profiles.endpoints(c).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.count(F.when(F.col("outgoing"), 1)).cast("double").alias("betweenness"))
    names = table(spark, sf, "customer").groupBy(F.concat(F.lit("N:"), "c_nationkey").alias("holder")).agg(F.countDistinct("c_mktsegment").alias("names"))
    return links.hypotheses(g, ln, parts, ends, names).drop("status")


@query("""WITH a AS (SELECT node, count(*) AS degree, CASE WHEN max(weight) > 0 THEN count(*) END AS n, sum(power(p + coalesce(q, 0), 2)) AS c FROM (SELECT u AS node, v, weight, p, (SELECT sum(y.p * z.p) FROM w y JOIN w z ON z.u = y.v AND z.v = w.v WHERE y.u = w.u AND z.v <> y.u) AS q FROM w) GROUP BY node) SELECT node, round(c, 6) AS "constraint", degree FROM a""".replace("WITH a", "WITH r AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, count(*)::DOUBLE AS weight FROM v_loc GROUP BY 1, 2), s AS (SELECT x AS u, y AS v, weight FROM r UNION ALL SELECT y, x, weight FROM r), w AS (SELECT u, v, weight, weight / sum(weight) OVER (PARTITION BY u) AS p FROM s), a"), ("v_loc",))
def grf_constraint_places(spark, sf):
    """GRF-10: Burt's constraint of the places."""
    from linkloom.sources.tables import places

    return structural_holes(places(spark, sf)).select("node", "constraint", "degree")


@query("""WITH p AS (SELECT least(src, dst) AS x, greatest(src, dst) AS y, min(ts) AS first FROM v_call GROUP BY 1, 2) SELECT CAST(0 AS BIGINT) AS future_edges, count(*) AS pairs FROM p WHERE first >= TIMESTAMP '2024-01-20'""", CALL)
def eva_leakage(spark, sf):
    """EVA-01 task G: no feature knows of edges after its moment."""
    c = calls(spark, sf)
    pairs = c.where("ts >= timestamp_ntz '2024-01-20'").select(F.col("src").alias("x"), F.col("dst").alias("y"))
    return casework.leakage_task(links.pair_features(c, pairs, "2024-01-20 00:00:00", 10), c, "2024-01-20 00:00:00")


@query("""WITH l AS (SELECT 'K' || user_id AS case_id, event_id AS seq, event_type, 'I' || (event_id % 7) AS item FROM events), d AS (SELECT case_id FROM l GROUP BY 1 HAVING arg_max(event_type, seq) = 'error'), t AS (SELECT case_id, arg_max('T' || seq, seq) FILTER (event_type = 'signup') AS title FROM l GROUP BY 1),
i AS (SELECT case_id, item FROM l WHERE event_type IN ('click', 'view') GROUP BY 1, 2 HAVING arg_max(event_type, seq) = 'click') SELECT t.case_id, title, coalesce(string_agg(item, ',' ORDER BY item), '') AS items FROM t LEFT JOIN i ON i.case_id = t.case_id WHERE t.case_id NOT IN (SELECT case_id FROM d) GROUP BY 1, 2""")
def flt_cases(spark, sf):
    """FLT-19: workspaces from their log of actions; events stand for actions."""
    e = table(spark, sf, "events")
    t = F.col("event_type")
    action = F.when(t == "signup", "update").when(t == "click", "add_item").when(t == "view", "remove_item").when(t == "error", "delete").otherwise("update")
    log = e.select(F.concat(F.lit("K"), "user_id").alias("case_id"), F.col("event_id").alias("seq"), action.alias("action"), F.when(t == "signup", F.concat(F.lit("T"), "event_id")).alias("title"), F.lit("OPEN").alias("status"), F.concat(F.lit("I"), F.col("event_id") % 7).alias("item"), "ts")
    return casework.cases(log).select("case_id", "title", F.array_join("items", ",").alias("items"))


# --- questions ----------------------------------------------------------------------------------


def _engine(spark, sf):
    return Engine(views.nodes(spark, sf), views.edges(spark, sf), views.evidence(spark, sf), views.members(spark, sf).select("node", "community"))


@query("SELECT other AS subject, direction || ' ' || relation AS detail, count(*)::DOUBLE AS score FROM (SELECT dst AS other, 'OUT' AS direction, relation FROM v_edge WHERE src = 'U:7' UNION ALL SELECT src, 'IN', relation FROM v_edge WHERE dst = 'U:7') GROUP BY ALL ORDER BY score DESC, subject, detail LIMIT 25", EDGE)
def qry_neighbours(spark, sf):
    """QRY-01, SCL-40: a question about connections; 25 answers are the feature."""
    return _engine(spark, sf).answer("Who is connected to u:7?")


@query("""SELECT src || '>' || dst AS subject, array_to_string(list_slice(list_sort(list(edge_id)), 1, 10), ',') AS detail, CAST(round(sum(CAST(value AS DECIMAL(18,4))), 2) AS DOUBLE) AS score FROM v_edge WHERE relation = 'TRANSFERRED_FUNDS' AND (src = 'U:7' OR dst = 'U:7') GROUP BY src, dst ORDER BY score DESC, subject, detail LIMIT 25""", EDGE)
def qry_money(spark, sf):
    """QRY-01: a question about money; 25 answers are the feature."""
    return _engine(spark, sf).answer("Trace the money from u:7")


@query("SELECT relation AS subject, min(strftime(ts, '%Y-%m-%d')) AS detail, count(*)::DOUBLE AS score FROM v_edge WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-28 23:59:59' GROUP BY 1", EDGE)
def qry_change(spark, sf):
    """QRY-01: a question about a month."""
    return _engine(spark, sf).answer("What happened during January 2024?")


@query("SELECT id, label, entity_type, (SELECT count(*) FROM v_edge WHERE src = 'U:7') + (SELECT count(*) FROM v_edge WHERE dst = 'U:7') AS mentions FROM v_node WHERE id = 'U:7'", (*EDGE, "v_node"))
def qry_tool_get(spark, sf):
    """QRY-02: a tool by its name."""
    return _engine(spark, sf).tool("get", id="U:7").select("id", "label", "entity_type", "mentions")
