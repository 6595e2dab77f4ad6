"""Queries on evaluation metrics, rankings, time buckets and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import metrics, profiles, rankings
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table

EDGE = ("v_call", "v_loc", "v_edge")
SCORED = "s AS (SELECT doc_id, round(least(0.999999, (n_chars % 1000) / 1000.0), 3)::DOUBLE AS score, quality AS label FROM documents JOIN labels USING (doc_id))"
STEPS = f"""{SCORED}, p AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM s GROUP BY score),
t AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM p WINDOW w AS (ORDER BY score DESC))"""


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.round(F.least(F.lit(0.999999), (F.col("n_chars") % 1000) / 1000.0), 3).alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("long").alias("label")), "doc_id")


@query(f"WITH {STEPS} SELECT score, round(fp / neg, 6)::DOUBLE AS fpr, round(tp / pos, 6)::DOUBLE AS tpr FROM t")
def eva_roc_curve(spark, sf):
    """AGG-32: the ROC curve."""
    return metrics.roc_curve(_scored(spark, sf))


@query(f"WITH {STEPS} SELECT score, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / pos, 6)::DOUBLE AS recall FROM t")
def eva_pr_curve(spark, sf):
    """AGG-32, ML-06: the precision-recall curve."""
    return metrics.precision_recall_curve(_scored(spark, sf))


@query(f"""WITH {STEPS}, u AS (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp0, coalesce(lag(fp) OVER w, 0) AS fp0 FROM t WINDOW w AS (ORDER BY score DESC))
SELECT round(sum((fp - fp0) * (tp + tp0) / 2.0) / max(pos * neg), 4)::DOUBLE AS roc_auc, round(sum((tp - tp0) * tp / (tp + fp)::DOUBLE) / max(pos), 4)::DOUBLE AS pr_auc FROM u""")
def eva_areas(spark, sf):
    """AGG-32: areas under both curves."""
    return metrics.areas(_scored(spark, sf))


@query(f"""WITH {SCORED}, r AS (SELECT label, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM s), k AS (SELECT unnest([1, 5, 10, 50]) AS k)
SELECT CAST(k AS BIGINT) AS k, round(sum(label) / k::DOUBLE, 6) AS precision, round(sum(label) / (SELECT sum(label) FROM s)::DOUBLE, 6) AS recall FROM k JOIN r ON r <= k GROUP BY k""")
def eva_at_k(spark, sf):
    """AGG-32: precision and recall of the best k."""
    return metrics.at_k(_scored(spark, sf), "doc_id", [1, 5, 10, 50])


@query(f"""WITH {SCORED}, b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(label) AS l, sum(power(score - label, 2)) AS q FROM s GROUP BY 1)
SELECT round(sum(n * abs(s - l)) / sum(n), 4)::DOUBLE AS ece, round(sum(q) / sum(n), 4)::DOUBLE AS brier, CAST(sum(n) AS BIGINT) AS n FROM b""")
def eva_calibration_error(spark, sf):
    """AGG-32, AGG-36."""
    return metrics.calibration_error(_scored(spark, sf))


@query("""WITH j AS (SELECT event_type AS a, user_id % 7 AS b, count(*)::DOUBLE AS c FROM events GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER () AS n FROM j),
m AS (SELECT sum(c / n * ln(c * n / (ca * cb))) AS mi, sum(c * (c - 1) / 2) AS ij, max(n) AS n FROM t), x AS (SELECT -sum(ca / n * ln(ca / n)) AS h, sum(ca * (ca - 1) / 2) AS i FROM (SELECT DISTINCT a, ca, n FROM t)), y AS (SELECT -sum(cb / n * ln(cb / n)) AS h, sum(cb * (cb - 1) / 2) AS j FROM (SELECT DISTINCT b, cb, n FROM t))
SELECT round(mi / sqrt(x.h * y.h), 6) AS nmi_geometric, round(mi / ((x.h + y.h) / 2), 6) AS nmi_arithmetic, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM m, x, y""")
def eva_contingency(spark, sf):
    """AGG-33: both normalisations and the adjusted Rand index."""
    return metrics.contingency(table(spark, sf, "events").select("event_type", (F.col("user_id") % 7).alias("k")), "event_type", "k")


@query("""WITH p AS (SELECT a.p_type = b.p_type AS truth, a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= 5 AS predicted FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey),
c AS (SELECT count(CASE WHEN truth AND predicted THEN 1 END) AS tp, count(CASE WHEN NOT truth AND predicted THEN 1 END) AS fp, count(CASE WHEN truth AND NOT predicted THEN 1 END) AS fn, count(CASE WHEN NOT truth AND NOT predicted THEN 1 END) AS tn FROM p)
SELECT *, round(tp / greatest(tp + fp, 1)::DOUBLE, 4) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 4) AS f1, round(fp / greatest(fp + tn, 1)::DOUBLE, 4) AS false_merge_rate, round(fn / greatest(fn + tp, 1)::DOUBLE, 4) AS false_split_rate FROM c""")
def eva_pair_metrics(spark, sf):
    """AGG-34: merges judged pair by pair."""
    p = table(spark, sf, "part").select("p_name", "p_type", "p_brand", "p_size")
    truth = lambda a, b: F.col(f"{a}.p_type") == F.col(f"{b}.p_type")
    predicted = lambda a, b: (F.col(f"{a}.p_brand") == F.col(f"{b}.p_brand")) & (F.abs(F.col(f"{a}.p_size") - F.col(f"{b}.p_size")) <= 5)
    return metrics.profile_pair_metrics(p, ["p_name"], truth, predicted)


@query("""WITH t AS (SELECT DISTINCT user_id AS doc, event_type AS label, event_id % 50 AS s, event_id % 50 + 5 AS e FROM events WHERE event_id % 3 <> 0), f AS (SELECT DISTINCT user_id AS doc, event_type AS label, event_id % 50 AS s, event_id % 50 + 5 AS e FROM events WHERE event_id % 5 <> 0),
j AS (SELECT coalesce(t.label, f.label) AS label, t.doc IS NOT NULL AS a, f.doc IS NOT NULL AS b FROM t FULL JOIN f ON t.doc = f.doc AND t.label = f.label AND t.s = f.s AND t.e = f.e), k AS (SELECT label, a, b FROM j UNION ALL SELECT 'ALL', a, b FROM j),
c AS (SELECT label, count(CASE WHEN a AND b THEN 1 END) AS tp, count(CASE WHEN NOT a THEN 1 END) AS fp, count(CASE WHEN NOT b THEN 1 END) AS fn FROM k GROUP BY 1)
SELECT *, round(tp / greatest(tp + fp, 1)::DOUBLE, 4) AS precision, round(tp / greatest(tp + fn, 1)::DOUBLE, 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1)::DOUBLE, 4) AS f1 FROM c""")
def eva_span_metrics(spark, sf):
    """AGG-35: spans by label; two thinnings of the events stand in for truth and finds."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("label"), (F.col("event_id") % 50).alias("start"), (F.col("event_id") % 50 + 5).alias("end"), "event_id")
    return metrics.span_metrics(e.where("event_id % 3 <> 0"), e.where("event_id % 5 <> 0"))


METHODS = """d AS (SELECT node, count(*) AS degree, count(CASE WHEN o THEN 1 END) AS sent, sum(CAST(value AS DECIMAL(18,4))) AS volume FROM (SELECT src AS node, TRUE AS o, value FROM v_call UNION ALL SELECT dst, FALSE, value FROM v_call) GROUP BY node),
m AS (SELECT node, 'degree' AS method, degree::DOUBLE AS score FROM d UNION ALL SELECT node, 'sent', sent::DOUBLE FROM d UNION ALL SELECT node, 'volume', volume::DOUBLE FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, node) AS rank, round(1 - row_number() OVER (PARTITION BY method ORDER BY score DESC, node) / count(*) OVER (PARTITION BY method)::DOUBLE, 4) AS percentile FROM m)"""


def _methods(spark, sf):
    e = profiles.endpoints(calls(spark, sf), "value")
    d = e.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("degree"), F.count(F.when(F.col("outgoing"), 1)).cast("double").alias("sent"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("volume"))
    return d.unpivot("node", ["degree", "sent", "volume"], "method", "score")


@query(f"WITH {METHODS} SELECT node, method, CAST(rank AS BIGINT) AS rank, percentile FROM r", ("v_call",))
def win_method_ranks(spark, sf):
    """WIN-16: rank and percentile by method."""
    return rankings.method_ranks(_methods(spark, sf)).select("node", "method", "rank", "percentile")


@query(f"""WITH {METHODS}, a AS (SELECT node, round(greatest(0, 1 - 3 * stddev_samp(percentile)), 4) AS agreement FROM r GROUP BY node)
SELECT node, agreement, CASE WHEN agreement >= 0.8 THEN 'STRONG' WHEN agreement >= 0.5 THEN 'MODERATE' WHEN agreement >= 0.25 THEN 'WEAK' ELSE 'DISAGREEMENT' END AS level FROM a""", ("v_call",))
def win_agreement(spark, sf):
    """WIN-17: how well the methods agree on a node."""
    return rankings.agreement(rankings.method_ranks(_methods(spark, sf)))


@query(f"""WITH {METHODS} SELECT node, arg_max(method, (rank, method)) AS high_method, max(rank) AS high_rank, arg_min(method, (rank, method)) AS low_method, min(rank) AS low_rank, max(rank) - min(rank) AS spread FROM r GROUP BY node HAVING max(rank) > min(rank) ORDER BY spread DESC, node LIMIT 10""", ("v_call",))
def win_disagreements(spark, sf):
    """WIN-18: the ten nodes the methods differ most about; the ten are the feature."""
    return rankings.disagreements(rankings.method_ranks(_methods(spark, sf)), 10)


@query(f"WITH {METHODS} SELECT node, round((row_number() OVER (ORDER BY score, node) - 1) / (count(*) OVER () - 1)::DOUBLE, 6) AS percentile FROM m WHERE method = 'volume'", ("v_call",))
def win_percentile_scores(spark, sf):
    """WIN-19: (rank - 1) / (n - 1), ties by id."""
    return rankings.percentile_scores(_methods(spark, sf).where("method = 'volume'"), "node", "score").select("node", "percentile")


@query("""WITH t AS (SELECT epoch(date_trunc('second', ts)) AS t, * FROM v_call), b AS (SELECT min(t) AS lo, max(t) AS hi FROM t), k AS (SELECT i, lo + (hi - lo) / 12.0 * i AS a, lo + (hi - lo) / 12.0 * (i + 1) AS z FROM b, (SELECT unnest(range(12)) AS i)),
e AS (SELECT i, src, dst FROM t JOIN k ON t BETWEEN a AND z) SELECT CAST(i AS BIGINT) AS bucket, (SELECT count(*) FROM e f WHERE f.i = e.i) AS edges, count(DISTINCT n) AS nodes FROM (SELECT i, src AS n FROM e UNION ALL SELECT i, dst FROM e) e GROUP BY i""", ("v_call",))
def win_edge_timeline(spark, sf):
    """WIN-12: edges and nodes in closed equal buckets; an edge on a boundary is in both."""
    return rankings.edge_timeline(calls(spark, sf), 12)


@query("""WITH d AS (SELECT DISTINCT date_trunc('second', ts) AS t FROM v_call), r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM d)
SELECT t AS ts, row_number() OVER (ORDER BY t) - 1 AS bucket FROM r WHERE i % greatest(n // 12, 1) = 0 QUALIFY row_number() OVER (ORDER BY t) <= 13""", ("v_call",))
def win_replay_buckets(spark, sf):
    """WIN-13: every so-manieth distinct second, one more than twelve at most."""
    return rankings.replay_buckets(calls(spark, sf), 12)


TOPOLOGY = """d AS (SELECT DISTINCT date_trunc('second', ts) AS t FROM v_call), r AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM d), b AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM r WHERE i % greatest(n // 15, 1) = 0 QUALIFY row_number() OVER (ORDER BY t) <= 16),
f AS (SELECT n, min(date_trunc('second', ts)) AS t FROM (SELECT src AS n, ts FROM v_call UNION ALL SELECT dst, ts FROM v_call) GROUP BY n), c AS (SELECT k, b.t, (SELECT count(*) FROM f WHERE f.t <= b.t) AS nodes FROM b), g AS (SELECT *, lag(nodes) OVER (ORDER BY k) AS prev FROM c)"""


@query(f"WITH {TOPOLOGY} SELECT t AS ts, nodes, nodes - prev AS change FROM g WHERE prev > 0 AND abs(nodes - prev) > prev * 0.1", ("v_call",))
def win_topology_changes(spark, sf):
    """WIN-21: buckets whose number of nodes jumps by more than a tenth."""
    return rankings.topology_changes(calls(spark, sf), 15)


@query("""WITH t AS (SELECT date_trunc('second', ts) AS t, src, dst FROM v_call), m AS (SELECT t AS mid FROM t ORDER BY t LIMIT 1 OFFSET (SELECT count(*) // 2 FROM t))
SELECT n AS node, count(CASE WHEN t <= mid THEN 1 END) AS before, count(CASE WHEN t > mid THEN 1 END) AS after FROM (SELECT src AS n, t FROM t UNION ALL SELECT dst, t FROM t), m GROUP BY n""", ("v_call",))
def win_midpoint(spark, sf):
    """WIN-22: activity before and after the middle timestamp."""
    return rankings.midpoint_split(calls(spark, sf))


@query("SELECT node, n FROM (SELECT dst AS node, count(*) AS n FROM v_call GROUP BY 1) ORDER BY n DESC, node LIMIT 20", ("v_call",))
def top_fan_in(spark, sf):
    """TOP-02: ties by id; the 20 are the feature."""
    return rankings.top(calls(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")), ["-n", "node"], 20)


@query("""WITH d AS (SELECT node, count(*) AS degree, count(CASE WHEN NOT o THEN 1 END) / count(*)::DOUBLE AS rank FROM (SELECT src AS node, TRUE AS o FROM v_call UNION ALL SELECT dst, FALSE FROM v_call) GROUP BY node) SELECT node, degree, round(rank, 6) AS rank FROM d ORDER BY degree DESC, round(rank, 6) DESC, node LIMIT 25""", ("v_call",))
def top_activity(spark, sf):
    """TOP-05: by degree, then by the share of incoming edges; the 25 are the feature."""
    e = profiles.endpoints(calls(spark, sf))
    d = e.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.count(F.when(~F.col("outgoing"), 1)) / F.count(F.lit(1)), 6).alias("rank"))
    return rankings.top(d, ["-degree", "-rank", "node"], 25)


GAPS = """g AS (SELECT 'MISSING_TIME' AS gap_type, edge_id AS subject, 'LOW' AS severity, 0.2::DOUBLE AS impact FROM v_edge WHERE ts IS NULL UNION ALL SELECT 'MISSING_CONFIDENCE', edge_id, 'MEDIUM', 0.3::DOUBLE FROM v_edge WHERE confidence IS NULL
UNION ALL SELECT 'LOW_CONFIDENCE', edge_id, 'HIGH', 0.5::DOUBLE FROM v_edge WHERE confidence < 0.1 UNION ALL SELECT 'ISOLATED_ENTITY', id, 'MEDIUM', 0.4::DOUBLE FROM v_node WHERE id NOT IN (SELECT src FROM v_edge UNION SELECT dst FROM v_edge))"""


@query(f"WITH {GAPS} SELECT gap_type, subject, severity, impact FROM g", (*EDGE, "v_node"))
def ret_knowledge_gaps(spark, sf):
    """RET-10: what is missing of edges and nodes."""
    return rankings.knowledge_gaps(views.nodes(spark, sf), views.edges(spark, sf))


@query(f"WITH {GAPS} SELECT gap_type, subject, CAST(row_number() OVER (ORDER BY impact DESC, CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, gap_type, subject) AS BIGINT) AS place FROM g QUALIFY place <= 40", (*EDGE, "v_node"))
def top_gaps(spark, sf):
    """TOP-06: by impact, then severity; the 40 are the feature."""
    return rankings.ranked_gaps(rankings.knowledge_gaps(views.nodes(spark, sf), views.edges(spark, sf)), 40)


ACTIONS = """x AS (SELECT 'VERIFY_EDGE' AS action, edge_id AS subject, round(1 - confidence, 4) AS total FROM v_edge WHERE confidence < 0.1 UNION ALL SELECT 'INTERVIEW', node, round(n / (max(n) OVER ())::DOUBLE, 4) FROM (SELECT src AS node, count(*) AS n FROM v_edge WHERE ts IS NOT NULL GROUP BY 1)
UNION ALL SELECT 'DATE_EDGE', edge_id, 0.3::DOUBLE FROM v_edge WHERE ts IS NULL)"""


@query(f"WITH {ACTIONS} SELECT action, subject, total FROM x ORDER BY total DESC, action, subject LIMIT 12", EDGE)
def top_next_actions(spark, sf):
    """TOP-07: suggestions of several generators, the best twelve; the twelve are the feature."""
    return rankings.next_actions(views.edges(spark, sf), 12)


@query("""WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_call UNION ALL SELECT dst FROM v_call) GROUP BY 1), j AS (SELECT community, node, degree, row_number() OVER (PARTITION BY community ORDER BY degree DESC, node) AS r, count(*) OVER (PARTITION BY community) AS size FROM d JOIN v_member USING (node))
SELECT community, any_value(size) AS size, string_agg(node, ',' ORDER BY r) AS members FROM j WHERE r <= 10 GROUP BY community ORDER BY size DESC, community LIMIT 50""", ("v_call", "v_member"))
def top_graph_summary(spark, sf):
    """TOP-08: the largest communities with their ten busiest members; both limits are the feature."""
    e = profiles.endpoints(calls(spark, sf)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return rankings.community_summary(e, views.members(spark, sf), 50, 10)
