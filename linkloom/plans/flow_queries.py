"""Queries on filters, joins, aggregates and windows over the transfer and event views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import flows, graph, rankings, temporal
from linkloom.operators.intervals import band_semi_join, before_incident, seconds
from linkloom.plans.registry import query
from linkloom.sources.tables import calls, places, table, transfers

TX = ("v_tx",)
CALL = ("v_call",)
M = "CAST(round({}, 2) AS DOUBLE)"


@query("SELECT src, dst, CAST(round(sum(amount), 2) AS DOUBLE) AS total_amount, count(*) AS transaction_count, min(ts) AS first_ts, max(ts) AS last_ts FROM v_tx GROUP BY src, dst", TX)
def agg_pair_flows(spark, sf):
    """AGG-05."""
    return flows.pair_flows(transfers(spark, sf))


@query("""SELECT account, CAST(round(coalesce(sum(CASE WHEN o = 0 THEN amount END), 0), 2) AS DOUBLE) AS total_in, CAST(round(coalesce(sum(CASE WHEN o = 1 THEN amount END), 0), 2) AS DOUBLE) AS total_out,
count(DISTINCT CASE WHEN o = 0 THEN other END) AS fan_in, count(DISTINCT CASE WHEN o = 1 THEN other END) AS fan_out, count(*) AS degree
FROM (SELECT src AS account, dst AS other, amount, 1 AS o FROM v_tx UNION ALL SELECT dst, src, amount, 0 FROM v_tx) GROUP BY account""", TX)
def agg_account_inout(spark, sf):
    """AGG-06, AGG-24."""
    return flows.account_totals(transfers(spark, sf))


@query("""WITH t AS (SELECT account, least(CAST(round(sum(CASE WHEN o = 0 THEN amount END), 2) AS DOUBLE), CAST(round(sum(CASE WHEN o = 1 THEN amount END), 2) AS DOUBLE)) AS volume, sum(CASE WHEN o = 0 THEN amount END) AS i, sum(CASE WHEN o = 1 THEN amount END) AS u
 FROM (SELECT src AS account, amount, 1 AS o FROM v_tx UNION ALL SELECT dst, amount, 0 FROM v_tx) GROUP BY account),
b AS (SELECT account, volume, row_number() OVER (ORDER BY volume) - 1 AS rn, count(*) OVER () AS n FROM t WHERE i > 0 AND u > 0),
c AS (SELECT volume AS cutoff FROM b WHERE rn = least(CAST(floor(n * 0.9) AS BIGINT), n - 1))
SELECT account, volume, round(least(1.0, volume / greatest(2 * cutoff, 1.0)), 6) AS confidence FROM b, c WHERE volume >= cutoff""", TX)
def agg_pass_through(spark, sf):
    """AGG-07: order statistic by index, never interpolated."""
    return flows.pass_through(flows.account_totals(transfers(spark, sf)))


@query("SELECT account, n, greatest(1.2 * median(n) OVER (), 10.0) AS threshold FROM (SELECT account, count(*) AS n FROM (SELECT src AS account FROM v_tx UNION ALL SELECT dst FROM v_tx) GROUP BY account) QUALIFY n > greatest(1.2 * median(n) OVER (), 10.0)", TX)
def agg_busy_accounts(spark, sf):
    """AGG-08."""
    return flows.busy_accounts(transfers(spark, sf), factor=1.2)


@query("""SELECT gang, n, total_amount, round(0.02 * n + total_amount / 100000, 4) AS risk, CASE WHEN round(0.02 * n + total_amount / 100000, 4) >= 400 THEN 'CRITICAL' WHEN round(0.02 * n + total_amount / 100000, 4) >= 200 THEN 'HIGH' WHEN round(0.02 * n + total_amount / 100000, 4) >= 80 THEN 'MEDIUM' ELSE 'LOW' END AS level
FROM (SELECT c_mktsegment AS gang, count(*) AS n, CAST(round(sum(amount), 2) AS DOUBLE) AS total_amount FROM (SELECT src AS a, amount FROM v_tx UNION ALL SELECT dst, amount FROM v_tx) JOIN customer ON a = 'C:' || c_custkey GROUP BY c_mktsegment)""", TX)
def agg_risk_ladder(spark, sf):
    """AGG-02, JN-03."""
    members = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("gang"), F.concat(F.lit("C:"), "c_custkey").alias("account"))
    return flows.gang_report(members, transfers(spark, sf))


@query("SELECT c_mktsegment AS gang, count(*) AS members, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS debtors, count(CASE WHEN c_acctbal >= 5000 THEN 1 END) AS rich, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment")
def agg_gang_rollup(spark, sf):
    """AGG-01."""
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("gang")).agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("c_acctbal") < 0, 1)).alias("debtors"), F.count(F.when(F.col("c_acctbal") >= 5000, 1)).alias("rich"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT event_type, hour(ts) AS hour, count(*) AS n, grouping_id(event_type, hour(ts)) AS level FROM events GROUP BY GROUPING SETS ((event_type, hour(ts)), (event_type), ())")
def agg_grouping_sets(spark, sf):
    """AGG-10, AGG-39."""
    table(spark, sf, "events").withColumn("hour", F.hour("ts")).createOrReplaceTempView("ll_events")
    return spark.sql("SELECT event_type, hour, count(*) AS n, CAST(grouping_id(event_type, hour) AS BIGINT) AS level FROM ll_events GROUP BY GROUPING SETS ((event_type, hour), (event_type), ())")


@query("SELECT src, relation, dst, count(*) AS observation_count, min(event_id) AS first_event FROM v_call GROUP BY src, relation, dst", CALL)
def agg_triplet_collapse(spark, sf):
    """AGG-03."""
    return calls(spark, sf).groupBy("src", "relation", "dst").agg(F.count(F.lit(1)).alias("observation_count"), F.min("event_id").alias("first_event"))


@query("SELECT relation, count(*) AS n, count(DISTINCT src) AS sources FROM v_call GROUP BY relation", CALL)
def agg_relation_histogram(spark, sf):
    """AGG-04."""
    return calls(spark, sf).groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query("""SELECT 'completeness' AS dimension, round(avg(CASE WHEN text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS score FROM documents
UNION ALL SELECT 'consistency', round(avg(CASE WHEN n_chars = length(text) THEN 1.0 ELSE 0.0 END), 6) FROM documents
UNION ALL SELECT 'duplicate_risk', round(1 - CAST(count(DISTINCT md5(text)) AS DOUBLE) / count(text), 6) FROM documents
UNION ALL SELECT 'coverage', round(avg(CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def agg_quality_dims(spark, sf):
    """AGG-21."""
    d = table(spark, sf, "documents")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    one = d.agg(share(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("source").isNotNull()).alias("completeness"), share(F.col("n_chars") == F.length("text")).alias("consistency"), F.round(1 - F.countDistinct(F.md5("text")) / F.count("text"), 6).alias("duplicate_risk"))
    covered = d.select("doc_id").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").agg(share(F.col("hit").isNotNull()).alias("coverage"))
    names = ["completeness", "consistency", "duplicate_risk"]
    return one.unpivot([], names, "dimension", "score").unionByName(covered.unpivot([], ["coverage"], "dimension", "score"))


@query("SELECT event_id, relation, src, dst FROM v_call WHERE src = 'U:7' OR dst = 'U:7'", CALL)
def flt_either_endpoint(spark, sf):
    """FLT-02."""
    return calls(spark, sf).where("src = 'U:7' OR dst = 'U:7'").select("event_id", "relation", "src", "dst")


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def flt_equality(spark, sf):
    """FLT-01, FLT-04."""
    return table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_nationkey = 3").select("c_custkey", "c_name", "c_nationkey")


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def flt_pagination(spark, sf):
    """FLT-07: the page is the feature."""
    c = table(spark, sf, "customer")
    total = c.agg(F.count(F.lit(1)).alias("total"))
    return c.orderBy("c_custkey").offset(100).limit(50).join(F.broadcast(total)).select("c_custkey", "c_name", "total")  # one row


@query("SELECT relation, count(*) AS n FROM (SELECT CASE relation WHEN 'purchase' THEN 'FINANCIAL' WHEN 'click' THEN 'COMMUNICATION' WHEN 'view' THEN 'COMMUNICATION' ELSE 'SOCIAL' END AS relation FROM v_call) GROUP BY relation", CALL)
def flt_layer_classification(spark, sf):
    """FLT-14, FLT-15: relation to layer, SOCIAL by default."""
    layer = F.when(F.col("relation") == "purchase", "FINANCIAL").when(F.col("relation").isin("click", "view"), "COMMUNICATION").otherwise("SOCIAL")
    return calls(spark, sf).groupBy(layer.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT e.event_id, e.src, e.dst FROM v_call e WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE toxic = 1 AND e.src = 'U:' || l.doc_id) AND NOT EXISTS (SELECT 1 FROM labels l WHERE toxic = 1 AND e.dst = 'U:' || l.doc_id)", CALL)
def flt_masking(spark, sf):
    """FLT-16, JN-05: drops masked nodes and their edges."""
    hidden = table(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("U:"), "doc_id").alias("node"))
    e = calls(spark, sf)
    return e.join(hidden, e.src == hidden.node, "left_anti").join(hidden, e.dst == hidden.node, "left_anti").select("event_id", "src", "dst")


@query("SELECT o_orderkey, coalesce(c_name, 'C:' || o_custkey) AS name, coalesce(n_name, '?') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def jn_dimension_lookup(spark, sf):
    """JN-01: left lookup with the key as fallback."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("C:"), "o_custkey")).alias("name"), F.coalesce("n_name", F.lit("?")).alias("nation"))


@query("SELECT o_orderkey, string_agg(p_brand, ',' ORDER BY l_linenumber, p_brand, l_partkey) AS brands FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey HAVING count(*) >= 2")
def jn_array_lookup(spark, sf):
    """JN-02: keys to names in order, at least two."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    got = rows.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "p_brand", "l_partkey"))).alias("x")).where(F.size("x") >= 2)
    return got.select("o_orderkey", F.array_join(F.transform("x", lambda s: s["p_brand"]), ",").alias("brands"))


@query("SELECT count(*) AS n, count(DISTINCT a.src) AS sources FROM v_call a WHERE a.relation = 'click' AND EXISTS (SELECT 1 FROM v_call b WHERE b.relation = 'purchase' AND b.src = a.src AND abs(epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', b.ts))) <= 900)", CALL)
def jn_band_900s(spark, sf):
    """JN-07, JN-08: clicks with a purchase of the same user within 900 seconds."""
    c = calls(spark, sf)
    near = band_semi_join(c.where("relation = 'click'").select("event_id", "src", "ts"), c.where("relation = 'purchase'").select("src", "ts"), ["src"], "ts", 900)
    return near.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"))


@query("""SELECT i.event_id AS incident_id, count(*) AS n, count(DISTINCT e.event_type) AS kinds, round(sum(CAST(e.value AS DECIMAL(18,4))), 2)::DOUBLE AS total FROM events i JOIN events e ON e.user_id = i.user_id
AND epoch(date_trunc('second', e.ts)) >= epoch(date_trunc('second', i.ts)) - 86400 AND epoch(date_trunc('second', e.ts)) < epoch(date_trunc('second', i.ts)) WHERE i.event_type = 'error' GROUP BY i.event_id""")
def jn_incident_window(spark, sf):
    """JN-09: events of the user in the day before each error."""
    e = table(spark, sf, "events")
    incidents = e.where("event_type = 'error'").select(F.col("event_id").alias("incident_id"), "user_id", F.col("ts").alias("incident_ts"))
    hit = before_incident(e, incidents, "user_id", "ts", 24)
    return hit.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("kinds"), flows.money(F.sum(F.col("value").cast("decimal(18,4)"))).alias("total"))


@query("""SELECT event_id, nxt AS next_event, gap FROM (SELECT event_id, event_type, lead(event_id) OVER w AS nxt, lead(event_type) OVER w AS t2, epoch(date_trunc('second', lead(ts) OVER w)) - epoch(date_trunc('second', ts)) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE gap < 3600 AND t2 <> event_type""")
def jn_adjacent_conflict(spark, sf):
    """JN-10: consecutive events of a user less than an hour apart and of another kind."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumns({"next_event": F.lead("event_id").over(w), "t2": F.lead("event_type").over(w), "gap": (seconds(F.lead("ts").over(w)) - seconds("ts")).cast("double")})
    return e.where("gap < 3600 AND t2 <> event_type").select("event_id", "next_event", "gap")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) AND a.event_id < b.event_id AND a.event_type <> b.event_type")
def jn_simultaneous(spark, sf):
    """JN-16: the same user in the same hour with two kinds of event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"))
    return e.alias("a").join(e.alias("b"), ["user_id", "h"]).where("a.event_id < b.event_id AND a.event_type <> b.event_type").select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"))


@query("""SELECT a, b, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, relation FROM v_call WHERE relation IN ('purchase', 'error')) GROUP BY a, b HAVING count(DISTINCT relation) = 2""", CALL)
def jn_contradicting_pairs(spark, sf):
    """JN-17: unordered pairs that hold both of two contradicting relations."""
    rows = calls(spark, sf).where("relation IN ('purchase', 'error')").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sort_array(F.collect_set("relation")).alias("r"))
    return rows.where(F.size("r") == 2).select("a", "b", F.array_join("r", ",").alias("relations"))


@query("SELECT l_partkey AS entity, count(DISTINCT o_custkey % 50) AS cases FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey HAVING count(DISTINCT o_custkey % 50) >= 2")
def jn_case_reuse(spark, sf):
    """JN-20."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("l_partkey").alias("entity")).agg(F.countDistinct(F.col("o_custkey") % 50).alias("cases")).where("cases >= 2")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM v_call WHERE relation = 'click' EXCEPT SELECT src, dst FROM v_call WHERE relation = 'view')) AS only_click, (SELECT count(*) FROM (SELECT src, dst FROM v_call WHERE relation = 'click' INTERSECT SELECT src, dst FROM v_call WHERE relation = 'view')) AS in_both, (SELECT count(*) FROM (SELECT src, dst FROM v_call WHERE relation = 'click' UNION SELECT src, dst FROM v_call WHERE relation = 'view')) AS in_any", CALL)
def set_operations(spark, sf):
    """SET-01 to SET-03."""
    c = calls(spark, sf)
    a, b = (c.where(F.col("relation") == r).select("src", "dst") for r in ("click", "view"))
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a.distinct().subtract(b), "only_click").join(n(a.intersect(b), "in_both")).join(n(a.union(b).distinct(), "in_any"))


@query("""WITH h AS (SELECT user_id, date_trunc('hour', ts) AS h, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT user_id, h, sum(c) OVER (PARTITION BY user_id ORDER BY h RANGE BETWEEN CURRENT ROW AND INTERVAL 23 HOURS FOLLOWING) AS n, count(*) OVER (PARTITION BY user_id) AS starts, sum(c) OVER (PARTITION BY user_id) AS ev FROM h),
z AS (SELECT *, avg(n) OVER (PARTITION BY user_id) AS m, stddev_samp(n) OVER (PARTITION BY user_id) AS sd FROM r)
SELECT user_id, h AS window_start, CAST(n AS BIGINT) AS n, round((n - m) / sd, 6) AS z, CASE WHEN round((n - m) / sd, 6) > 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(least(1.0, round((n - m) / sd, 6) / 10), 6) AS confidence FROM z WHERE starts >= 5 AND ev >= 5 AND sd > 0 AND round((n - m) / sd, 6) > 2.5""")
def win_burst_z(spark, sf):
    """WIN-01."""
    return temporal.burst_z(table(spark, sf, "events"), "user_id", z=2.5)


@query("""WITH r AS (SELECT src, ts, lead(ts, 3) OVER (PARTITION BY src ORDER BY ts, event_id) AS u, count(*) OVER (PARTITION BY src) AS n, min(ts) OVER (PARTITION BY src) AS lo, max(ts) OVER (PARTITION BY src) AS hi FROM v_call),
s AS (SELECT src, ts, n / CAST(greatest(floor((epoch(date_trunc('second', hi)) - epoch(date_trunc('second', lo))) / 86400), 1) AS DOUBLE) AS base, 4.0 / CASE WHEN floor((epoch(date_trunc('second', u)) - epoch(date_trunc('second', ts))) / 86400) > 0 THEN floor((epoch(date_trunc('second', u)) - epoch(date_trunc('second', ts))) / 86400) ELSE 0.1 END AS rate FROM r WHERE u IS NOT NULL AND n >= 4)
SELECT src, count(*) AS windows, min(ts) AS first_start, round(max(rate), 6) AS peak_rate, round(max(base), 6) AS baseline_rate FROM s WHERE rate > 3 * base GROUP BY src""", CALL)
def win_rate4(spark, sf):
    """WIN-02."""
    return temporal.rate_of_four(calls(spark, sf), "src", ["ts", "event_id"])


@query("""WITH e AS (SELECT src AS account, ts FROM v_tx UNION ALL SELECT dst, ts FROM v_tx), d AS (SELECT DISTINCT account, ts FROM e), g AS (SELECT account, ts, date_diff('day', lag(ts) OVER (PARTITION BY account ORDER BY ts), ts) AS gap FROM d),
f AS (SELECT g.account, g.ts, g.gap, count(*) AS n FROM g JOIN e ON e.account = g.account AND e.ts >= g.ts AND e.ts < g.ts + INTERVAL 7 DAYS WHERE g.gap >= 30 GROUP BY 1, 2, 3)
SELECT account, ts AS reactivated, gap AS gap_days, n, round(least(0.9, gap / 90.0), 6) AS confidence FROM f WHERE n >= 3""", TX)
def win_dormant(spark, sf):
    """WIN-03."""
    tx = transfers(spark, sf)
    return temporal.dormant(tx.select(F.explode(F.array("src", "dst")).alias("account"), "ts"), "account")


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS entities, count(*) AS n, round(least(0.8, count(DISTINCT user_id) / 10.0), 6) AS confidence FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 5")
def win_sync_hour(spark, sf):
    """WIN-04."""
    return temporal.synchronized_hours(table(spark, sf, "events"), "user_id")


@query("WITH w AS (SELECT strftime(ts, '%Y-%W') AS week, count(*) AS n FROM v_tx GROUP BY 1) SELECT week, n, round(avg(n) OVER (), 6) AS weekly_mean FROM w QUALIFY n > 1.15 * avg(n) OVER ()", TX)
def win_week_cluster(spark, sf):
    """WIN-05."""
    return temporal.busy_weeks(transfers(spark, sf), factor=1.15)


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS c FROM v_tx GROUP BY 1), r AS (SELECT day, max(day) OVER w AS until, CAST(sum(c) OVER w AS BIGINT) AS n, avg(c) OVER () AS m FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))
SELECT day, until, n, round(m, 6) AS daily_mean FROM r WHERE n >= 5 AND n > 1.05 * 7 * m""", TX)
def win_rows7(spark, sf):
    """WIN-06."""
    return flows.row_window_bursts(transfers(spark, sf), factor=1.05)


@query("""WITH e AS (SELECT src AS account, ts, amount, 1 AS o FROM v_tx UNION ALL SELECT dst, ts, amount, 0 FROM v_tx),
r AS (SELECT account, ts, count(CASE WHEN o = 0 THEN 1 END) OVER w AS n_in, count(CASE WHEN o = 1 THEN 1 END) OVER w AS n_out, sum(CASE WHEN o = 0 THEN amount END) OVER w AS s_in, sum(CASE WHEN o = 1 THEN amount END) OVER w AS s_out FROM e WINDOW w AS (PARTITION BY account ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 60 DAYS FOLLOWING)),
f AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY ts) AS rn FROM r WHERE n_in >= 5 AND n_out >= 5), g AS (SELECT *, round(abs(1 - CAST(s_out AS DOUBLE) / greatest(CAST(s_in AS DOUBLE), 1.0)), 6) AS ret FROM f WHERE rn = 1)
SELECT account, ts AS window_start, n_in, n_out, CAST(round(s_in + s_out, 2) AS DOUBLE) AS total_amount, ret AS retention, CASE WHEN ret < 0.05 THEN 'HIGH' WHEN ret < 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(greatest(0.0, least(1.0, 1 - 5 * ret)), 6) AS confidence FROM g""", TX)
def win_layering(spark, sf):
    """WIN-07."""
    return flows.layering(transfers(spark, sf), days=60)


@query("""WITH r AS (SELECT dst, ts, count(*) OVER w AS n, sum(amount) OVER w AS total FROM v_tx WHERE amount < 20000 WINDOW w AS (PARTITION BY dst ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 30 DAYS FOLLOWING)),
f AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY ts) AS rn FROM r WHERE n >= 3 AND total > 60000)
SELECT dst, ts AS window_start, n, CAST(round(total, 2) AS DOUBLE) AS total_amount, CASE WHEN total > 100000 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, round(least(1.0, CAST(round(total, 2) AS DOUBLE) / 60000), 6) AS confidence FROM f WHERE rn = 1""", TX)
def win_smurf(spark, sf):
    """WIN-08."""
    return flows.smurfing(transfers(spark, sf), threshold=20000, days=30)


@query("""WITH m AS (SELECT epoch(date_trunc('second', max(ts))) AS now FROM events), r AS (SELECT user_id, count(CASE WHEN now - epoch(date_trunc('second', ts)) BETWEEN 0 AND 604800 THEN 1 END) AS recent, count(CASE WHEN now - epoch(date_trunc('second', ts)) BETWEEN 604800 AND 2592000 THEN 1 END) AS before FROM events, m GROUP BY user_id)
SELECT user_id, recent, before, round((recent / 7.0) / (before / 23.0), 6) AS ratio, CASE WHEN round((recent / 7.0) / (before / 23.0), 6) > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM r WHERE before >= 3 AND round((recent / 7.0) / (before / 23.0), 6) > 1.2""")
def win_velocity(spark, sf):
    """WIN-09."""
    return temporal.velocity(table(spark, sf, "events"), "user_id", factor=1.2)


@query("SELECT node, day, CAST(sum(c) OVER (PARTITION BY node ORDER BY day) AS BIGINT) AS degree FROM (SELECT node, CAST(ts AS DATE) AS day, count(*) AS c FROM (SELECT src AS node, ts FROM v_call UNION ALL SELECT dst, ts FROM v_call) GROUP BY 1, 2)", CALL)
def win_cumdeg(spark, sf):
    """WIN-10."""
    return temporal.cumulative_degree(calls(spark, sf))


@query("WITH s AS (SELECT epoch(date_trunc('second', ts)) AS t FROM events), m AS (SELECT min(t) AS lo, max(t) AS hi FROM s) SELECT CAST(least(11, floor((t - lo) * 12.0 / (hi - lo))) AS BIGINT) AS bucket, count(*) AS n FROM s, m GROUP BY 1")
def win_buckets(spark, sf):
    """WIN-11, WIN-12: twelve equal buckets over the time range."""
    e = table(spark, sf, "events").select(seconds("ts").alias("t"))
    m = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return e.join(F.broadcast(m)).groupBy(F.least(F.lit(11), F.floor((F.col("t") - F.col("lo")) * 12.0 / (F.col("hi") - F.col("lo")))).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query("""WITH r AS (SELECT src, count(CASE WHEN a > 864000 AND a <= 1728000 THEN 1 END) AS previous, count(CASE WHEN a BETWEEN 0 AND 864000 THEN 1 END) AS current FROM (SELECT src, epoch(TIMESTAMP '2024-01-30 00:00:00') - epoch(date_trunc('second', ts)) AS a FROM v_call) GROUP BY src),
d AS (SELECT *, CASE WHEN previous > 0 THEN round(100.0 * (current - previous) / previous, 4) END AS delta_percent FROM r), z AS (SELECT *, abs(coalesce(delta_percent, CASE WHEN current > 0 THEN 100.0 ELSE 0.0 END)) AS size FROM d)
SELECT src, previous, current, delta_percent, CASE WHEN size >= 300 THEN 'CRITICAL' WHEN size >= 150 THEN 'HIGH' WHEN size >= 75 THEN 'MEDIUM' WHEN size >= 25 THEN 'LOW' ELSE 'NONE' END AS level FROM z""", CALL)
def win_period_change(spark, sf):
    """WIN-14."""
    return temporal.period_change(calls(spark, sf), "src", "ts", "2024-01-30 00:00:00", 10)


@query("""WITH e AS (SELECT src AS node, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS t FROM v_call UNION ALL SELECT dst, CAST(epoch(date_trunc('second', ts)) AS BIGINT) FROM v_call), g AS (SELECT node, t, t - lag(t) OVER (PARTITION BY node ORDER BY t) AS gap FROM e)
SELECT node, count(*) AS n, min(t) AS first_s, max(t) AS last_s, round(count(*) / greatest((max(t) - min(t)) / 86400.0, 1.0), 6) AS per_day, round(CASE WHEN avg(gap) > 0 THEN coalesce(stddev_samp(gap), 0.0) / avg(gap) ELSE 0.0 END, 4) AS burstiness FROM g GROUP BY node""", CALL)
def agg_node_temporal(spark, sf):
    """AGG-13."""
    return temporal.node_features(calls(spark, sf))


@query("SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS rank, round(cume_dist() OVER (ORDER BY n), 6) AS share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def win_ranking(spark, sf):
    """WIN-16, AGG-37: users ranked by their number of events."""
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rankings.ranked(n, "user_id", "n")


@query("SELECT src, dst, CAST(round(sum(amount), 2) AS DOUBLE) AS total_amount FROM v_tx GROUP BY src, dst ORDER BY sum(amount) DESC, src, dst LIMIT 200", TX)
def top_flows(spark, sf):
    """TOP-01, TOP-04: the top 200 is the feature."""
    flow = transfers(spark, sf).groupBy("src", "dst").agg(F.sum("amount").alias("s"))
    return flow.orderBy(F.desc("s"), "src", "dst").limit(200).select("src", "dst", flows.money(F.col("s")).alias("total_amount"))


@query("SELECT node, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT src AS node, ts FROM v_call UNION ALL SELECT dst, ts FROM v_call) GROUP BY node", CALL)
def win_first_seen(spark, sf):
    """WIN-20."""
    return calls(spark, sf).select(F.explode(F.array("src", "dst")).alias("node"), "ts").groupBy("node").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT node, in_degree, out_degree, degree, round(CAST(degree AS DOUBLE) / greatest(count(*) OVER () - 1, 1), 9) AS centrality FROM (SELECT node, sum(1 - o) AS in_degree, sum(o) AS out_degree, count(*) AS degree FROM (SELECT src AS node, 1 AS o FROM v_call UNION ALL SELECT dst, 0 FROM v_call) GROUP BY node)", CALL)
def grf_degree(spark, sf):
    """AGG-11, GRF-02."""
    return graph.degrees(calls(spark, sf))


@query("SELECT relation, count(*) AS n FROM v_call WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY relation UNION ALL SELECT 'LOCATED_IN', count(*) FROM v_loc", ("v_call", "v_loc"))
def grf_snapshot(spark, sf):
    """GRF-24, JN-11: edges without a time are always visible."""
    e = calls(spark, sf).select("relation", "src", "dst", "ts").unionByName(places(spark, sf).select(F.lit("LOCATED_IN").alias("relation"), "src", "dst", F.lit(None).cast("timestamp_ntz").alias("ts")))
    return graph.as_of(e, "2024-01-15 00:00:00").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT src, dst, min(ts) AS first_ts FROM v_call GROUP BY src, dst HAVING min(ts) > TIMESTAMP '2024-01-10 00:00:00' AND min(ts) <= TIMESTAMP '2024-01-20 00:00:00'", CALL)
def grf_delta(spark, sf):
    """GRF-27, SET-02."""
    return graph.delta(calls(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00")


@query("WITH RECURSIVE w(node, level) AS (SELECT 'U:1', 0 UNION SELECT adj.v, w.level + 1 FROM w JOIN adj ON adj.u = w.node WHERE w.level < 2) SELECT node, min(level) AS level FROM w GROUP BY node", ("v_call", "pairs", "adj"))
def grf_khop(spark, sf):
    """GRF-04."""
    return graph.k_hop(calls(spark, sf), "U:1", 2)


@query("SELECT dst AS node, count(*) AS edges, count(DISTINCT src) AS counterparties FROM v_tx GROUP BY dst HAVING count(*) >= 3", TX)
def grf_fan_in(spark, sf):
    """GRF-32."""
    return graph.fan(transfers(spark, sf), "dst")


@query("WITH d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM v_tx UNION ALL SELECT dst FROM v_tx) GROUP BY node) SELECT node, degree, round(avg(degree) OVER () + 2 * stddev_samp(degree) OVER (), 6) AS threshold FROM d QUALIFY degree >= avg(degree) OVER () + 2 * stddev_samp(degree) OVER () AND degree >= 5", TX)
def grf_hubs(spark, sf):
    """GRF-29."""
    return graph.hubs(transfers(spark, sf))


@query("WITH RECURSIVE e AS (SELECT src AS u, dst AS v FROM v_loc UNION SELECT dst, src FROM v_loc), r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u WHERE e.v < r.u OR e.v LIKE 'N:%' OR e.v LIKE 'R:%') SELECT u AS node, least(u, min(v)) AS component FROM r GROUP BY u", ("v_loc",))
def grf_components(spark, sf):
    """GRF-12."""
    return graph.components(places(spark, sf))


@query("""WITH d AS (SELECT u, count(*) AS d FROM adj GROUP BY u), s AS (SELECT a.v AS x, b.v AS y, count(*) AS common, sum(CASE WHEN d.d > 1 THEN 1 / ln(d.d) END) AS aa, sum(1.0 / d.d) AS ra FROM adj a JOIN adj b ON a.u = b.u AND a.v < b.v JOIN d ON d.u = a.u GROUP BY 1, 2)
SELECT x, y, common, round(common / CAST(dx.d + dy.d - common AS DOUBLE), 6) AS jaccard, round(aa, 6) AS adamic_adar, round(ra, 6) AS resource_allocation, dx.d * dy.d AS preferential, p.a IS NOT NULL AS linked FROM s JOIN d dx ON dx.u = x JOIN d dy ON dy.u = y LEFT JOIN pairs p ON p.a = x AND p.b = y""", ("v_call", "pairs", "adj"))
def grf_linkpred(spark, sf):
    """GRF-42 without Katz, JN-06."""
    return graph.link_scores(calls(spark, sf))


@query("WITH RECURSIVE p(path, last, hops) AS (SELECT ['U:1', dst], dst, 1 FROM (SELECT DISTINCT src, dst FROM v_call WHERE relation = 'error') WHERE src = 'U:1' UNION ALL SELECT list_append(path, dst), dst, hops + 1 FROM p JOIN (SELECT DISTINCT src, dst FROM v_call WHERE relation = 'error') e ON e.src = p.last WHERE hops < 3 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, hops, last AS end FROM p", CALL)
def grf_paths(spark, sf):
    """GRF-05, GRF-38 in part: directed simple paths of up to three hops on the error relation, without targets, amounts or revisits."""
    return graph.paths(calls(spark, sf).where("relation = 'error'"), "U:1", 3)


@query("WITH e AS (SELECT DISTINCT src, dst FROM v_call WHERE relation = 'error') SELECT a.src || '>' || a.dst || '>' || b.dst AS cycle, 3 AS nodes FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst", CALL)
def grf_rings(spark, sf):
    """GRF-33 in part: three nodes, on the error relation."""
    return graph.cycles(calls(spark, sf).where("relation = 'error'"), 3)


@query("WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM v_call), p(path, last, hops) AS (SELECT ['U:1', dst], dst, 1 FROM e WHERE src = 'U:1' UNION ALL SELECT list_append(path, dst), dst, hops + 1 FROM p JOIN e ON e.src = p.last WHERE hops < 3 AND NOT list_contains(path, dst)) SELECT array_to_string(path, '>') AS path, hops, last AS end FROM p", CALL)
def grf_paths_all(spark, sf):
    """GRF-05, GRF-38 in part: as grf_paths, over all relations."""
    return graph.paths(calls(spark, sf), "U:1", 3)


@query("WITH e AS (SELECT DISTINCT src, dst FROM v_call) SELECT a.src || '>' || a.dst || '>' || b.dst AS cycle, 3 AS nodes FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst", CALL)
def grf_rings_all(spark, sf):
    """GRF-33 in part: three nodes, over all relations."""
    return graph.cycles(calls(spark, sf), 3)


@query()
def grf_rings_lengths(spark, sf):
    """GRF-33, 3 to 6 nodes, on the error relation. No oracle: tested by brute force."""
    return graph.rings(calls(spark, sf).where("relation = 'error'"))


@query("WITH e AS (SELECT DISTINCT src, dst FROM v_tx) SELECT a.src || '>' || a.dst AS cycle, 2 AS nodes FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst", TX)
def grf_cycles(spark, sf):
    """GRF-37, GRF-40 in part: two accounts, without amounts."""
    return graph.cycles(transfers(spark, sf), 2)


def _nations(spark, sf):
    return table(spark, sf, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("node"), F.col("c_nationkey").alias("community")).unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("S:"), "s_suppkey"), F.col("s_nationkey")).toDF("node", "community"))


MEMBER = "m AS (SELECT 'C:' || c_custkey AS node, c_nationkey AS community FROM customer UNION ALL SELECT 'S:' || s_suppkey, s_nationkey FROM supplier)"


@query(f"""WITH {MEMBER}, t AS (SELECT a.community AS cs, b.community AS cd FROM v_tx JOIN m a ON a.node = src JOIN m b ON b.node = dst), e AS (SELECT cs AS community, CASE WHEN cs = cd THEN 1 ELSE 0 END AS i FROM t UNION ALL SELECT cd, 0 FROM t WHERE cs <> cd)
SELECT s.community, s.members, coalesce(internal_edges, 0) AS internal_edges, coalesce(external_edges, 0) AS external_edges, round(coalesce(internal_edges, 0) / CAST(greatest(members * (members - 1), 1) AS DOUBLE), 9) AS density
FROM (SELECT community, count(*) AS members FROM m GROUP BY 1) s LEFT JOIN (SELECT community, sum(i) AS internal_edges, sum(1 - i) AS external_edges FROM e GROUP BY 1) c ON c.community = s.community""", TX)
def agg_community_profile(spark, sf):
    """AGG-17 with nations as communities."""
    return graph.community_profile(transfers(spark, sf), _nations(spark, sf))


@query(f"""WITH {MEMBER}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM v_tx GROUP BY 1, 2), e AS (SELECT a AS u, b AS v, w FROM p UNION ALL SELECT b, a, w FROM p), c AS (SELECT x.community AS cu, sum(CASE WHEN x.community = y.community THEN w ELSE 0 END) AS inside, sum(w) AS degree FROM e JOIN m x ON x.node = u JOIN m y ON y.node = v GROUP BY 1), t AS (SELECT CAST(sum(degree) AS DOUBLE) AS m2 FROM c)
SELECT round(sum(inside / m2 - pow(degree / m2, 2)), 6) AS modularity FROM c, t""", TX)
def grf_modularity(spark, sf):
    """GRF-13."""
    return graph.modularity(transfers(spark, sf), _nations(spark, sf))


@query("""WITH p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS w FROM v_call GROUP BY 1, 2), e AS (SELECT a AS u, b AS v, w FROM p UNION ALL SELECT b, a, w FROM p), t AS (SELECT u, sum(w) AS t FROM e GROUP BY u), q AS (SELECT e.u, e.v, w / CAST(t AS DOUBLE) AS p FROM e JOIN t ON t.u = e.u),
h AS (SELECT a.u, b.v, sum(a.p * b.p) AS q FROM q a JOIN q b ON a.v = b.u WHERE a.u <> b.v GROUP BY 1, 2) SELECT q.u AS node, round(sum(pow(q.p + coalesce(h.q, 0), 2)), 6) AS "constraint", count(*) AS degree FROM q LEFT JOIN h ON h.u = q.u AND h.v = q.v GROUP BY q.u""", CALL)
def grf_structural_holes(spark, sf):
    """GRF-10 in part: the constraint."""
    return graph.structural_holes(calls(spark, sf))


def _pagerank_sql(rounds: int) -> str:
    head = """WITH pr AS (SELECT src, dst, count(*) AS w FROM v_call GROUP BY 1, 2), o AS (SELECT src, sum(w) AS t FROM pr GROUP BY 1), s AS (SELECT pr.src, dst, w / CAST(t AS DOUBLE) AS p FROM pr JOIN o ON o.src = pr.src),
n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM pr UNION ALL SELECT dst FROM pr)), c AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM n), r0 AS (SELECT node, 1 / k AS rank FROM n, c)"""
    for i in range(1, rounds + 1):
        head += f""", r{i} AS (SELECT n.node, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node NOT IN (SELECT src FROM o)) / k) + 0.15 / k AS rank FROM n CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank * p) AS got FROM r{i - 1} JOIN s ON s.src = r{i - 1}.node GROUP BY dst) g ON g.dst = n.node)"""
    return f"{head} SELECT node, round(rank, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(5), CALL)
def grf_pagerank_k(spark, sf):
    """GRF-07 for five iterations."""
    return graph.pagerank(calls(spark, sf), 5).select("node", F.round("rank", 6).alias("rank"))
