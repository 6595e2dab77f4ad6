"""Queries on entity resolution. Edit distance is passed as the name similarity where an oracle is to follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import names
from linkloom.functions import text as T
from linkloom.operators import resolution
from linkloom.plans.registry import query
from linkloom.plans.scalar_queries import _fold_sql
from linkloom.sources.tables import table

LEV = "round(1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE), 6)"
SHARED = f"""n AS (SELECT p_name AS n, min(p_partkey) AS k FROM part GROUP BY 1), w AS (SELECT n, unnest(list_distinct(string_split(n, ' '))) AS w FROM n), p AS (SELECT DISTINCT a.n AS x, b.n AS y FROM w a JOIN w b ON a.w = b.w AND a.n < b.n),
s AS (SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b, {LEV.format('x', 'y')} AS similarity FROM p JOIN n a ON a.n = x JOIN n b ON b.n = y)"""


def _lev(a, b):
    return F.round(T.levenshtein_similarity(a, b), 6)


@query(f"WITH {SHARED} SELECT a, b, similarity FROM s WHERE similarity >= 0.4 AND similarity < 0.6 ORDER BY similarity DESC, a, b LIMIT 200")
def er_review_band(spark, sf):
    """ENT-06: the 200 most similar pairs below a cluster; the 200 are the feature. The band is wide, as the parts' names differ by whole words."""
    return resolution.review_pairs(table(spark, sf, "part"), "p_partkey", "p_name", _lev, 0.4, 0.6)


@query(f"WITH RECURSIVE {SHARED}, e AS (SELECT a, b FROM s WHERE similarity >= 0.7 UNION SELECT b, a FROM s WHERE similarity >= 0.7), r(v, u) AS (SELECT a, b FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a) SELECT p_partkey, least(n.k, coalesce((SELECT min(u) FROM r WHERE r.v = n.k), n.k)) AS cluster FROM part JOIN n ON n.n = p_name")
def er_clusters(spark, sf):
    """ENT-06: names linked at 0.7."""
    return resolution.similarity_clusters(table(spark, sf, "part"), "p_partkey", "p_name", _lev, 0.7)


@query()
def er_name_matches(spark, sf):
    """ENT-02, ENT-03, SCL-15: full name comparison within blocks. No oracle: alignment and ratio are not SQL; unit tests."""
    n = table(spark, sf, "part").select("p_partkey", "p_name", F.lit("PERSON").alias("kind"))
    return resolution.name_matches(resolution.blocked_pairs(n, "p_partkey", "p_name", "kind"))


@query()
def er_greedy(spark, sf):
    """ENT-07: order decides, so there is no oracle; unit tests."""
    return resolution.greedy_canonical(table(spark, sf, "part"), "p_partkey", "p_name", lambda a, b: names.compare(a, b)[0], 0.7)


@query(f"""WITH n AS (SELECT p_size AS c, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, len(string_split(name, ' ')) DESC, length(name) DESC, name) AS r FROM n),
t AS (SELECT p_size AS c, p_type AS t, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1, 2), b AS (SELECT c, max(CASE WHEN r = 1 THEN name END) AS canonical, count(*) AS names, CAST(sum(n) AS BIGINT) AS mentions FROM r GROUP BY c)
SELECT b.c AS p_size, canonical, names, mentions, t.t AS entity_type, 'E-' || substr(sha256(upper(t.t) || '|' || {_fold_sql('canonical')} || '||'), 1, 16) AS guid FROM b JOIN t ON t.c = b.c AND t.r = 1""")
def er_canonical(spark, sf):
    """ENT-05, AGG-30, SCL-20: one entity a cluster; sizes stand for clusters."""
    return resolution.canonical_entities(table(spark, sf, "part"), "p_size", "p_name", "p_type")


def _people(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    digits = lambda n: F.concat(F.lit("98"), F.lpad((k % n).cast("string"), 8, "0"))
    text = lambda c: F.array(c.cast("string"))
    return c.select(k.alias("id"), F.when(k % 50 == 0, "ORGANIZATION").otherwise("PERSON").alias("entity_type"), F.concat(F.lit("Mr. "), F.col("c_mktsegment"), F.lit(" Person"), k % 30).alias("name"), F.when(k % 3 == 0, digits(400)).alias("phone"), F.concat(F.lit("P"), k % 90, F.lit("@X.org ")).alias("email"),
                    F.concat(F.lit("Block "), k % 20, F.lit(" hill")).alias("address"), F.concat(F.lit("Firm "), k % 10).alias("organization"), text(k % 350).alias("identifiers"), text(k % 5).alias("events"), text(k % 4).alias("locations"), F.array().cast("array<string>").alias("contacts"), text(k % 2).alias("neighbours"))


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'O' ELSE 'P' END AS t, lower(c_mktsegment) || ' person' || (c_custkey % 30) AS name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 400 END AS phone, c_custkey % 90 AS email, c_custkey % 20 AS addr, c_custkey % 10 AS org, c_custkey % 350 AS ident, c_custkey % 5 AS ev, c_custkey % 4 AS loc, c_custkey % 2 AS nb FROM customer),
p AS (SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.phone = b.phone AND a.id < b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.email = b.email AND a.id < b.id UNION SELECT a.id, b.id FROM r a JOIN r b ON a.ident = b.ident AND a.id < b.id),
f AS (SELECT p.a, p.b, x.t = y.t AS typed, x.name = y.name AS named, coalesce(x.phone = y.phone, FALSE) AS phoned, x.ident = y.ident AS same_id, 0.35::DOUBLE * (1 - levenshtein(x.name, y.name) / CAST(greatest(length(x.name), length(y.name)) AS DOUBLE)) + CASE WHEN x.phone = y.phone THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN x.email = y.email THEN 0.1::DOUBLE ELSE 0 END
 + 0.05::DOUBLE * CASE WHEN x.addr = y.addr THEN 1 ELSE 2 / 4.0::DOUBLE END + 0.05::DOUBLE * CASE WHEN x.org = y.org THEN 1 ELSE 1 / 3.0::DOUBLE END + CASE WHEN x.ident = y.ident THEN 0.1::DOUBLE ELSE 0 END + 0.1::DOUBLE * (((x.ev = y.ev)::INT + (x.loc = y.loc)::INT + 1) / 3.0::DOUBLE) + CASE WHEN x.nb = y.nb THEN 0.1::DOUBLE ELSE 0 END AS s FROM p JOIN r x ON x.id = p.a JOIN r y ON y.id = p.b),
g AS (SELECT *, s AS s0 FROM f), h AS (SELECT *, CASE WHEN same_id OR phoned OR named THEN greatest(s0, 0.83::DOUBLE) ELSE s0 END AS s1 FROM g), i AS (SELECT *, CASE WHEN named AND NOT phoned THEN greatest(s1, 0.85::DOUBLE) ELSE s1 END AS s2 FROM h), j AS (SELECT *, CASE WHEN phoned THEN least(1, s2 + 0.15::DOUBLE) ELSE s2 END AS s3 FROM i),
k AS (SELECT a AS left_id, b AS right_id, CASE WHEN typed THEN CAST(round(CAST(s3 AS DECIMAL(24,10)), 4) AS DOUBLE) ELSE 0.0::DOUBLE END AS score FROM j) SELECT *, CASE WHEN score >= 0.78 THEN 'MATCH' WHEN score >= 0.55 THEN 'POSSIBLE_MATCH' WHEN score >= 0.2 THEN 'UNKNOWN' ELSE 'NON_MATCH' END AS decision FROM k""")
def er_hybrid(spark, sf):
    """ENT-08, JN-13, UDF-01: records compared by all their parts, names by edit distance."""
    p = _people(spark, sf)
    keys = [F.concat(F.lit("p"), "phone"), F.concat(F.lit("e"), "email"), F.concat(F.lit("i"), F.get("identifiers", F.lit(0)))]
    return resolution.hybrid_blocks(p, keys, T.levenshtein_similarity)


@query("""WITH a AS (SELECT c_custkey AS k FROM customer) SELECT k AS c_custkey, CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 1.0::DOUBLE END AS similarity FROM a""")
def er_aliases(spark, sf):
    """ENT-09: two spellings of a phone, a vehicle, an email or an address."""
    k = F.col("c_custkey")
    n = F.lpad(k.cast("string"), 8, "0")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    a = F.when(k % 4 == 0, say("+91 98", n)).when(k % 4 == 1, say("tn-", F.lpad((k % 90).cast("string"), 2, "0"), "-ab-", F.substring(n, 5, 4))).when(k % 4 == 2, say("P", k.cast("string"), "@x.org")).otherwise(say(k.cast("string"), " Hill Road, Newham"))
    b = F.when(k % 4 == 0, say("098", n)).when(k % 4 == 1, say("TN", F.lpad((k % 90).cast("string"), 2, "0"), " AB ", F.substring(n, 5, 4))).when(k % 8 == 2, say(" p", k.cast("string"), "@X.ORG")).when(k % 4 == 2, F.lit("other@x.org")).otherwise(F.lit("newham hill st"))
    kind = F.when(k % 4 == 0, "phone").when(k % 4 == 1, "vehicle").when(k % 4 == 2, "email").otherwise("address")
    return table(spark, sf, "customer").select("c_custkey", resolution.alias_similarity(a, b, kind).alias("similarity"))


@query("""SELECT 'E-' || substr(sha256('PERSON|' || x || '||'), 1, 16) AS old_guid, 'E-' || substr(sha256('PERSON|' || x || '||' || lpad(CAST(c_custkey AS VARCHAR), 10, '9')), 1, 16) AS new_guid FROM (SELECT c_custkey, replace(replace(replace(lower(c_name), 'o', 'o'), 'k', 'k'), 'c', 'c') AS x FROM customer)""")
def er_guid_migration(spark, sf):
    """ENT-10: ids of people before and after their phone is part of them."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("dob"), F.lpad(F.col("c_custkey").cast("string"), 10, "9").alias("phone"))
    person = F.lit("PERSON")
    old = c.withColumn("guid", resolution.stable_id(person, F.col("name")))
    return resolution.migration(old, c.withColumn("guid", resolution.stable_id(person, F.col("name"), phone=F.col("phone"))))


@query("""WITH m AS (SELECT user_id % 20 AS entity, 'U:' || user_id AS name, 'D' || (event_id % 300) AS document, 'K' || (event_id % 7) AS c, CASE WHEN event_id % 2 = 0 THEN '9' || (user_id % 3) END AS phone FROM events)
SELECT entity, array_to_string(list_sort(list(DISTINCT name)), ',') AS aliases, coalesce(array_to_string(list_sort(list(DISTINCT phone) FILTER (phone IS NOT NULL)), ','), '') AS phones, count(DISTINCT document) AS documents, array_to_string(list_sort(list(DISTINCT c)), ',') AS cases FROM m GROUP BY 1""")
def er_entity_context(spark, sf):
    """ENT-11: what is known of an entity across documents and cases."""
    e = table(spark, sf, "events")
    m = e.select((F.col("user_id") % 20).alias("entity"), F.concat(F.lit("U:"), "user_id").alias("name"), F.concat(F.lit("D"), F.col("event_id") % 300).alias("document"), F.concat(F.lit("K"), F.col("event_id") % 7).alias("case_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("9"), F.col("user_id") % 3)).alias("phone"))
    return resolution.entity_context(m)
