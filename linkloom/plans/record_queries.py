"""Queries on text, records, vectors, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import records
from linkloom.plans.registry import query
from linkloom.sources.tables import table

FP = "sha256(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))"


@query(f"WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {FP}) AS first FROM documents) SELECT doc_id, doc_id <> first AS is_duplicate, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM f")
def txt_fingerprint_dups(spark, sf):
    """SET-05, SCL-02, TXT-01."""
    return records.exact_duplicates(table(spark, sf, "documents"), "text", "doc_id")


def _modality_sql() -> str:
    """The cues again, spelled out."""
    unsure = "may|might|could|possibly|potentially|apparently|allegedly|reportedly|supposedly|purportedly|likely|unlikely|probable|improbable|plausible|implausible|conjecture|uncertain|unclear|unknown|ambiguous|vague|inconclusive|believed|thought to be|understood to be"
    no = "not|never|no|none|nothing|nowhere|neither|nor|didn''t|doesn''t|don''t|wasn''t|weren''t|isn''t|aren''t|denied|denies|denial|refuted|refutes|refutation|contradicted|contradicts|contradiction|lacked|lacks|lack of|absence of|without|free from|clear of"
    cases = (("DENIED", "denied|denies|denial|refuted|refutes"), ("ALLEGED", "alleged|alleges|allegation"), ("REPORTED", "according to|as per|based on|stated by|reported by|told by|said by|(witness|source|informant|official|document|record)[ \\t\\n\\r]+(stated|said|reported|claimed|alleged)"), ("SUSPECTED", "suspected|suspicion|hypothesis|speculation"), ("UNCERTAIN", unsure))
    ladder = " ".join(f"WHEN regexp_matches(lower(text), '\\b({p})\\b') THEN '{label}'" for label, p in cases)
    return f"SELECT modality, negated, count(*) AS n FROM (SELECT CASE {ladder} ELSE 'FACTUAL' END AS modality, regexp_matches(lower(text), '\\b({no})\\b') AS negated FROM conversations) GROUP BY 1, 2"


@query(_modality_sql())
def txt_modality(spark, sf):
    """SCL-26, SCL-25."""
    c = table(spark, sf, "conversations")
    return c.groupBy(T.modality(F.col("text")).alias("modality"), T.negated(F.col("text")).alias("negated")).agg(F.count(F.lit(1)).alias("n"))


TERMS = ["tion", "the", "and", "that", "with", "thing", "other"]


@query(f"SELECT doc_id, len(list_intersect(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'), {TERMS})) AS score FROM documents QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 50 AND score > 0")
def txt_search(spark, sf):
    """RET-02: the top 50 is the feature."""
    return records.keyword_search(table(spark, sf, "documents"), "text", "doc_id", TERMS, 50)


def _first_vector(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


@query("WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 20")
def vec_topk(spark, sf):
    """RET-04, SCL-33: the top 20 is the feature."""
    return records.cosine_top_k(table(spark, sf, "embeddings"), "vec_id", "embedding", _first_vector(spark, sf), 20)


@query(r"""WITH n AS (SELECT p_name AS n, min(p_partkey) AS k, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part GROUP BY p_name), b AS (SELECT *, w[1][1] || '|' || w[len(w)][1] || '|' || len(w) AS b FROM n)
SELECT x.k AS a, y.k AS b, round(1 - levenshtein(x.n, y.n) / CAST(greatest(length(x.n), length(y.n)) AS DOUBLE), 6) AS similarity FROM b x JOIN b y ON x.b = y.b AND x.n < y.n WHERE round(1 - levenshtein(x.n, y.n) / CAST(greatest(length(x.n), length(y.n)) AS DOUBLE), 6) >= 0.7""")
def er_lev_pairs(spark, sf):
    """ENT-02, ENT-03 (edit distance), SCL-12, JN-12."""
    return records.name_pairs(table(spark, sf, "part"), "p_name", "p_partkey", 0.7)


@query("SELECT p_brand AS kind, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS norm, min(p_partkey) AS canonical, count(*) AS mentions, count(DISTINCT p_type) AS aliases FROM part GROUP BY 1, 2")
def er_resolve(spark, sf):
    """ENT-01, AGG-30."""
    return records.resolve(table(spark, sf, "part"), "p_type", "p_brand", "p_partkey")


SCORE = "least(0.999999, (n_chars % 1000) / 1000.0)"


@query(f"WITH s AS (SELECT {SCORE} AS score, quality AS label FROM documents JOIN labels USING (doc_id)) SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS positive_share, round(abs(round(avg(score), 6) - round(avg(label), 6)), 6) AS gap FROM s GROUP BY 1")
def ml_calibration_bins(spark, sf):
    """AGG-36, AGG-32."""
    return records.calibration_bins(_scored(spark, sf))


def _scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.least(F.lit(0.999999), (F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query(f"""WITH s AS (SELECT {SCORE} AS score, quality AS label FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(CASE WHEN score >= 0.5 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN score >= 0.5 AND label <> 1 THEN 1 END) AS fp, count(CASE WHEN score < 0.5 AND label = 1 THEN 1 END) AS fn, count(CASE WHEN score < 0.5 AND label <> 1 THEN 1 END) AS tn, round(avg(pow(score - label, 2)), 6) AS brier FROM s)
SELECT *, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall, round(2.0 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c""")
def ml_threshold_metrics(spark, sf):
    """AGG-32, AGG-34."""
    return records.threshold_metrics(_scored(spark, sf), 0.5)


@query("""WITH j AS (SELECT lang, source, count(*) AS c FROM documents GROUP BY 1, 2), t AS (SELECT c, sum(c) OVER (PARTITION BY lang) AS ca, sum(c) OVER (PARTITION BY source) AS cb, sum(c) OVER () AS n FROM j), s AS (SELECT sum(c / CAST(n AS DOUBLE) * ln(CAST(c AS DOUBLE) * n / (ca * cb))) AS mi, sum(-c / CAST(n AS DOUBLE) * ln(ca / CAST(n AS DOUBLE))) AS ha, sum(-c / CAST(n AS DOUBLE) * ln(cb / CAST(n AS DOUBLE))) AS hb FROM t) SELECT round(2 * mi / (ha + hb), 6) AS nmi FROM s""")
def eva_nmi(spark, sf):
    """AGG-33."""
    return records.normalized_mutual_information(table(spark, sf, "documents"), "lang", "source")


@query("""WITH r AS (SELECT user_id, event_type || '>' || lead(event_type, 1) OVER w || '>' || lead(event_type, 2) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT run, count(DISTINCT user_id) AS support, count(*) AS n, round(least(1e0, 0.4e0 + 0.15e0 * count(DISTINCT user_id)), 6) AS confidence FROM r WHERE run IS NOT NULL GROUP BY run HAVING count(DISTINCT user_id) >= 2""")
def mo_sequences(spark, sf):
    """GRF-54."""
    return records.sequences(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type", 3, 2)


@query("SELECT CAST(floor(c_acctbal / 500) AS BIGINT) AS x, CAST(floor(c_nationkey / 5) AS BIGINT) AS y, count(*) AS n FROM customer GROUP BY 1, 2")
def geo_grid(spark, sf):
    """GRF-55: grid cells of two coordinates."""
    return table(spark, sf, "customer").groupBy(F.floor(F.col("c_acctbal") / 500).alias("x"), F.floor(F.col("c_nationkey") / 5).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT turn, role, count(*) AS n, count(DISTINCT conv_id) AS conversations, 'E-' || substr(sha256(role || '|' || turn), 1, 16) AS evidence_id FROM conversations GROUP BY turn, role")
def ret_evidence_counts(spark, sf):
    """AGG-25, SCL-20."""
    c = table(spark, sf, "conversations").groupBy("turn", "role").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))
    return c.withColumn("evidence_id", T.short_id("E", F.concat_ws("|", "role", F.col("turn").cast("string")), 16))


@query("""WITH t AS (SELECT item_id, lower(text) AS l FROM benchmark), m AS (SELECT item_id, (contains(l, 'that and')::INT + contains(l, 'tion')::INT + contains(l, 'onesen')::INT)::INTEGER AS matches, len(regexp_extract_all(l, '\\b(no|not|never|denied|denies|refused|rejected|false|untrue|wrong|unrelated)\\b'))::INTEGER AS negations,
regexp_matches(l, '\\b(confirmed|admitted|acknowledged|verified|stated|reported|found|observed|evidence|recorded|seen|matched|called|met|transferred)\\b') AS yes FROM t)
SELECT item_id, matches, negations, CASE WHEN negations > 0 THEN 'CONTRADICTS' WHEN matches > 0 THEN 'SUPPORTS' ELSE 'UNKNOWN' END AS polarity, round(CASE WHEN negations > 0 AND matches > 0 THEN least(1, 0.4::DOUBLE + 0.2::DOUBLE * negations) WHEN negations > 0 THEN 0.3 WHEN yes AND matches > 0 THEN least(1, 0.4::DOUBLE + 0.15::DOUBLE * matches) WHEN matches > 0 THEN least(0.6::DOUBLE, 0.3::DOUBLE + 0.1::DOUBLE * matches) ELSE 0 END, 6)::DOUBLE AS strength FROM m""")
def ret_polarity(spark, sf):
    """RET-09, SCL-27."""
    return records.polarity(table(spark, sf, "benchmark"), "text", ["that and", "tion", "onesen"]).select("item_id", "matches", "negations", "polarity", "strength")


@query("SELECT event_type, user_id, n FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3")
def top_per_group(spark, sf):
    """TOP-03, SET-04: three users a kind are the feature."""
    n = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")
