"""Queries on extraction. Records are spelled from the call view, so that the oracle knows what a reader must find."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.operators import extraction
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import calls, table

CALL = ("v_call",)
EDGE = ("v_call", "v_loc", "v_edge")
#: People and groups as the records spell them.
PATTERNS = (("PERSON", 0, r"\bUser \d+\b"), ("ORGANIZATION", 0, r"\bG\d Gang\b"), ("VEHICLE", 0, r"\b[A-Z]{2}-\d{2}-[A-Z]{2}-\d{4}\b"), ("PHONE", 0, r"\b9\d{9}\b"), ("LOCATION", 0, r"\bPlace \d+\b"))


def _records(spark, sf):
    """One sentence a call, of ten kinds."""
    c = calls(spark, sf).where("src <> dst")
    a, b = (F.concat(F.lit("User "), F.substring(e, 3, 20)) for e in ("src", "dst"))
    k, n = F.col("event_id"), F.col("event_id").cast("string")
    gang = F.concat(F.lit("G"), F.col("event_id") % 5, F.lit(" Gang"))
    plate = F.concat(F.lit("TN-01-AB-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    phone = F.concat(F.lit("9"), F.lpad(n, 9, "0"))
    place = F.concat(F.lit("Place "), k % 30)
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    kinds = (
        say(a, " called ", b, " for 2 minutes."), say(a, " received a call from ", b, " yesterday."), say(a, " transferred $", (k % 900 + 100).cast("string"), " to ", b, " via cash."), say("$", (k % 900 + 100).cast("string"), " was paid to ", b, " by ", a, "."), say(a, " and ", b, " met at ", place, "."),
        say(a, " is a member of ", gang, "."), say(gang, " is led by ", a, "."), say(a, " drives ", plate, " now."), say(a, " can be reached on ", phone, "."), say(a, " lives in ", place, " beside ", b, "."),
    )
    text = kinds[9]
    for i in range(8, -1, -1):
        text = F.when(k % 10 == i, kinds[i]).otherwise(text)
    return c.select("event_id", text.alias("text"))


NAMED = "n AS (SELECT event_id AS k, 'User ' || substr(src, 3) AS a, 'User ' || substr(dst, 3) AS b, 'G' || (event_id % 5) || ' Gang' AS gang, 'Place ' || (event_id % 30) AS place FROM v_call WHERE src <> dst)"
FOUND = f"""{NAMED}, t AS (SELECT k AS event_id, CASE WHEN k % 10 = 1 THEN b WHEN k % 10 = 6 THEN a ELSE a END AS source, CASE k % 10 WHEN 0 THEN 'CALLED' WHEN 1 THEN 'CALLED' WHEN 2 THEN 'TRANSFERRED_FUNDS' WHEN 3 THEN 'TRANSFERRED_FUNDS' WHEN 4 THEN 'MET' WHEN 5 THEN 'MEMBER_OF' WHEN 6 THEN 'LEADS' WHEN 7 THEN 'OWNS_VEHICLE' WHEN 8 THEN 'HAS_PHONE' ELSE 'LOCATED_AT' END AS relation,
CASE k % 10 WHEN 0 THEN b WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN b WHEN 4 THEN b WHEN 5 THEN gang WHEN 6 THEN gang WHEN 7 THEN 'TN-01-AB-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') WHEN 8 THEN '9' || lpad(CAST(k AS VARCHAR), 9, '0') ELSE place END AS target, CASE WHEN k % 10 IN (2, 3) THEN CAST(k % 900 + 100 AS DOUBLE) END AS amount FROM n)"""


@query(f"WITH {FOUND} SELECT * FROM t", CALL)
def txt_relations(spark, sf):
    """TXT-06, TXT-05: relations of ten kinds of sentence."""
    found = extraction.triplets(_records(spark, sf), "text", "event_id", patterns=PATTERNS)
    return found.select("event_id", "source", "relation", "target", "amount")


@query(f"""WITH {FOUND} SELECT event_id AS record, CASE relation WHEN 'MET' THEN 'MEETING' WHEN 'CALLED' THEN 'CALL' ELSE 'TRANSACTION' END AS event_type, least(source, target) || ',' || greatest(source, target) AS participants FROM t WHERE relation IN ('MET', 'CALLED', 'TRANSFERRED_FUNDS')""", CALL)
def txt_events(spark, sf):
    """TXT-08: events from the relations."""
    found = extraction.triplets(_records(spark, sf), "text", "event_id", patterns=PATTERNS).withColumnRenamed("event_id", "record")
    return extraction.events(found, "record").select("record", "event_type", F.array_join("participants", ",").alias("participants"))


@query(f"""WITH {FOUND}, e AS (SELECT event_id, least(source, target) AS p, greatest(source, target) AS q, CASE relation WHEN 'MET' THEN 'MEETING' WHEN 'CALLED' THEN 'CALL' ELSE 'TRANSACTION' END AS kind FROM t WHERE relation IN ('MET', 'CALLED', 'TRANSFERRED_FUNDS')),
i AS (SELECT *, 'EVT-' || substr(sha256(event_id || '|0|' || kind || '|' || p || ',' || q), 1, 12) AS id FROM e) SELECT p AS source, 'PARTICIPATED_IN' AS relation, id AS target FROM i UNION ALL SELECT q, 'PARTICIPATED_IN', id FROM i UNION ALL SELECT id, 'EVENT_TYPE', kind FROM i""", CALL)
def txt_linking(spark, sf):
    """TXT-08: triplets that tie the events to who, what and when."""
    found = extraction.triplets(_records(spark, sf), "text", "event_id", patterns=PATTERNS).withColumnRenamed("event_id", "record").withColumn("moment", F.lit(None).cast("string"))
    return extraction.linking_triplets(extraction.events(found, "record"))


@query("""SELECT 'CALL-' || event_id AS record, src AS source, 'CALLED' AS relation, dst AS target, 'PERSON' AS target_type FROM v_call WHERE relation = 'click' UNION ALL SELECT 'CALL-' || event_id, src, 'TRANSFERRED_TO', dst, 'PERSON' FROM v_call WHERE relation = 'purchase'
UNION ALL SELECT 'CALL-' || event_id, unnest([src, dst]), 'USES_ACCOUNT', 'A' || (event_id % 40), 'ACCOUNT' FROM v_call WHERE relation = 'purchase' AND event_id % 4 <> 0
UNION ALL SELECT meeting_id, a.x, 'MET', b.x, 'PERSON' FROM v_meet, unnest(attendees) WITH ORDINALITY AS a(x, i), unnest(attendees) WITH ORDINALITY AS b(x, i) WHERE a.i < b.i""", ("v_call", "v_meet"))
def txt_structured(spark, sf):
    """TXT-07: triplets of structured observations."""
    c = calls(spark, sf).withColumn("record", F.concat(F.lit("CALL-"), "event_id"))
    paid = c.where("relation = 'purchase'").withColumn("account", F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("A"), F.col("event_id") % 40)))
    return extraction.structured_triplets(c.where("relation = 'click'"), paid, views.meetings(spark, sf).withColumnRenamed("meeting_id", "record"))


@query("""WITH s AS (SELECT event_id, user_id, event_id // 6 AS doc, event_id % 6 AS sentence, event_type FROM events), p AS (SELECT doc, sentence, 50 AS start, CASE event_type WHEN 'click' THEN 'he' WHEN 'view' THEN 'She' ELSE 'they' END AS pronoun FROM s WHERE event_type <> 'signup'),
c AS (SELECT doc, sentence AS cs, 0 AS cstart, 'U' || user_id AS entity, CASE user_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'neutral' END AS gender, user_id % 7 <> 0 AS is_person FROM s),
m AS (SELECT p.doc, p.sentence, p.start, pronoun, cs, entity, round(0.4::DOUBLE * CASE WHEN pronoun = 'he' AND gender = 'female' THEN 0.1 WHEN pronoun = 'She' AND gender = 'male' THEN 0.1 WHEN pronoun = 'they' AND gender <> 'neutral' THEN 0.5 ELSE 1 END + 0.4::DOUBLE * greatest(0, 1 - 0.15::DOUBLE * (p.sentence - cs)) + 0.2::DOUBLE * CASE WHEN is_person THEN 1 ELSE 0.3 END, 6) AS score FROM p JOIN c ON c.doc = p.doc AND cs <= p.sentence)
SELECT doc, sentence, start, pronoun, entity AS antecedent, score AS confidence FROM m QUALIFY row_number() OVER (PARTITION BY doc, sentence, start ORDER BY score DESC, cs DESC) = 1 AND score > 0.5""")
def txt_coreference(spark, sf):
    """TXT-09: pronouns and their antecedents; events stand for sentences."""
    e = table(spark, sf, "events").withColumns({"doc": F.floor(F.col("event_id") / 6), "sentence": F.col("event_id") % 6})
    p = e.where("event_type <> 'signup'").select("doc", "sentence", F.lit(50).alias("start"), F.when(F.col("event_type") == "click", "he").when(F.col("event_type") == "view", "She").otherwise("they").alias("pronoun"))
    c = e.select("doc", "sentence", F.lit(0).alias("start"), F.concat(F.lit("U"), "user_id").alias("entity"), F.when(F.col("user_id") % 3 == 0, "male").when(F.col("user_id") % 3 == 1, "female").otherwise("neutral").alias("gender"), (F.col("user_id") % 7 != 0).alias("is_person"))
    return extraction.coreference(p, c)


def _statements(spark, sf):
    """Two sentences a call, one of them denied now and then."""
    c = calls(spark, sf)
    a, b = (F.concat(F.lit("User "), F.substring(e, 3, 20)) for e in ("src", "dst"))
    verb = F.when(F.col("event_id") % 5 == 0, " did not call ").otherwise(" could call ")
    return c.select("event_id", F.concat(a, verb, b, F.lit(" then. "), b, F.lit(" left on 2024-03-05.")).alias("text"), a.alias("a"), b.alias("b"))


@query("""WITH n AS (SELECT event_id, 'User ' || substr(src, 3) AS a, 'User ' || substr(dst, 3) AS b FROM v_call), s AS (SELECT event_id, 0 AS sentence, a || CASE WHEN event_id % 5 = 0 THEN ' did not call ' ELSE ' could call ' END || b || ' then.' AS t, a, b FROM n UNION ALL SELECT event_id, 1, b || ' left on 2024-03-05.', a, b FROM n), m AS (SELECT event_id, a AS x FROM n UNION SELECT event_id, b FROM n)
SELECT s.event_id, sentence, x AS subject, CASE WHEN sentence = 0 AND s.event_id % 5 <> 0 THEN 'UNCERTAIN' ELSE 'FACTUAL' END AS modality, sentence = 0 AND s.event_id % 5 = 0 AS is_negated FROM s JOIN m ON m.event_id = s.event_id AND contains(t, x)""", CALL)
def txt_claims(spark, sf):
    """TXT-10: a claim for each entity of each sentence."""
    r = _statements(spark, sf)
    m = r.select("event_id", F.explode(F.array("a", "b")).alias("surface"))
    return extraction.claims(r, "text", "event_id", m).select("event_id", "sentence", "subject", "modality", "is_negated")


@query("""WITH n AS (SELECT event_id, 'User ' || substr(src, 3) AS a, 'User ' || substr(dst, 3) AS b FROM v_call) SELECT event_id, 1 AS sentence, '2024-03-05' AS iso, CASE WHEN contains(b, a) THEN least(a, b) || ',' || greatest(a, b) ELSE b END AS participants FROM n""", CALL)
def txt_temporal_events(spark, sf):
    """TXT-10: dated sentences with whom they name."""
    r = _statements(spark, sf)
    m = r.select("event_id", F.explode(F.array("a", "b")).alias("surface"))
    return extraction.temporal_mentions(r, "text", "event_id", "2024-06-15 00:00:00", m)


@query("""WITH n AS (SELECT DISTINCT src, dst FROM v_call WHERE event_id % 5 = 0) SELECT edge_id, 'NEGATED' AS polarity FROM v_edge e WHERE EXISTS (SELECT 1 FROM n WHERE (n.src = e.src AND n.dst = e.dst) OR (n.src = e.dst AND n.dst = e.src))""", EDGE)
def txt_negated_edges(spark, sf):
    """TXT-11: edges whose ends one negation reaches."""
    c = calls(spark, sf)
    a, b = (F.concat(F.lit("User "), F.substring(e, 3, 20)) for e in ("src", "dst"))
    said = c.select(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("No evidence of calls from "), a, F.lit(" to "), b, F.lit("."))).otherwise(F.concat(a, F.lit(" called "), b, F.lit("."))).alias("text"))
    people = views.nodes(spark, sf).where("id LIKE 'U:%'")
    out = extraction.negated_edges(views.edges(spark, sf), people, said, "text")
    return out.where("polarity IS NOT NULL").select("edge_id", "polarity")


FP = "sha256(trim(regexp_replace(regexp_replace(lower(c), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')))"


def _language_sql(column: str) -> str:
    stop = {
        "en": "the and is of to in was were on at a an he she they", "es": "el la de y es en un una que fue los las",
        "fr": "le la de et est en un une que des les", "hi": "aur hai ka ki ke mein ko se ek",
    }
    hits = ", ".join(f"len(list_filter(w, lambda x: list_contains({v.split()!r}, x))) / {len(v.split())}.0::DOUBLE AS {k}" for k, v in stop.items())
    return f"w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower({column}), '[^a-z]+'), lambda x: x <> '')) AS w FROM r), h AS (SELECT *, {hits} FROM w), g AS (SELECT *, greatest(en, es, fr, hi) AS best FROM h)"


@query(f"WITH r AS (SELECT doc_id, coalesce(text, '') AS c FROM documents), {_language_sql('c')} SELECT doc_id, CASE WHEN len(w) = 0 THEN 'unknown' WHEN best = 0 OR en = best THEN 'en' WHEN es = best THEN 'es' WHEN fr = best THEN 'fr' ELSE 'hi' END AS language, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE WHEN best = 0 THEN 0.4::DOUBLE ELSE round(least(0.4::DOUBLE + best, 0.95::DOUBLE), 2) END AS confidence FROM g")
def txt_lang(spark, sf):
    """SCL-03: by stop words of four languages."""
    name, sure = T.language(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", name.alias("language"), sure.alias("confidence"))


CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), 'https?://[^ \t\n\x0b\f\r]+|www\.[^ \t\n\x0b\f\r]+', '[URL]', 'g'), '([!]){2,}|([?]){2,}|([.]){2,}|([,]){2,}', '\1\2\3\4', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"""


@query(f"""WITH c AS (SELECT doc_id, {CLEAN} AS c FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY {FP}) AS first FROM c), r AS (SELECT f.doc_id, f.first, o.c FROM f JOIN c o ON o.doc_id = f.first), {_language_sql('c')}
SELECT doc_id, doc_id <> first AS is_duplicate, CASE WHEN doc_id <> first THEN first END AS duplicate_of, CASE WHEN len(w) = 0 THEN 'unknown' WHEN best = 0 OR en = best THEN 'en' WHEN es = best THEN 'es' WHEN fr = best THEN 'fr' ELSE 'hi' END AS language FROM g""")
def txt_cleaned(spark, sf):
    """TXT-01: cleaned records; copies take their original's language."""
    return extraction.cleaned(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "is_duplicate", "duplicate_of", "language")


@query("""SELECT 'CALL-' || event_id AS record_id, 'call_observation' AS record_type, 'User ' || substr(src, 3) || ' called User ' || substr(dst, 3) || ' for ' || CAST(trunc(value) AS BIGINT) || ' seconds on ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' AS text FROM v_call WHERE relation = 'click'
UNION ALL SELECT 'CALL-' || event_id, 'transaction_observation', 'User ' || substr(src, 3) || ' transferred ' || CAST(trunc(value) AS BIGINT) || ' USD to User ' || substr(dst, 3) || ' on ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' FROM v_call WHERE relation = 'purchase'
UNION ALL SELECT meeting_id, 'meeting_observation', array_to_string(list_transform(attendees, lambda x: 'User ' || substr(x, 3)), ', ') || ' met on ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' FROM v_meet""", ("v_call", "v_meet"))
def txt_observations(spark, sf):
    """TXT-13: raw rows as sentences with their people's names."""
    c = calls(spark, sf).withColumn("record", F.concat(F.lit("CALL-"), "event_id"))
    people = views.nodes(spark, sf).where("id LIKE 'U:%'").select("id", F.col("label").alias("name"))
    return extraction.observations(c.where("relation = 'click'"), c.where("relation = 'purchase'"), views.meetings(spark, sf).withColumnRenamed("meeting_id", "record"), people)


@query("""WITH r AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PHONE' ELSE 'ALIEN' END AS label, value / 100 AS confidence, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type ELSE 'elsewhere' END AS quote, event_type AS t FROM events)
SELECT id, CASE WHEN label = 'ALIEN' THEN 'unknown label' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' WHEN quote = '' THEN 'no evidence' WHEN NOT contains(t, quote) THEN 'quote not in document' END AS reason FROM r WHERE reason IS NOT NULL""")
def txt_validated(spark, sf):
    """TXT-12: what a model returns, checked against its documents: the rejected rows."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    rows = e.select(k.alias("id"), F.when(k % 4 == 0, "PERSON").when(k % 4 == 1, "PHONE").otherwise("ALIEN").alias("label"), (F.col("value") / 100).alias("confidence"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("event_type")).otherwise("elsewhere").alias("quote"), k.alias("doc"))
    return extraction.validated(rows, ["PERSON", "PHONE"], e.select(k.alias("doc"), F.col("event_type").alias("text")))[1].select("id", "reason")


@query()
def txt_mentions(spark, sf):
    """TXT-02: fifteen patterns and case references over every document. No oracle: overlaps are settled in order; unit tests."""
    return extraction.domain_mentions(table(spark, sf, "documents"), "text", "doc_id")


@query()
def txt_entities(spark, sf):
    """TXT-03, TXT-04: people, groups and places by spelling, merged with the domain's mentions. No oracle; unit tests."""
    d = table(spark, sf, "documents")
    return extraction.merge_mentions(extraction.entities(d, "text", "doc_id"), extraction.domain_mentions(d, "text", "doc_id"), "doc_id")


@query("""WITH e AS (SELECT src, relation, dst, row_number() OVER (PARTITION BY src, relation, dst ORDER BY event_id) AS i FROM v_call), h AS (SELECT src, relation, dst, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || CAST(src || '|' || relation || '|' || dst || '|' || i AS BLOB)) AS h FROM e)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INTEGER & 3) + 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS edge_id, src, relation, dst FROM h""", CALL)
def grf_build(spark, sf):
    """GRF-01, SCL-20: edges from triplets with stable ids; parallel ones stay."""
    return extraction.graph_edges(calls(spark, sf), "event_id")
