"""Queries on scalar functions; their inputs are spelled from keys, so that the oracle knows the answer without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import epistemic, names, numbers
from linkloom.functions import text as T
from linkloom.plans.registry import query
from linkloom.sources import views
from linkloom.sources.tables import table


def _pick(key, *options):
    """The option of a key modulo their number."""
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(key % len(options) == i, options[i]).otherwise(out)
    return out


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(replace(replace(replace(replace(coalesce(text, ''), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'), chr(160), ' '), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), 'https?://[^ \\t\\n\\x0b\\f\\r]+|www\\.[^ \\t\\n\\x0b\\f\\r]+', '[URL]', 'g'),
'([!]){2,}|([?]){2,}|([.]){2,}|([,]){2,}', '\\1\\2\\3\\4', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS cleaned FROM documents""")
def scl_clean(spark, sf):
    """SCL-01: every document."""
    return table(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+919' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 1 THEN '+19' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN '+19' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') ELSE NULL END AS e164, CASE c_custkey % 5 WHEN 0 THEN '91' WHEN 1 THEN '1' WHEN 2 THEN '1' END AS country_code, c_custkey % 5 IN (0, 1, 2) AS is_valid,
CASE c_custkey % 5 WHEN 0 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 1 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') WHEN 2 THEN '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS local FROM customer""")
def scl_phone(spark, sf):
    """SCL-07, SCL-08: phones in several spellings."""
    k = F.col("c_custkey")
    n = F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))
    raw = _pick(k, F.concat(F.lit("+91-"), F.substring(n, 1, 5), F.lit(" "), F.substring(n, 6, 5)), n, F.concat(F.lit("0"), n), F.lit("12-34"), F.lit(None))
    p = names.phone_e164(raw)
    rows = table(spark, sf, "customer").select("c_custkey", p.alias("p"), T.phone(raw).alias("local"))
    return rows.select("c_custkey", "p.e164", "p.country_code", "p.is_valid", "local")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS dob FROM orders WHERE o_orderkey % 5 <> 3 OR day(o_orderdate) > 12")
def scl_dates(spark, sf):
    """SCL-09: dates in each known format; of the last only days past the twelfth are told from the second."""
    o = table(spark, sf, "orders").where("o_orderkey % 5 <> 3 OR day(o_orderdate) > 12")
    d = lambda f: F.date_format("o_orderdate", f)
    return o.select("o_orderkey", names.date_of(_pick(F.col("o_orderkey"), *(d(f) for f in names.DATE_FORMATS), F.lit("some day"))).alias("dob"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' Main St' WHEN 1 THEN s_suppkey || ' Oak Rd' ELSE 'nowhere' END AS street, CASE s_suppkey % 3 WHEN 0 THEN 'Fort Dale' WHEN 1 THEN 'Newham' ELSE 'Nowhere' END AS city, CASE s_suppkey % 3 WHEN 0 THEN 'Fort Dale, Southern Province, USA' WHEN 1 THEN 'Newham, Eastern Province, USA' ELSE 'Nowhere, UNKNOWN, UNKNOWN' END AS normalized,
CASE s_suppkey % 3 WHEN 0 THEN 'dale fort main' WHEN 1 THEN 'newham oak' ELSE 'nowhere' END AS key FROM supplier""")
def scl_address(spark, sf):
    """SCL-10, SCL-19: addresses against the table of cities."""
    k = F.col("s_suppkey")
    raw = _pick(k, F.concat(k, F.lit(" Main St, FORT DALE")), F.concat(k, F.lit(" Oak Rd , newham")), F.lit("nowhere"))
    return table(spark, sf, "supplier").select("s_suppkey", names.address(raw).alias("a"), names.address_key(raw).alias("key")).select("s_suppkey", "a.street", "a.city", "a.normalized", "key")


@query("""SELECT p_partkey, p_name AS name, p_name[1] || ' ' || string_split(p_name, ' ')[2] AS initials, 'TN' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || 'AB' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') AS vehicle FROM part""")
def scl_names(spark, sf):
    """SCL-11, SCL-19: names with titles, accents and suffixes; vehicle numbers."""
    n = F.col("p_name")
    raw = _pick(F.col("p_partkey"), F.concat(F.lit("Dr. Mr "), F.upper(n), F.lit(", Jr. PhD")), F.translate(n, "aeiou", "áèïôú"), F.concat(F.lit("  "), n, F.lit("!")), F.concat(F.lit("Prof "), n))
    raw = F.when(F.col("p_partkey") % 4 == 1, F.translate(n, "aeu", "áèú")).otherwise(raw)
    car = F.concat(F.lit("tn-"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" ab "), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"))
    return table(spark, sf, "part").select("p_partkey", names.normal_name(raw).alias("name"), names.initials_key(raw).alias("initials"), names.vehicle(car).alias("vehicle"))


def _fold_sql(column: str) -> str:
    keys = "|".join(sorted(("aa", "ii", "uu", "ee", "oo", "ai", "ei", "au", "ou", "sh", "th", "dh", "ph", "bh", "gh", "kh", "ch", "jh", "zh"), key=lambda k: (-len(k), k)))
    pairs = "'aa','a','ii','i','uu','u','ee','e','oo','o','ai','ei','ei','ei','au','ou','ou','ou','sh','s','th','t','dh','d','ph','f','bh','b','gh','g','kh','k','ch','c','jh','j','zh','l','w','v','x','k','q','k'".split(",")
    table_ = "MAP {" + ", ".join(f"{a}: {b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True)) + "}"
    return f"trim(array_to_string(list_transform(regexp_extract_all(lower({column}), '{keys}|.'), lambda k: coalesce({table_}[k], k)), ''))"


@query(f"SELECT id, {_fold_sql('label')} AS folded, 'E-' || substr(sha256('PERSON|' || {_fold_sql('label')} || '||'), 1, 16) AS guid FROM v_node", ("v_node",))
def scl_fold(spark, sf):
    """SCL-18, SCL-20: names folded by sound, and stable ids from them."""
    folded = names.sound_fold(F.col("label"))
    return views.nodes(spark, sf).select("id", folded.alias("folded"), T.short_id("E", F.concat(F.lit("PERSON|"), folded, F.lit("||")), 16).alias("guid"))


def _grams(n: int, c: str) -> str:
    return f"list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i, {n}))"


@query(f"""WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, replace(a.p_name, ' ', '') AS x, replace(b.p_name, ' ', '') AS y FROM n a JOIN n b ON string_split(a.p_name, ' ')[2] = string_split(b.p_name, ' ')[2] AND a.p_name < b.p_name),
g AS (SELECT a, b, {_grams(2, 'x')} AS x2, {_grams(2, 'y')} AS y2, {_grams(3, 'x')} AS x3, {_grams(3, 'y')} AS y3 FROM p),
i AS (SELECT *, list_sum(list_transform(list_distinct(x2), lambda k: least(len(list_filter(x2, lambda z: z = k)), len(list_filter(y2, lambda z: z = k))))) AS i2, list_sum(list_transform(list_distinct(x3), lambda k: least(len(list_filter(x3, lambda z: z = k)), len(list_filter(y3, lambda z: z = k))))) AS i3 FROM g)
SELECT a, b, round(0.5::DOUBLE * i2 / (len(x2) + len(y2) - i2) + 0.5::DOUBLE * i3 / (len(x3) + len(y3) - i3), 5) AS overlap FROM i""")
def scl_ngram_overlap(spark, sf):
    """SCL-16: pairs of names that share their last word."""
    n = table(spark, sf, "part").select("p_name").distinct().withColumn("w", F.element_at(F.split("p_name", " "), 2))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, "w").where("a.p_name < b.p_name").select(F.col("a.p_name").alias("x"), F.col("b.p_name").alias("y"))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"), F.round(names.ngram_overlap(F.col("x"), F.col("y")), 5).alias("overlap"))


@query("""SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN s_suppkey + 5000.0::DOUBLE WHEN 1 THEN (s_suppkey + 2) * 1000.0::DOUBLE WHEN 2 THEN (s_suppkey + 0.5::DOUBLE) * 100000 WHEN 3 THEN (s_suppkey + 1) * 10000000.0::DOUBLE WHEN 4 THEN s_suppkey + 1200.0::DOUBLE END AS amount,
CASE s_suppkey % 7 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' WHEN 3 THEN 'EUR' WHEN 4 THEN 'GBP' END AS currency, CASE s_suppkey % 7 WHEN 0 THEN 'bank transfer' WHEN 1 THEN 'upi' WHEN 4 THEN 'cash' END AS channel, CASE s_suppkey % 7 WHEN 5 THEN 90 WHEN 6 THEN (s_suppkey + 1) * 3600 END AS seconds, CASE s_suppkey % 7 WHEN 5 THEN '2024-03-05T10:30' END AS moment FROM supplier""")
def scl_money(spark, sf):
    """SCL-21, SCL-22: amounts, currencies, channels, durations and times in sentences."""
    k = F.col("s_suppkey")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    thousand = F.format_number(k + 1200, 0)
    raw = _pick(k, say("paid rupees ", k + 5000, " via a bank transfer"), say("sent $", k + 2, "k using UPI"), say("moved ", F.concat(k, F.lit(".5")), " lakh rupees"), say("worth ", k + 1, " crore euros"), say("gave £", thousand, " in cash"), say("on 2024-03-05T10:30 for 1.5 minutes"), say("lasting ", k + 1, " hours-long"))
    raw = F.when(k % 7 == 6, say("lasting ", k + 1, " hours")).otherwise(raw)
    rows = table(spark, sf, "supplier").select("s_suppkey", raw.alias("t"))
    t = F.col("t")
    amount = F.when(~t.rlike("^(on|lasting) "), T.amount(t))
    return rows.select("s_suppkey", amount.alias("amount"), T.currency(t).alias("currency"), T.channel(t).alias("channel"), T.duration_seconds(t).alias("seconds"), T.timestamp_text(t).alias("moment"))


@query("""WITH d AS (SELECT o_orderkey AS k, o_orderdate AS d, TIMESTAMP '2024-06-15 12:00:00' AS a FROM orders)
SELECT k AS o_orderkey, CASE k % 8 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%Y-%m-%d') || 'T22:05:00' WHEN 2 THEN strftime(d, '%Y-%m-%d') WHEN 3 THEN strftime(d, '%Y-%m-%d') WHEN 4 THEN strftime(a - to_days(CAST(k % 50 AS INTEGER)), '%Y-%m-%d') WHEN 5 THEN strftime(a + to_days(CAST(7 * (k % 9) AS INTEGER)), '%Y-%m-%d') WHEN 6 THEN '2024-06-15T' || lpad(CAST(k % 12 + 12 AS VARCHAR), 2, '0') || ':00:00' END AS iso,
k % 8 IN (4, 5, 7) AS is_relative, CASE k % 8 WHEN 4 THEN 0.0::DOUBLE - 1440.0::DOUBLE * (k % 50) WHEN 5 THEN 10080.0::DOUBLE * (k % 9) ELSE 0.0::DOUBLE END AS delta_minutes, CASE WHEN k % 8 < 4 THEN 0.95::DOUBLE WHEN k % 8 < 6 THEN 0.8::DOUBLE WHEN k % 8 = 6 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM d""")
def scl_temporal(spark, sf):
    """SCL-24: times named in eight ways against a fixed anchor."""
    k = F.col("o_orderkey")
    f = lambda p: F.date_format("o_orderdate", p)
    hour = F.when(k % 12 == 0, F.lit(12)).otherwise(k % 12)
    raw = _pick(k, f("yyyy-MM-dd"), F.concat(f("d/M/yyyy"), F.lit(" at 10:05 pm")), f("d MMMM yyyy"), f("MMM d, yyyy"), F.concat(k % 50, F.lit(" days ago")), F.concat(F.lit("in "), k % 9, F.lit(" weeks")), F.concat(F.lit("about "), hour, F.lit(" pm")), F.lit("some time"))
    rows = table(spark, sf, "orders").select("o_orderkey", T.temporal(raw, F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")).alias("t"))
    return rows.select("o_orderkey", "t.iso", "t.is_relative", "t.delta_minutes", "t.confidence")


@query("""SELECT e AS event_id, CASE e % 6 WHEN 0 THEN 'DENIED' WHEN 1 THEN 'REPORTED' WHEN 2 THEN 'SUSPECTED' WHEN 3 THEN 'UNCERTAIN' WHEN 4 THEN 'ALLEGED' ELSE 'FACTUAL' END AS modality, e % 6 IN (0, 5) AS negated, CASE e % 6 WHEN 0 THEN ' meeting user ' || u || ',' WHEN 5 THEN ' call user ' || u || '.' END AS scope FROM (SELECT event_id AS e, user_id AS u FROM events)""")
def scl_modality(spark, sf):
    """SCL-25, SCL-26: modality, negation and its reach."""
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    say = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    raw = _pick(k, say("He denied meeting user ", u, ", it is said."), say("According to user ", u, " they met."), say("User ", u, " is suspected."), say("User ", u, " could be there."), say("The alleged user ", u, " left."), say("They did not call user ", u, ". Then left."))
    rows = table(spark, sf, "events").select("event_id", raw.alias("t"))
    return rows.select("event_id", T.modality(F.col("t")).alias("modality"), T.negated(F.col("t")).alias("negated"), T.negation_scope(F.col("t")).alias("scope"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'observed' WHEN 1 THEN 'MODEL_FINDING' WHEN 2 THEN 'maybe' WHEN 3 THEN 'Denied' WHEN 4 THEN 'conflicted' WHEN 5 THEN 'xyz' END AS a, event_id % 7 AS k, event_id % 6 AS j FROM events),
c AS (SELECT *, CASE k WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'POSSIBLE' WHEN 3 THEN 'NEGATED' WHEN 4 THEN 'CONTRADICTED' ELSE 'UNKNOWN' END AS cur, CASE j WHEN 0 THEN 'OBSERVED' WHEN 1 THEN 'INFERRED' WHEN 2 THEN 'POSSIBLE' WHEN 3 THEN 'NEGATED' WHEN 4 THEN 'CONTRADICTED' ELSE 'UNKNOWN' END AS new FROM e)
SELECT event_id, cur AS status, cur = new OR (cur = 'INFERRED' AND new = 'POSSIBLE') OR (cur = 'CONTRADICTED' AND new IN ('OBSERVED', 'INFERRED')) AS refines, CASE cur WHEN 'UNKNOWN' THEN 0 WHEN 'POSSIBLE' THEN 1 WHEN 'INFERRED' THEN 2 WHEN 'CONTRADICTED' THEN 4 ELSE 3 END::INTEGER AS rank,
CASE WHEN (cur, new) IN (('OBSERVED', 'NEGATED'), ('NEGATED', 'OBSERVED')) THEN 'CONTRADICTED' WHEN cur = 'UNKNOWN' THEN new WHEN new = 'UNKNOWN' THEN cur WHEN (CASE new WHEN 'POSSIBLE' THEN 1 WHEN 'INFERRED' THEN 2 WHEN 'CONTRADICTED' THEN 4 ELSE 3 END) < (CASE cur WHEN 'POSSIBLE' THEN 1 WHEN 'INFERRED' THEN 2 WHEN 'CONTRADICTED' THEN 4 ELSE 3 END) THEN new ELSE cur END AS merged,
CASE cur WHEN 'POSSIBLE' THEN 'HYPOTHETICAL' WHEN 'NEGATED' THEN 'UNKNOWN' ELSE cur END AS fact, CASE WHEN cur = 'OBSERVED' AND event_id % 2 = 0 THEN 'INFERRED' ELSE cur END AS downgraded FROM c""")
def scl_epistemic(spark, sf):
    """SCL-36, SCL-35: the lattice over all pairs of statuses."""
    k = F.col("event_id")
    a = _pick(k, F.lit("observed"), F.lit("MODEL_FINDING"), F.lit("maybe"), F.lit("Denied"), F.lit("conflicted"), F.lit("xyz"), F.lit(None))
    b = _pick(k, *(F.lit(s) for s in epistemic.STATUSES))
    rows = table(spark, sf, "events").select("event_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("event_id", epistemic.coerce(a).alias("status"), epistemic.can_refine(a, b).alias("refines"), epistemic.rank(a).alias("rank"), epistemic.merge(F.array(a, b)).alias("merged"), epistemic.fact_status(a).alias("fact"), epistemic.without_evidence(a, k % 2 != 0).alias("downgraded"))


@query("""SELECT conv_id, turn, s.i AS place, s.x AS sentence FROM (SELECT conv_id, turn, unnest(list_transform(list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \\t\\n\\x0b\\f\\r]+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: x <> ''), lambda x, i: {'i': i - 1, 'x': x})) AS s FROM conversations)""")
def scl_sentences(spark, sf):
    """SCL-28."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence")).select("conv_id", "turn", F.col("place").cast("long").alias("place"), "sentence")


@query("""SELECT event_id, round(1 / (1 + exp(-least(value / 10, 20))), 6) AS squashed, round(ln(greatest(least(value / 1000, 0.999999), 0.000001) / (1 - greatest(least(value / 1000, 0.999999), 0.000001))), 6) AS log_odds, CASE WHEN value > 50 THEN 'HIGH' WHEN value > 20 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN event_id % 4 > 0 THEN round(value / (event_id % 4), 6) END AS safe,
NOT (event_id % 5 > 3 AND event_id % 2 = 0) AS overlapping FROM events""")
def scl_numbers(spark, sf):
    """SCL-34, SCL-35, SCL-37, SCL-38."""
    k, v = F.col("event_id"), F.col("value")
    ratio = F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(v / F.nullif(k % 4, F.lit(0)))
    end = F.when(k % 2 == 0, F.lit(3))
    return table(spark, sf, "events").select("event_id", F.round(numbers.sigmoid(v / 10), 6).alias("squashed"), F.round(numbers.logit(v / 1000), 6).alias("log_odds"), numbers.ladder(v, [(50, "HIGH"), (20, "MEDIUM")], "LOW").alias("level"), numbers.json_safe(ratio).alias("safe"), numbers.overlaps(k % 5, F.lit(None).cast("long"), F.lit(0), end).alias("overlapping"))


@query("""SELECT doc_id, CASE WHEN length(regexp_replace(trim(text), '[ \\t\\n\\r]+', ' ', 'g')) > 400 THEN substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 400) || '...' ELSE trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) END AS excerpt, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS script FROM documents""")
def scl_excerpt(spark, sf):
    """SCL-30, SCL-04, SCL-05, SCL-39."""
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), T.script(F.col("text")).alias("script"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'hello amigo ' || c_custkey WHEN 1 THEN 'le meeting de ' || c_custkey ELSE 'hola ' || c_custkey END AS translated FROM customer""")
def scl_translate(spark, sf):
    """SCL-06: words of the dictionary in the text's language only."""
    k = F.col("c_custkey")
    raw = _pick(k, F.concat(F.lit("Hola amigo "), k), F.concat(F.lit("le réunion de "), k), F.concat(F.lit("hola "), k))
    return table(spark, sf, "customer").select("c_custkey", T.translate(raw, _pick(k, F.lit("es"), F.lit("fr"), F.lit("en"))).alias("translated"))


@query()
def scl_soundex(spark, sf):
    """SCL-14, SCL-13, SCL-15: Soundex keys, ratios and full name comparison of names that share a word. No oracle: neither exists in SQL; unit tests."""
    n = table(spark, sf, "part").select(names.normal_name(F.col("p_name")).alias("n")).distinct().withColumn("w", F.element_at(F.split("n", " "), 2))
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, "w").where("a.n < b.n").select(F.col("a.n").alias("a"), F.col("b.n").alias("b"))
    out = pairs.withColumn("c", names.compare_names("a", "b"))
    return out.select("a", "b", names.soundex_key(F.col("a")).alias("key"), F.round(names.name_similarity("a", "b"), 6).alias("ratio"), F.round("c.score", 6).alias("score"), "c.matched", "c.reason")


@query("""SELECT c_custkey, '2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS iso_date, '98' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS phone, (c_custkey + 1) * 100000.0::DOUBLE AS amount, 'INR' AS currency, 'en' AS language, 13::BIGINT AS words FROM customer""")
def scl_normalized(spark, sf):
    """SCL-23: what a message says, whatever its language."""
    k = F.col("c_custkey")
    say = F.concat(F.lit("Call +91 98"), F.lpad(k.cast("string"), 8, "0"), F.lit(" and bring rupees "), k + 1, F.lit(" lakh to the usual place near the river on "), k % 28 + 1, F.lit("/3/2024"))
    n = table(spark, sf, "customer").select("c_custkey", T.normalized(say).alias("n"))
    return n.select("c_custkey", "n.iso_date", "n.phone", "n.amount", "n.currency", "n.language", F.size("n.tokens").cast("long").alias("words"))
