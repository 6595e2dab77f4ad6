"""Evidence: look-ups, retrieval, findings and their checks, guardrails, chains, dispositions, dossiers and packs.

Evidence is (evidence_id, source_type, record_id, text, ts, nodes). Everything derived is a hypothesis for review.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions import epistemic
from linkloom.functions import text as T
from linkloom.functions.numbers import exact_round

REVIEW = "HYPOTHESIS — requires human review"


def by_node(evidence: DataFrame, node: str) -> DataFrame:
    """Evidence that names a node, oldest first; undated last."""
    return evidence.where(F.array_contains("nodes", node)).orderBy(F.col("ts").asc_nulls_last(), "evidence_id")


def by_edge(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """links (edge_id, record_id) with the ids of their evidence."""
    return links.join(evidence.select("record_id", "evidence_id"), "record_id").select("edge_id", "evidence_id")


def by_finding(evidence: DataFrame, cited: DataFrame, finding: str) -> DataFrame:
    """Evidence that a finding cites; cited: finding, evidence_id."""
    return evidence.join(cited.where(F.col("finding") == finding).select("evidence_id"), "evidence_id", "left_semi")


def timeline(evidence: DataFrame, nodes: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Dated evidence that names one of the nodes, within a closed range."""
    out = evidence.where(F.col("ts").isNotNull() & F.arrays_overlap("nodes", F.array(*map(F.lit, nodes))))
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def postings(evidence: DataFrame) -> DataFrame:
    """token, evidence_id: the inverted index, written and read like any table."""
    return evidence.select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"), "evidence_id")


def search(evidence: DataFrame, terms: Sequence[str], source_type: str | None = None, k: int | None = None) -> DataFrame:
    """evidence_id, score: number of distinct query tokens held (3 more for an exact record id), ties by id, by source type."""
    rows = evidence if source_type is None else evidence.where(F.col("source_type") == source_type)
    held = F.size(F.array_intersect(T.tokens(F.col("text")), F.array(*(F.lit(t.lower()) for t in terms))))
    score = held + F.when(F.lower("record_id").isin(*(t.lower() for t in terms)), 3).otherwise(0)
    out = rows.select("evidence_id", score.cast("long").alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), "evidence_id").limit(k)


def similar(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int, allowed: Column | None = None) -> DataFrame:
    """The k most similar rows by cosine; rows that are not allowed score -1."""
    sim = F.round(T.cosine(F.col(vector), F.array(*map(F.lit, query))), 6)
    sim = sim if allowed is None else F.when(allowed, sim).otherwise(-1.0)
    return vectors.select(key, sim.alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def text_vectors(evidence: DataFrame, features: int = 1024) -> DataFrame:
    """evidence_id, vector: TF-IDF of words and word pairs with sublinear term counts, of length 1."""
    from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = evidence.select("evidence_id", T.tokens(F.col("text")).alias("words"))
    rows = NGram(n=2, inputCol="words", outputCol="pairs").transform(rows).withColumn("terms", F.concat("words", "pairs"))
    rows = HashingTF(numFeatures=features, inputCol="terms", outputCol="counts").transform(rows)
    damped = array_to_vector(F.transform(vector_to_array("counts"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0)))
    rows = rows.withColumn("damped", damped)
    rows = IDF(inputCol="damped", outputCol="weighted").fit(rows).transform(rows)
    rows = Normalizer(inputCol="weighted", outputCol="v").transform(rows)
    return rows.select("evidence_id", vector_to_array("v").alias("vector"))


def for_dossier(relevant: DataFrame, evidence: DataFrame, subject: str, now: str, recent: int = 5, most: int = 30) -> DataFrame:
    """relevant (evidence_id, relevance) and the subject's most recent records, by 0.6 relevance + 0.4 recency (1 / days, a day at least); what is relevant has no recency of its own."""
    last = evidence.where(F.array_contains("nodes", subject) & F.col("ts").isNotNull()).orderBy(F.desc("ts"), "evidence_id").limit(recent)
    days = F.greatest(F.lit(1), F.datediff(F.lit(now).cast("timestamp_ntz"), F.col("ts")))
    late = last.join(relevant.select("evidence_id"), "evidence_id", "left_anti").select("evidence_id", F.lit(0.0).alias("relevance"), (1.0 / days).alias("recency"), F.lit("recency").alias("signal"))
    first = relevant.select("evidence_id", "relevance", F.lit(0.0).alias("recency"), F.lit("semantic").alias("signal"))
    out = first.unionByName(late).withColumn("rank_score", F.round(0.6 * F.col("relevance") + 0.4 * F.col("recency"), 6))
    return out.orderBy(F.desc("rank_score"), "evidence_id").limit(most)


def chunks(keyword: DataFrame, neighbourhood: DataFrame, cases: DataFrame, most: int = 20, budget: int | None = None) -> DataFrame:
    """Chunks (chunk_id, content) of a query: 0.7 for keywords, 0.9 for a node and 0.85 over the number of nodes seen for its neighbours (level, place), 0.75 for cases.

    One chunk an id, the best `most`, ties by id; with a budget of characters those that still fit in order.
    """
    score = F.when(F.col("level") == 0, 0.9).otherwise(0.85 / (F.col("place") + 1))
    every = keyword.select("chunk_id", "content", F.lit(0.7).alias("score"), F.lit("keyword").alias("method"))
    every = every.unionByName(neighbourhood.select("chunk_id", "content", score.alias("score"), F.lit("graph").alias("method")))
    every = every.unionByName(cases.select("chunk_id", "content", F.lit(0.75).alias("score"), F.lit("case").alias("method")))
    one = every.groupBy("chunk_id").agg(F.max(F.struct("score", "method", "content")).alias("c")).select("chunk_id", "c.*")
    out = one.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(most)
    if budget is not None:
        upto = F.sum(F.length("content")).over(Window.orderBy(F.desc("score"), "chunk_id"))  # of `most` rows
        out = out.withColumn("upto", upto).where(F.col("upto") <= budget).drop("upto")
    return out


# --- findings -----------------------------------------------------------------------------------


def findings(ghosts: DataFrame, anchors: DataFrame, linked: DataFrame, least: float = 0.0) -> DataFrame:
    """One finding a ghost (ghost_id, confidence, direct_edges): supporting evidence of its anchors (ghost_id, node) by linked (node, evidence_id), counter signals, unknowns.

    An anchor without evidence is an unknown; nothing is observed without evidence.
    """
    a = anchors.join(linked, "node", "left").groupBy("ghost_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("supporting"), F.sort_array(F.collect_set(F.when(F.col("evidence_id").isNull(), F.col("node")))).alias("unbound"), F.countDistinct("node").alias("anchors"))
    f = ghosts.where(F.col("confidence") >= least).join(a, "ghost_id", "left")
    counter = F.when(F.col("direct_edges") > 0, F.array(F.concat(F.lit("COUNTER:direct_edges:"), F.col("direct_edges")))).otherwise(F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    return f.select(
        T.short_id("FD", F.concat(F.lit("hidden_intermediary|"), "ghost_id"), 12).alias("finding_id"), F.col("ghost_id").alias("subject_id"), exact_round(F.col("confidence"), 4).alias("confidence"), F.coalesce("supporting", empty).alias("supporting"), counter.alias("counter"), F.coalesce("unbound", empty).alias("unknown"),
        F.when(F.size(F.coalesce("supporting", empty)) > 0, "OBSERVED").otherwise("INFERRED").alias("claim_label"), F.lit(REVIEW).alias("status"), F.lit(True).alias("review_required"), F.lit("structural-hole-1").alias("model_version"),
    )


def integrity(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding_id, rule, severity of every broken rule of findings.

    Cited evidence must exist (counter signals aside); observed claims need evidence; counter-evidence and
    unknowns must be looked for; confidence lies in 0..1; model, review and status must be there.
    """
    cited = rows.select("finding_id", F.explode(F.concat("supporting", "counter")).alias("evidence_id")).where(~F.col("evidence_id").startswith("COUNTER:"))
    missing = cited.join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("finding_id", F.lit("EVIDENCE_MISSING").alias("rule"), F.lit("ERROR").alias("severity")).distinct()
    rules = (
        ("OBSERVED_WITHOUT_EVIDENCE", "ERROR", (F.col("claim_label") == "OBSERVED") & (F.size("supporting") == 0)),
        ("UNKNOWN_LABEL", "ERROR", ~F.col("claim_label").isin(*epistemic.STATUSES)),
        ("CONFIDENCE_OUT_OF_RANGE", "ERROR", ~F.col("confidence").between(0, 1)),
        ("NO_COUNTER_EVIDENCE", "WARNING", F.size("counter") == 0),
        ("NO_UNKNOWNS", "WARNING", F.size("unknown") == 0),
        ("NO_MODEL_VERSION", "ERROR", F.coalesce("model_version", F.lit("")) == ""),
        ("REVIEW_NOT_REQUIRED", "ERROR", ~F.coalesce("review_required", F.lit(False))),
    )
    broken = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, c in rules)))
    return rows.select("finding_id", F.explode(broken).alias("b")).select("finding_id", "b.*").unionByName(missing)


#: What a generated text must not say.
FORBIDDEN = ("is guilty", "is a criminal", "proves that", "definitely committed", "must be arrested")


def guardrails(outputs: DataFrame, evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """output_id, violation of generated outputs (output_id, summary, status, source_status, evidence_ids, entity_ids, has_counter, counter_ids).

    Citations must exist, statuses be known and no stronger than their source's, entities be known ones,
    counter-evidence stay, and the text keep from judging. An output without violations is accepted.
    """

    def unknown(column: str, known: DataFrame, name: str) -> DataFrame:
        held = outputs.select("output_id", F.explode(column).alias("id"))
        return held.join(known, "id", "left_anti").select("output_id", F.lit(name).alias("violation")).distinct()

    own = (
        ("UNKNOWN_STATUS", ~F.coalesce(F.col("status").isin(*epistemic.STATUSES, "HYPOTHETICAL"), F.lit(False))),
        ("UPGRADED_STATUS", F.col("status").isin(*epistemic.STATUSES) & F.col("source_status").isNotNull() & ~epistemic.can_refine(F.col("source_status"), F.col("status"))),
        ("COUNTER_EVIDENCE_DROPPED", F.coalesce("has_counter", F.lit(False)) & (F.size("counter_ids") == 0)),
        ("FORBIDDEN_LANGUAGE", F.lower("summary").rlike("|".join(FORBIDDEN))),
    )
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in own)))
    out = outputs.select("output_id", F.explode(broken).alias("violation"))
    out = out.unionByName(unknown("evidence_ids", evidence.select(F.col("evidence_id").alias("id")), "UNKNOWN_EVIDENCE"))
    return out.unionByName(unknown("entity_ids", nodes.select("id"), "UNKNOWN_ENTITY"))


def panel(finding_evidence: DataFrame, records: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Per finding (finding, evidence_id): supporting and contradicting records of records (evidence_id, text) by polarity, their strengths' balance, has_conflict."""
    from linkloom.operators.records import polarity

    rows = finding_evidence.join(polarity(records.select("evidence_id", "text"), "text", list(terms)), "evidence_id")
    side = lambda p: F.col("polarity") == p
    total = lambda p: F.coalesce(F.sum(F.when(side(p), F.col("strength").cast("decimal(10,6)"))), F.lit(0)).cast("double")
    out = rows.groupBy("finding").agg(F.count(F.when(side("SUPPORTS"), 1)).alias("supporting"), F.count(F.when(side("CONTRADICTS"), 1)).alias("contradicting"), F.count(F.when(side("UNKNOWN"), 1)).alias("unknown"), F.round(total("SUPPORTS") - total("CONTRADICTS"), 4).alias("net_support"))
    return out.withColumn("has_conflict", (F.col("supporting") > 0) & (F.col("contradicting") > 0))


def chain(finding_nodes: DataFrame, edges: DataFrame, evidence: DataFrame, most: int = 12) -> DataFrame:
    """Per finding (finding, node): its nodes' edges, up to `most` by id, each with its evidence; provenance_verified: every edge shown has evidence."""
    ends = edges.select("edge_id", F.explode(F.array("src", "dst")).alias("node"))
    tied = finding_nodes.join(ends, "node").select("finding", "edge_id").distinct()
    first = tied.withColumn("r", F.row_number().over(Window.partitionBy("finding").orderBy("edge_id"))).where(F.col("r") <= most)
    shown = first.join(evidence.select(F.col("record_id").alias("edge_id"), "evidence_id"), "edge_id", "left")
    per = shown.groupBy("finding", "edge_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("e"))
    return per.groupBy("finding").agg(F.array_join(F.sort_array(F.collect_list("edge_id")), ",").alias("edges"), F.sum(F.size("e")).alias("evidence"), F.min(F.size("e") > 0).alias("provenance_verified"))


#: What an analyst's verdict makes of a hypothesis.
DISPOSITIONS = {"CONFIRM": "SUPPORTED", "REJECT": "REJECTED", "DEFER": "UNDER_REVIEW", "REQUEST_EVIDENCE": "UNDER_REVIEW"}


def hypothesis_status(hypotheses: DataFrame, dispositions: DataFrame) -> DataFrame:
    """hypotheses (id, status) with the status of their latest disposition (id, disposition, analyst, ts, seq) and the number of all; unknown verdicts don't count."""
    valid = dispositions.where(F.upper("disposition").isin(*DISPOSITIONS))
    last = valid.groupBy("id").agg(F.max_by(F.upper("disposition"), F.struct("ts", "seq")).alias("last"), F.count(F.lit(1)).alias("history"))
    status = F.col("status")
    for verdict, to in DISPOSITIONS.items():
        status = F.when(F.col("last") == verdict, to).otherwise(status)
    return hypotheses.join(last, "id", "left").select("id", status.alias("status"), F.coalesce("history", F.lit(0).cast("long")).alias("history"))


def dossier(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, subject: str, most: int = 10) -> DataFrame:
    """One row on a subject: identity, ties by relation, its busiest neighbours and latest evidence (up to `most` each), unknowns, status and a check of the whole."""
    n = nodes.where(F.col("id") == subject)
    e = edges.where((F.col("src") == subject) | (F.col("dst") == subject)).withColumn("other", F.when(F.col("src") == subject, F.col("dst")).otherwise(F.col("src")))
    rel = e.groupBy("relation").agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct("relation", "n"))).alias("ties"))
    near = e.groupBy("other").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "other").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "other"))).alias("near"))
    mine = evidence.where(F.array_contains("nodes", subject))
    seen = mine.orderBy(F.col("ts").desc_nulls_last(), "evidence_id").limit(most).agg(F.collect_list("evidence_id").alias("evidence"))
    count = mine.agg(F.count(F.lit(1)).alias("records"), F.count(F.when(F.col("ts").isNull(), 1)).alias("undated"))
    one = n.join(F.broadcast(rel)).join(F.broadcast(near)).join(F.broadcast(seen)).join(F.broadcast(count))  # one row each
    unknown = F.array_compact(F.array(F.when(F.col("undated") > 0, F.concat(F.col("undated"), F.lit(" records without a time"))), F.when(F.col("records") == 0, F.lit("no evidence"))))
    return one.select("id", "label", "entity_type", F.array_join(F.transform("ties", lambda x: F.concat(x["relation"], F.lit("="), x["n"])), ",").alias("ties"), F.array_join(F.transform("near", lambda x: x["other"]), ",").alias("neighbours"), F.array_join("evidence", ",").alias("evidence"), "records", F.array_join(unknown, "; ").alias("unknown"), F.lit(REVIEW).alias("status"), ((F.size("evidence") > 0) | (F.col("records") == 0)).alias("valid"))


def brief(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """One sentence a community from its counts, by template; nothing in it is inferred."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "ts").join(members.select("node", "community"), "node")
    out = ends.groupBy("community").agg(F.countDistinct("node").alias("people"), F.count(F.lit(1)).alias("ends"), F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    text = F.concat(F.lit("Community "), "community", F.lit(": "), F.col("people"), F.lit(" entities with "), F.col("ends"), F.lit(" recorded ends of relations between "), F.col("first"), F.lit(" and "), F.col("last"), F.lit("."))
    return out.select("community", text.alias("brief"), F.lit(REVIEW).alias("status"))


def pack(members: DataFrame, edges: DataFrame, evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a case (members: node, community): counts of nodes, edges inside, evidence, findings (finding, node), and the range of its timeline."""
    n = members.groupBy("community").agg(F.count(F.lit(1)).alias("nodes"))
    a, b = members.select(F.col("node").alias("src"), "community"), members.select(F.col("node").alias("dst"), F.col("community").alias("c"))
    inside = edges.join(a, "src").join(b, "dst").where("community = c").groupBy("community").agg(F.count(F.lit(1)).alias("edges"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    held = evidence.select("evidence_id", F.explode("nodes").alias("node")).join(members, "node").groupBy("community").agg(F.countDistinct("evidence_id").alias("evidence"))
    found = rows.join(members, "node").groupBy("community").agg(F.countDistinct("finding").alias("findings"))
    return n.join(inside, "community", "left").join(held, "community", "left").join(found, "community", "left").na.fill(0, ["edges", "evidence", "findings"])
