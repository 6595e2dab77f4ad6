"""The investigation's graph, meeting, membership and evidence views over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.tables import calls, places, table

#: Which relation an event's kind stands for.
RELATIONS = {"click": "CALLED", "view": "MET", "purchase": "TRANSFERRED_FUNDS", "signup": "MEMBER_OF"}
OTHER_RELATION = "ASSOCIATED_WITH"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edge_id, src, dst, relation, ts, confidence, value: user edges with times, and places without."""
    kind = F.lit(OTHER_RELATION)
    for event, relation in RELATIONS.items():
        kind = F.when(F.col("relation") == event, relation).otherwise(kind)
    sure = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 100) / 100.0)
    dated = calls(spark, sf_dir).select(F.concat(F.lit("CALL-"), "event_id").alias("edge_id"), "src", "dst", kind.alias("relation"), "ts", sure.alias("confidence"), "value")
    fixed = places(spark, sf_dir).select(F.concat(F.lit("LOC-"), "src").alias("edge_id"), "src", "dst", F.lit("LOCATED_AT").alias("relation"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("value"))
    return dated.unionByName(fixed)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, entity_type."""

    def of(rows: DataFrame, prefix: str, key: str, label: Column, kind: str) -> DataFrame:
        return rows.select(F.concat(F.lit(prefix), key).alias("id"), label.alias("label"), F.lit(kind).alias("entity_type"))

    users = table(spark, sf_dir, "events").select("user_id").distinct()
    out = of(table(spark, sf_dir, "customer"), "C:", "c_custkey", F.col("c_name"), "PERSON")
    out = out.unionByName(of(table(spark, sf_dir, "supplier"), "S:", "s_suppkey", F.col("s_name"), "ORGANIZATION"))
    out = out.unionByName(of(table(spark, sf_dir, "nation"), "N:", "n_nationkey", F.col("n_name"), "LOCATION"))
    out = out.unionByName(of(table(spark, sf_dir, "region"), "R:", "r_regionkey", F.col("r_name"), "LOCATION"))
    return out.unionByName(of(users, "U:", "user_id", F.concat(F.lit("User "), "user_id"), "PERSON"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, community, role: users dealt over five gangs; every tenth leads."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("U:"), "user_id").alias("node"), F.concat(F.lit("G"), F.col("user_id") % 5).alias("community"), F.when(F.col("user_id") % 10 == 0, "boss").otherwise("soldier").alias("role"))


def meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meeting_id, location, ts, attendees (sorted): users whose events of one hour name the same place."""
    rows = table(spark, sf_dir, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"), F.regexp_extract("props", r'"k": ([0-9]+)', 1).alias("location"), F.concat(F.lit("U:"), "user_id").alias("node"))
    met = rows.groupBy("ts", "location").agg(F.sort_array(F.collect_set("node")).alias("attendees")).where(F.size("attendees") >= 2)
    return met.select(F.concat(F.lit("M-"), F.date_format("ts", "yyyyMMddHH"), F.lit("-"), "location").alias("meeting_id"), "location", "ts", "attendees")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence_id, source_type, record_id, text, ts, nodes: calls and conversation turns."""

    def ident(kind: str, record: Column) -> Column:
        return F.concat(F.lit("E-"), F.substring(F.sha2(F.concat(F.lit(f"{kind}|"), record), 256), 1, 16))

    c = calls(spark, sf_dir)
    record = F.concat(F.lit("CALL-"), F.col("event_id"))
    seen = c.select(ident("CALL", record).alias("evidence_id"), F.lit("CALL").alias("source_type"), record.alias("record_id"), F.concat("src", F.lit(" made a "), "relation", F.lit(" call to "), "dst").alias("text"), "ts", F.array("src", "dst").alias("nodes"))
    t = table(spark, sf_dir, "conversations")
    record = F.concat(F.lit("CONV-"), F.col("conv_id"), F.lit("-"), F.col("turn"))
    said = t.select(ident("CONVERSATION", record).alias("evidence_id"), F.lit("CONVERSATION").alias("source_type"), record.alias("record_id"), "text", F.lit(None).cast("timestamp_ntz").alias("ts"), F.array(F.concat(F.lit("U:"), F.col("conv_id") % 150)).alias("nodes"))
    return seen.unionByName(said)
