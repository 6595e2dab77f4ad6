"""Batch stages by name: python -m linkloom.stages STAGE INPUT OUTPUT, or `all`; each reads and writes tables only.

generate, preprocess, extract, graph, ghosts, evidence, findings, anomalies, embeddings, financial_patterns.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import evidence, extraction, flows, ghosts, links, network, profiles, search, temporal
from linkloom.operators.graph import structural_holes
from linkloom.sources import loaders, tables

PEOPLE = 1000


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def generate(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Raw tables from the CSV files of the source folder where there are any, else generated ones."""
    return tables.read_all_raw(spark, source) or loaders.generate(spark, PEOPLE)


def preprocess(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Observations as sentences, cleaned, with copies marked and a language."""
    p, c, t, m = (_read(spark, out, n) for n in ("persons", "calls", "transactions", "meetings"))
    attendees = m.withColumn("attendees", F.filter(F.split("attendee_ids", r"\|"), lambda x: x != "")) if dict(m.dtypes)["attendee_ids"] == "string" else m.withColumnRenamed("attendee_ids", "attendees")
    calls = c.select(F.col("call_id").alias("record"), F.col("caller_id").alias("src"), F.col("receiver_id").alias("dst"), F.col("timestamp").alias("ts"), F.col("duration_sec").cast("double").alias("value"))
    paid = t.select(F.col("transaction_id").alias("record"), F.col("sender_id").alias("src"), F.col("receiver_id").alias("dst"), F.col("timestamp").alias("ts"), F.col("amount").alias("value"), F.col("account_id").alias("account"))
    met = attendees.select(F.col("meeting_id").alias("record"), F.col("timestamp").alias("ts"), "attendees")
    records = extraction.observations(calls, paid, met, p.select(F.col("person_id").alias("id"), F.col("full_name").alias("name")))
    rows = records.join(extraction.cleaned(records, "text", "record_id"), "record_id")
    edges = extraction.structured_triplets(calls, paid, met)
    dated = calls.select("record", "ts", "value").unionByName(paid.select("record", "ts", "value")).unionByName(met.select("record", "ts", F.lit(None).cast("double").alias("value")))
    return {"records": rows, "triplets": edges.join(dated, "record")}


def extract(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Relations that the sentences state, beside the structured ones."""
    found = extraction.triplets(_read(spark, out, "records"), "cleaned", "record_id")
    return {"stated": found, "events": extraction.events(found, "record_id")}


def graph(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Nodes, edges and communities."""
    t = _read(spark, out, "triplets")
    edges = t.select(F.concat_ws("|", "record", "relation", "source", "target").alias("edge_id"), F.col("source").alias("src"), F.col("target").alias("dst"), "relation", "ts", F.lit(1.0).alias("confidence"), "value").distinct()  # who pays themselves uses an account twice
    p = _read(spark, out, "persons").select(F.col("person_id").alias("id"), F.col("full_name").alias("label"), F.lit("PERSON").alias("entity_type"))
    accounts = t.where("target_type = 'ACCOUNT'").select(F.col("target").alias("id"), F.col("target").alias("label"), F.lit("ACCOUNT").alias("entity_type")).distinct()
    tied = edges.where("relation IN ('CALLED', 'MET')")
    return {"edges": edges, "nodes": p.unionByName(accounts), "communities": network.louvain(tied)}


def infer(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Pairs of communities and the intermediaries they may hide."""
    e, n = _read(spark, out, "edges"), _read(spark, out, "nodes")
    m = _read(spark, out, "communities").withColumn("community", F.col("community").cast("string"))
    c = structural_holes(e.where("relation IN ('CALLED', 'MET')"))
    top = c.agg(F.max("constraint").alias("top"))
    holes = c.join(F.broadcast(top)).select("node", (1 - F.col("constraint") / F.col("top")).alias("hole"))  # one row
    return {"ghosts": ghosts.evaluate(e, n, m, holes)}


def index(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Evidence records and their inverted index."""
    r = _read(spark, out, "records")
    t = _read(spark, out, "triplets").groupBy("record").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("source", "target"))))).alias("nodes"), F.min("ts").alias("ts"))
    e = r.join(t, F.col("record_id") == F.col("record")).select(F.concat(F.lit("E-"), F.substring(F.sha2("record_id", 256), 1, 16)).alias("evidence_id"), F.upper("record_type").alias("source_type"), "record_id", F.col("cleaned").alias("text"), "ts", "nodes")
    return {"evidence": e, "postings": evidence.postings(e)}


def findings(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Findings on proposed ghosts, with their broken rules."""
    g, e = _read(spark, out, "ghosts"), _read(spark, out, "evidence")
    m = _read(spark, out, "communities").withColumn("community", F.col("community").cast("string"))
    touched = ghosts.contacts(_read(spark, out, "edges"), _read(spark, out, "nodes"), m)
    a = ghosts.shared_anchors(touched).select("anchor", "community")
    p = g.where("proposed")
    both = p.select("ghost_id", F.explode(F.array("a", "b")).alias("community")).join(a, "community").groupBy("ghost_id", F.col("anchor").alias("node")).agg(F.countDistinct("community").alias("k")).where("k = 2").select("ghost_id", "node")
    found = evidence.findings(p, both, e.select("evidence_id", F.explode("nodes").alias("node")))
    return {"findings": found, "violations": evidence.integrity(found, e)}


def anomalies(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Bursts of outgoing edges."""
    e = _read(spark, out, "edges").where("ts IS NOT NULL").select(F.col("src").alias("entity"), "ts")
    return {"bursts": temporal.burst_z(e, "entity"), "hours": temporal.synchronized_hours(e, "entity")}


def vectors(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Node vectors."""
    return {"vectors": links.embeddings(_read(spark, out, "edges"))}


def patterns(spark: SparkSession, source: str, out: str) -> dict[str, DataFrame]:
    """Patterns of transfers, and flows with their evidence."""
    e = search.transfer_edges(_read(spark, out, "edges"))
    tx = e.select("src", "dst", F.col("value").cast("decimal(18,4)").alias("amount"), "ts")
    return {"smurfing": flows.smurfing(tx), "layering": flows.layering(tx), "flows": profiles.flows_with_evidence(e)}


STAGES: dict[str, Callable[[SparkSession, str, str], dict[str, DataFrame]]] = {
    "generate": generate, "preprocess": preprocess, "extract": extract, "graph": graph, "ghosts": infer, "evidence": index, "findings": findings, "anomalies": anomalies, "embeddings": vectors, "financial_patterns": patterns,
}


def run(spark: SparkSession, names: list[str], source: str, out: str) -> dict[str, float]:
    """Runs stages in order; seconds by stage. A stage replaces its tables."""
    took = {}
    for name in names:
        start = time.time()
        for table, df in STAGES[name](spark, source, out).items():
            df.write.mode("overwrite").parquet(f"{out}/{table}")
        took[name] = round(time.time() - start, 3)
    return took


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=[*STAGES, "all"])
    p.add_argument("source")
    p.add_argument("out")
    given = p.parse_args()
    spark = SparkSession.builder.getOrCreate()
    print(run(spark, list(STAGES) if given.stage == "all" else [given.stage], given.source, given.out))


if __name__ == "__main__":
    main()
