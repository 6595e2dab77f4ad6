"""The queries opN_<name> of this package: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import license_scan, media, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, toxicity, url_filters
from linkloom.llm.common import read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(read(spark, sf_dir, "documents")).drop("n_upper", "n_exclaim", "n_stops", "n_lines")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: the bytes of each text are taken as a recording of 8-bit samples."""
    return media.align(read(spark, sf_dir, "documents"), "text", "doc_id")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.summary(read(spark, sf_dir, "documents"))
    return found.drop("spans")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs).select("doc_id", "source", F.col("n_chars"), "slot", "shard")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_media_columns, op4_mixing, op5_ngram_join, op6_packing, op7_url_filters, op8_license_scan, op9_sharding, op10_toxicity)}
ORACLE_SQL = {"op4_mixing": mixing.ORACLE_SQL, "op5_ngram_join": ngram_join.ORACLE_SQL, "op7_url_filters": url_filters.ORACLE_SQL}
