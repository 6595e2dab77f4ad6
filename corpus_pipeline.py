"""A corpus pipeline of five stages: classify, apply rules, drop near-duplicates, mix sources, pack.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame; all
but the last return the columns of documents. run() writes each stage's result as Parquet in the shared
folder and reads it again for the next.

Defined results: a null or empty text is rejected by the rules at the latest; without labels the classifier
accepts all rows; rows with a null id pass the stages like others and are never linked; rows that repeat id
and text count as one from the third stage on; an empty table gives an empty result. Columns besides
doc_id, text and source are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import mixing, ngram_join, packing, quality_classifier, quality_rules
from linkloom.llm.common import materialize, read, sweep, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality network rejects."""
    return quality_classifier.keep_accepted(docs, quality_classifier.fit(docs, read(spark, sf_dir, "labels")))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weakly supervised rules reject."""
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.one_of_each(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mixing_sources", mix_sources),
    ("packing", pack),
]

#: SQL can't express the classifier, the expectation-maximisation or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result. What a stage read and wrote besides its result is deleted once that is written."""
    docs = read(spark, sf_dir, "documents")
    start = written()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        sweep(spark, start, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
