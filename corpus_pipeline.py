"""Training-data pipeline over ``documents``: five stages, in order.

Each stage takes what its predecessor kept, whole texts and all columns; all
but the last return the columns of their input. ``run`` writes every stage's
result to the shared folder and reads it again, so a lost executor repeats one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graded.llm import bpe, secret_scan, simhash, templates, toxicity
from graded.llm.catalog import tokenizer_path
from graded.llm.common import read_table, written


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier rejects go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return templates.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found in a text is masked, and n_chars set anew."""
    return secret_scan.redact(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and of the text decoded from them, as digests."""
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_filter),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("BPE encoding and decoding", bpe_encoding),
]

#: A trained classifier, a merge loop and fingerprints aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
