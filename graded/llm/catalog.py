"""Queries of the operators in this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, lexical, linkgraph, oracle, phrases, pii, secret_scan, simhash, suffixes, syncmers, templates, toxicity, warc, wavelet
from .common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(read_table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(read_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed tokenizer file lies, on every machine alike."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(read_table(spark, sf_dir, "documents"))


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints_with_edits(read_table(spark, sf_dir, "documents"))


def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.write_and_read(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_link_graph_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.filter_urls(read_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_warc_archives": op2_warc_archives,
    "op3_secret_scan": op3_secret_scan,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_template_decontamination": op5_template_decontamination,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_syncmer_fingerprints": op7_syncmer_fingerprints,
    "op8_simhash_components": op8_simhash_components,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_link_graph_filter": op10_link_graph_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_personal_data": op13_personal_data,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
