"""Registry of the training-data queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinset.llm import conversation, decontam, linerules, lm, mixing, quality, resample, simhash, surrogates, tokencount, toxicity, urlfilter, warc
from kinset.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op8_benchmark_decontamination"] = decontam.ORACLE


@_query
def op9_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.judged(table(spark, sf_dir, "documents"))


ORACLES["op9_line_quality_rules"] = linerules.ORACLE


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(table(spark, sf_dir, "documents"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


@_query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(table(spark, sf_dir, "documents"))


ORACLES["op3_mix_sources"] = mixing.ORACLE


@_query
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.query(table(spark, sf_dir, "documents"))


@_query
def op4_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.query(table(spark, sf_dir, "pages"))


ORACLES["op4_warc_capture_index"] = warc.ORACLE


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.query(table(spark, sf_dir, "pages"))


ORACLES["op12_url_filters"] = urlfilter.ORACLE


@_query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance_resampling"] = resample.ORACLE


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.query(table(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_repair"] = conversation.ORACLE
