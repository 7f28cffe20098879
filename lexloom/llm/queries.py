"""The operators' queries over the whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import ball_tree, bpe, decontam, dual_tree, html_template, impact_index, line_dedup, minhash, mpeg, suffix_dedup, token_shards, toxicity, warc
from lexloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(_table(spark, sf_dir, "documents"))


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg.media_features(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op6_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(_table(spark, sf_dir, "pages"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.report(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster(_table(spark, sf_dir, "embeddings"))


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top_k(_table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_minhash_near_dedup, op2_mpeg_audio, op3_toxicity, op4_bpe_transducer, op5_suffix_dedup, op6_html_template, op7_token_shards, op8_line_dedup, op9_decontamination, op10_warc_revisit, op11_dual_tree_lloyd, op12_impact_topk, op13_hard_negatives)}
SQL: dict[str, str] = {
    "op5_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_decontamination": decontam.ORACLE_SQL,
    "op10_warc_revisit": warc.ORACLE_SQL,
    "op11_dual_tree_lloyd": dual_tree.ORACLE_SQL,
    "op12_impact_topk": impact_index.ORACLE_SQL,
    "op13_hard_negatives": ball_tree.ORACLE_SQL,
}
