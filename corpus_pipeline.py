"""A training corpus from raw documents, in five stages.

Each stage is called with what its predecessor kept, written as Parquet and read again. All but
the last return the columns of ``documents``; the last returns the token ids.

Defined results, of every stage: null and empty texts are clean and stay (near dedup keeps one of those
that are equal); rows with a null id stay, rows with repeated ids are judged by their own texts; a text
of any length is read whole; an empty table gives an empty result; further columns may have any name
and are carried along. What an operator says of ties and repeated rows in its module holds here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, decontam, line_dedup, minhash, toxicity
from lexloom.llm.storage import materialise
from lexloom.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, calls toxic go."""
    ship_package(spark)
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents that were nothing else."""
    ship_package(spark)
    return line_dedup.dedup_lines(docs)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    ship_package(spark)
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of benchmark words go, and documents that are little else."""
    ship_package(spark)
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, token_ids."""
    ship_package(spark)
    return bpe.encode(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near_copies),
    ("decontamination", decontaminate),
    ("bpe encoding", encode),
]

#: SQL cannot express a trained classifier, nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
