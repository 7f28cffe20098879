"""Verdicts on dictionary pairs: parsing, validation, summary and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.parse import correction, validated, verdict


def assessed(rows: DataFrame, response: str = "response") -> DataFrame:
    """Columns verdict and correction of rows (source, target, response), after validation."""
    said, fix = validated(F.col("source"), F.col("target"), F.col("__v"), F.col("__c"))
    raw = rows.withColumn("__v", verdict(F.col(response))).withColumn("__c", correction(F.col(response)))
    return raw.withColumn("verdict", said).withColumn("correction", fix).drop("__v", "__c")


def summary(rows: DataFrame) -> DataFrame:
    right, wrong = F.count_if(F.col("verdict") == "CORRECT"), F.count_if(F.col("verdict") == "INCORRECT")
    fixed = F.count_if((F.col("verdict") == "INCORRECT") & (F.col("correction") != ""))
    out = rows.agg(F.count("*").alias("total"), right.alias("correct"), wrong.alias("incorrect"), fixed.alias("corrected"))
    return out.withColumn("unclear", F.col("total") - F.col("correct") - F.col("incorrect")).withColumn("accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))).withColumn("correction_rate", F.coalesce(F.try_divide("corrected", "incorrect"), F.lit(0.0)))


def clean_dictionary(rows: DataFrame) -> DataFrame:
    """Right pairs, and wrong ones with their correction."""
    right = rows.where("verdict = 'CORRECT'").select("source", "target")
    return right.union(rows.where("verdict = 'INCORRECT' and correction <> ''").select("source", "correction"))


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a result yet, to resume a run."""
    return rows.join(done.select(key), key, "left_anti")
