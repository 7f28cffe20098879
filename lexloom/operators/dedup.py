"""Order-preserving exact de-duplication and duplicate reports.

Keys travel as 128-bit hashes and ids, never as texts; originals are a partial minimum, so a key
that a third of all rows share does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_hash(*columns: Column | str) -> Column:
    """A hash of the columns' values; null differs from empty."""
    return F.md5(F.to_json(F.struct(*columns)).cast("binary"))


def first_ids(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Per key: key, first id, occurrences."""
    return df.select(F.col(id_col), key.alias("key")).groupBy("key").agg(F.min(id_col).alias("first_id"), F.count("*").alias("cnt"))


def keep_first(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """The first row of each key, by id."""
    return df.join(first_ids(df, id_col, key).select(F.col("first_id").alias(id_col)), id_col, "left_semi")


def later_occurrences(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Each repeat: id, first_id of its key, occurrences."""
    rows = df.select(F.col(id_col), key.alias("key"))
    return rows.join(first_ids(df, id_col, key).where("cnt > 1"), "key").where(F.col(id_col) > F.col("first_id")).drop("key")


def duplicate_groups(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Per repeated key: first id, count, excess. Occurrences are in ``later_occurrences``, a row
    each, and in ``occurrence_lists``."""
    return first_ids(df, id_col, key).where("cnt > 1").select("first_id", "cnt", (F.col("cnt") - 1).alias("excess"))


def occurrence_lists(df: DataFrame, at: list[str], key: Column, per_row: int = 1000) -> DataFrame:
    """Per repeated key: places, its occurrences in order, as <at...> structs. A list with more than
    ``per_row`` places goes on in further rows (part 0, 1, ...), so no row grows with a hot key;
    all places are there."""
    place = F.struct(*at)
    rows = df.select(place.alias("place"), key.alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("cnt"), F.min("place").alias("first")).where("cnt > 1")
    # a long list is dealt by hash, each part sorted by itself
    parts = F.ceil(F.col("cnt") / per_row)
    dealt = rows.join(sizes, "key").withColumn("part", F.pmod(F.xxhash64("place"), parts))
    return dealt.groupBy("key", "part").agg(F.first("first").alias("first"), F.first("cnt").alias("cnt"), F.sort_array(F.collect_list("place")).alias("places")).drop("key")


def duplicated_keys(df: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Entries, distinct keys, keys that repeat, and entries beyond the first of each."""
    groups = first_ids(df, id_col, key)
    return groups.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("entries"), F.count("*").alias("uniq"), F.count_if(F.col("cnt") > 1).alias("duplicated"), F.coalesce(F.sum(F.col("cnt") - 1), F.lit(0)).alias("excess"))


def across_groups(df: DataFrame, group: str, id_col: str, key: Column) -> DataFrame:
    """Keys that occur in two groups or more: first id, groups, rows."""
    by = df.select(F.col(id_col), F.col(group), key.alias("key")).groupBy("key", group).agg(F.min(id_col).alias("first_id"), F.count("*").alias("cnt"))
    return by.groupBy("key").agg(F.min("first_id").alias("first_id"), F.count("*").alias("groups"), F.sum("cnt").alias("cnt")).where("groups > 1").drop("key")
