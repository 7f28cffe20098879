"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.storage import drop, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (a, b): (id, component), the smallest id of each component, for every id that an
    edge has. Each step writes at most one row for each edge; steps go on until none changes, about
    the logarithm of the longest path. Nothing is collected. The centre of a large component is a hot
    key: its minima are partial aggregates, and of its joins adaptive execution splits the large side."""
    spark = edges.sparkSession
    low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    current, path = materialise(edges.where("a <> b").select(low, high).distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: every larger neighbour of a hangs on a's smallest, or on a itself
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a's smaller neighbours, and a, hang on the smallest of them
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        tops = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(tops, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b")).where("a <> b").distinct()
        following, next_path = materialise(small, "edges")
        drop(spark, path)
        mark = following.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        current, path = following, next_path
        if mark == before:
            return current.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(current.select("a", "a").distinct().toDF("id", "component"))
        before = mark
