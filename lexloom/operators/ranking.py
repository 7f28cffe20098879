"""Deterministic sampling and exact ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators.staging import written


def hash_order(seed: int | str, *keys: Column | str) -> Column:
    """A text that orders rows at random but the same in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys).cast("binary"))


def hash_fraction(order: Column) -> Column:
    """A number from 0 to 1 of such a text."""
    return F.conv(F.left(order, F.lit(8)), 16, 10).cast("double") / (1 << 32)


def hash_rank(df: DataFrame, order: Column, within: list[str] | None = None, digits: int = 3, name: str = "rank") -> DataFrame:
    """Ranks from 1 by ``order`` (a hex text), over all rows or within groups, and the groups' sizes
    as n. Rows are dealt by the first digits of their order, so no group, however hot, is one task;
    the sizes before each part come from a table of at most 16**digits rows for each group."""
    keys = within or []
    parted = df.withColumn("__o", order).withColumn("__p", F.left("__o", F.lit(digits)))
    sizes = parted.groupBy(*keys, "__p").agg(F.count("*").alias("__n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).withColumn("n", F.sum("__n").over(whole)).drop("__n")
    ranked = parted.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__p").orderBy("__o")))
    return ranked.join(offsets, [*keys, "__p"]).withColumn(name, F.col("__r") + F.col("__before")).drop("__o", "__p", "__r", "__before")


def sorted_places(df: DataFrame, order: list[str], name: str = "place", partitions: int | None = None) -> DataFrame:
    """Places from 1 in the order of these columns, any among rows that are equal in them. Rows are cut
    into ranges by a sample of the whole order, not by its beginnings, and rows that are equal are cut
    by a random number as well, so neither a beginning nor a value that half of all rows have makes
    a range larger than others. They are sorted and written once, with their place in their range; what
    comes before a range is a sum over as many numbers as there are ranges."""
    spark = df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(ranges, *order, "__tie").sortWithinPartitions(*order, "__tie")
    kept = written(dealt.drop("__tie").withColumn("__id", F.monotonically_increasing_id()), "places")
    part, here = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for r in kept.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():
        before.append((r.p, total))
        total += r.n
    offsets = spark.createDataFrame(before, "__p long, __before long")
    return kept.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(name, here + F.col("__before") + 1).drop("__p", "__before", "__id")
