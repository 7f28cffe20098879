"""Corpus profiling, filters, stratified subsets and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import first_token
from lexloom.operators.ranking import hash_fraction, hash_order, hash_rank

RATE = 0.42


def unsegmented(flag: Column, rule: str = "empty_or_no") -> Column:
    """Whether a yes/no/empty flag counts as unsegmented."""
    flag = F.coalesce(flag, F.lit(""))
    return {"empty_or_no": flag.isin("", "no"), "empty": flag == "", "no": flag == "no", "not_yes": flag != "yes"}[rule]


def require_fields(df: DataFrame, names: list[str]) -> DataFrame:
    """These columns, with the empty text for null."""
    return df.select(*(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in names))


def drop_blank(df: DataFrame, names: list[str], trim: bool = True) -> DataFrame:
    keep = F.lit(True)
    for n in names:
        c = F.coalesce(F.col(n), F.lit(""))
        keep = keep & ((F.trim(c) if trim else c) != "")
    return df.where(keep)


def remove_matching(df: DataFrame, **values: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows in which all these columns have these values are removed."""
    hit = F.lit(True)
    for k, v in values.items():
        hit = hit & F.col(k).eqNullSafe(v)
    return df.where(~hit), df.where(hit)


def route_by_code(text: Column, keep: tuple[str, ...], deny: tuple[str, ...]) -> Column:
    """keep, remove, other or blank, by the first token; the keep list wins."""
    code = F.lower(first_token(text, ""))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "blank").when(code.isin(*keep), "keep").when(code.isin(*deny), "remove").otherwise("other")


def group_stats(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """Per group: rows, and rows by a three-valued flag."""
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(flag).alias("segmented"), F.count_if(F.coalesce(~flag, F.lit(True))).alias("unsegmented"))


def stratified_subset(df: DataFrame, key: str, privileged: tuple[str, ...], id_col: str, rate: float = RATE, seed: int = 42) -> DataFrame:
    """All rows of privileged groups, and of each other max(1, floor(rate * n)) rows."""
    ranked = hash_rank(df, hash_order(seed, F.col(id_col).cast("string")), [key])
    size = F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.lit(rate) * F.col("n"))))
    return ranked.where(F.col(key).isin(*privileged) | (F.col("rank") <= size)).drop("rank", "n")


def bernoulli_subset(df: DataFrame, id_col: str, rate: float = RATE, seed: int = 42) -> DataFrame:
    return df.where(hash_fraction(hash_order(seed, F.col(id_col).cast("string"))) < rate)


def split(df: DataFrame, id_col: str, shares: tuple[float, float] = (0.8, 0.1), seed: int = 42) -> DataFrame:
    """Column split: train, valid and test by exact shares (floors; the rest is test)."""
    ranked = hash_rank(df, hash_order(seed, F.col(id_col).cast("string")))
    train, valid = F.floor(F.col("n") * shares[0]), F.floor(F.col("n") * shares[1])
    return ranked.withColumn("split", F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + valid, "valid").otherwise("test")).drop("rank", "n")


def two_stratum_split(df: DataFrame, id_col: str, special: Column, seed: int = 42) -> DataFrame:
    """Special rows: 8/9 train and the rest valid; others 80/10/10."""
    ranked = hash_rank(df.withColumn("special", special), hash_order(seed, F.col(id_col).cast("string")), ["special"])
    n, r = F.col("n"), F.col("rank")
    other = F.when(r <= F.floor(n * 0.8), "train").when(r <= F.floor(n * 0.8) + F.floor(n * 0.1), "valid").otherwise("test")
    return ranked.withColumn("split", F.when(F.col("special"), F.when(r <= F.floor(n * 8 / 9), "train").otherwise("valid")).otherwise(other)).drop("rank", "n")


def head_tail_split(df: DataFrame, line_col: str, n: int, share: float = 0.9, fallback: int = 100) -> DataFrame:
    """Lines from 0 to n - 1: the head trains, the tail evaluates. Where the share leaves no tail,
    the last ``fallback`` lines evaluate, and train as well."""
    head = int(n * share)
    if head < n:
        return df.withColumn("split", F.when(F.col(line_col) < head, "train").otherwise("eval"))
    return df.withColumn("split", F.lit("train")).unionByName(df.where(F.col(line_col) >= max(0, n - fallback)).withColumn("split", F.lit("eval")))


def first_of_splits(df: DataFrame, split_col: str, order: tuple[str, ...], by: list[str], columns: list[str]) -> DataFrame:
    """The first row, by ``by``, of the first of these splits that has any."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col(split_col))
    best = F.min_by(F.struct(split_col, *columns), F.struct(rank, *by))
    return df.where(F.col(split_col).isin(*order)).agg(best.alias("r")).where("r is not null").select("r.*")


def subtotals(df: DataFrame, key: str, special: Column) -> DataFrame:
    """Rows of each group, and of all special ones against the rest (groups null)."""
    counts = df.groupBy(F.col(key).alias("key"), F.coalesce(special, F.lit(False)).alias("special")).agg(F.count("*").alias("cnt"))
    return counts.unionByName(counts.groupBy("special").agg(F.sum("cnt").alias("cnt")).withColumn("key", F.lit(None).cast(counts.schema["key"].dataType)))


def kept_and_skipped(df: DataFrame, names: list[str]) -> DataFrame:
    """How many rows have text in all of these columns, and how many are skipped."""
    good = F.lit(True)
    for n in names:
        good = good & (F.trim(F.coalesce(F.col(n), F.lit(""))) != "")
    return df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("skipped"))


def from_line(df: DataFrame, line_col: str, resume: int) -> DataFrame:
    """Lines from the 1-based ``resume`` on; what is under 1 means all."""
    return df.where(F.col(line_col) >= max(0, resume - 1))


def key_summary(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Of keys in df and wanted ones: how many there are, are found, rows that have one, and the
    percentages of keys and of rows."""
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt"))
    met = rows.join(wanted.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__w", F.lit(True)), key, "full")
    found = F.col("cnt").isNotNull() & F.col("__w").isNotNull()
    out = met.agg(F.count("cnt").alias("keys"), F.count("__w").alias("wanted"), F.count_if(found).alias("found"), F.coalesce(F.sum(F.when(found, F.col("cnt"))), F.lit(0)).alias("rows_found"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("rows"))
    share = lambda a, b: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("keys_percent", share("found", "wanted")).withColumn("rows_percent", share("rows_found", "rows"))


def sample_per_group(df: DataFrame, keys: list[str], id_col: str, k: int, seed: int = 42) -> DataFrame:
    return hash_rank(df, hash_order(seed, F.col(id_col).cast("string")), keys).where(F.col("rank") <= k).drop("rank", "n")


def share_by_split(df: DataFrame, split_col: str, key: str) -> DataFrame:
    """Rows of each group in each split, and their share of the split."""
    counts = df.groupBy(split_col, key).agg(F.count("*").alias("cnt"))
    totals = counts.groupBy(split_col).agg(F.sum("cnt").alias("of"))
    return counts.join(F.broadcast(totals), split_col).withColumn("share", F.col("cnt") / F.col("of"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows of each key, and their percentage of all."""
    counts = df.groupBy(key).agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("__all"))
    return counts.join(F.broadcast(total)).select(key, "cnt", (100.0 * F.col("cnt") / F.col("__all")).cast("double").alias("percentage"))


def seen_unseen(df: DataFrame, key: str, is_train: Column) -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.bool_or(is_train), F.lit(False)).alias("seen"), F.count("*").alias("cnt"))


def coverage_of_keys(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted keys with their rows in df; 0 where missing (semi and anti join at once)."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt"))
    return wanted.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("cnt", F.lit(0)).alias("cnt"), F.col("cnt").isNotNull().alias("found"))
