"""Similarity retrieval for few-shot prompts: a stated set of queries against all candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions.metrics import chrf
from lexloom.functions.parse import example_section, filled
from lexloom.operators import cosine
from lexloom.operators.staging import written


BLOCK = 2000


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "cand_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def jaccard_topk(queries: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """The k candidates with most of their tokens in common, through an inverted index.

    queries (query_id, tokens) and pool (cand_id, tokens) hold distinct tokens. Only candidates
    that share a token are scored; common tokens are split between tasks by adaptive execution."""
    q = queries.select("query_id", F.size("tokens").alias("nq"), F.explode("tokens").alias("token"))
    c = pool.select("cand_id", F.size("tokens").alias("nc"), F.explode("tokens").alias("token"))
    shared = c.join(q, "token").groupBy("query_id", "cand_id").agg(F.count("*").alias("both"), F.first("nq").alias("nq"), F.first("nc").alias("nc"))
    return _top(shared.withColumn("score", F.col("both") / (F.col("nq") + F.col("nc") - F.col("both"))), k).select("query_id", "cand_id", "score", "rank")


def scored_topk(queries: DataFrame, pool: DataFrame, score, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The k best candidates by any score of (query, candidate) columns. The stated query set is
    broadcast in blocks of about ``block`` queries, and each block reads the candidates once. Texts
    that are equal but for case are left out."""
    n = max(1, -(-queries.count() // block))
    fold = lambda c: F.lower(c) if dict(queries.dtypes)["query"] == "string" else F.col(c)
    out = None
    for b in range(n):
        part = queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        pairs = pool.join(F.broadcast(part), ~fold("query").eqNullSafe(fold("cand")))
        best = _top(pairs.select("query_id", "cand_id", score(F.col("query"), F.col("cand")).alias("score")), k)
        out = best if out is None else out.union(best)
    return out


def chrf_topk(queries: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    return scored_topk(queries, pool, chrf, k)


def cosine_topk(queries: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """The k candidates with the highest cosine (``metrics.cosine``, to six places), without those that
    are equal to the query. Several waves of queries are written one after another, so that one at a
    time is in the driver's memory."""
    parts = cosine.waves(queries)
    out = None
    for part in parts:
        best = _top(cosine.hits(part, pool, k).withColumn("score", F.round("score", cosine.PLACES)), k)
        best = best if len(parts) == 1 else written(best, "cosine")
        out = best if out is None else out.union(best)
    return out


def refilled(best: DataFrame, queries: DataFrame, pool: DataFrame, score, k: int = 3, block: int = BLOCK) -> DataFrame:
    """The k examples of each query: first those that a retriever found (query_id, cand_id, score),
    texts equal to the query but for case left out, then the best of the rest, down to k."""
    fold = lambda c: F.lower(F.col(c))
    first = best.join(queries, "query_id").join(pool, "cand_id").where(~fold("query").eqNullSafe(fold("cand"))).select("query_id", "cand_id", "score", F.lit(0).alias("turn"))
    rest = scored_topk(queries, pool, score, k + best.groupBy("query_id").count().agg(F.max("count")).first()[0] if best.limit(1).count() else k, block).select("query_id", "cand_id", "score", F.lit(1).alias("turn"))
    rest = rest.join(first.select("query_id", "cand_id"), ["query_id", "cand_id"], "left_anti")
    order = W.partitionBy("query_id").orderBy("turn", F.desc("score"), "cand_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "cand_id", "score", "rank")


def random_examples(queries: DataFrame, pool: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """k examples of each query, drawn by hash; texts equal to the query but for case are left out.
    Each candidate meets each stated query once, and only k of a task go on."""
    draw = lambda q, c: F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("query_id").cast("string"), F.col("cand_id").cast("string")).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return scored_topk(queries, pool, draw, k)


#: What begins and ends a template's examples, and its place for the input.
EXAMPLES_BEGIN = ("Here are some examples", "Here are examples", "Example 1:", "Examples:")
EXAMPLES_END = ("Now translate", "translate the following", "Translate the following")
INPUT_PLACE = "{input_text}"


def template_parts(template: str) -> tuple[str, str]:
    """What a template has before its examples, with the line that opens them, and after, from the
    line that closes them on. Without both, it is cut before the line with the input's place. Lines
    with translation tags inside the examples belong to these."""
    lines = template.split("\n")
    begin = next((i for i, x in enumerate(lines) if any(m in x for m in EXAMPLES_BEGIN)), None)
    end = None if begin is None else next((i for i, x in enumerate(lines) if i > begin and any(m in x for m in EXAMPLES_END)), None)
    if end is None:
        place = next((i for i, x in enumerate(lines) if INPUT_PLACE in x), len(lines))
        return "\n".join(lines[:place]), "\n".join(lines[place:])
    return "\n".join(lines[: begin + 1]), "\n".join(lines[end:])


def prompts(top: DataFrame, queries: DataFrame, pool: DataFrame, template: str) -> DataFrame:
    """A prompt for each query: its examples in order of rank, then its input."""
    item = F.struct("rank", F.col("input"), F.col("output"))
    examples = top.join(pool.select("cand_id", "input", "output"), "cand_id").groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("examples"))
    return queries.join(examples, "query_id", "left").select("query_id", filled(template, examples=F.coalesce(example_section(F.col("examples")), F.lit("")), input_text=F.col("query")).alias("prompt"))
