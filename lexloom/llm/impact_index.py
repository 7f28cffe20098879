"""Exact top-k search by an impact-ordered, score-at-a-time index (operator 12).

Rows are packed where they lie into blocks (``vectors``); each has an index of its own. A posting says
that a row's component in one dimension has a certain quantised impact: its sign and its magnitude,
cut to a multiple of the block's step, of which there are ``LEVELS`` at most. Postings of one
dimension, sign and magnitude are a segment, and segments are laid out by descending magnitude.

A wave of queries goes through a block's segments in that order: each adds its impact times the
queries' component to the accumulators of its rows. At ``STOPS`` places the index also knows, for each
row, the length of what is still missing of its vector, postings that are to come and what quantising
cut off alike. By Cauchy and Schwarz a score then differs from its accumulator by at most that length
times the query's, so each query has a proven floor under its k-th best score, and a proven ceiling
over every row. Rows under the floor are out. Once few enough rows are left (``LEFT``), or the
segments are at an end, the rest of the segments is not read, and the rows that are left are scored
exactly, in whole numbers. The stop only decides when that happens: what is dropped is always proven
to be under k others, and ties are never dropped.

A task goes on with the floors that earlier blocks gave it; its k best rows of each query go to a
ranking that Spark cuts before it shuffles. Queries are read from the index itself and broadcast in
waves of ``WAVE_BYTES``. Every block is a row of a written table, so a lost executor costs a re-read.

Defined results: a query is a row whose id is divisible by ``every``; a null id is no query, but is
found, and ranks after other ids of equal score; rows that share an id are queries and candidates of
their own, and only the query's own row is not a candidate; ties go to the smaller id; vectors that
are null or hold a null or non-finite component take no part; of vectors of unequal length the shorter
goes on with zeros, so an empty one scores 0; scores are exact within a long, with components held
within ``vectors.MOST``; a table without queries or candidates gives an empty result; other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm._text import dumped, lean, loaded
from lexloom.llm.storage import materialise
from lexloom.llm.vectors import SLACK, Block, exact_kind, firsts, pack, queries_of, waves_of, widened

SCALE, EVERY, K = 64, 20, 20
LEVELS = 64
#: Shares of a block's postings after which its missing lengths are known.
STOPS = (0.3, 0.45, 0.6, 0.75, 0.9, 1.0)
#: A block's search ends when no more than this share of its rows can still be members.
LEFT = 0.03
#: Queries that go through a block together, and pairs scored exactly at once.
TOGETHER, PAIRS = 256, 1 << 15


def index_of(block: Block) -> dict[str, bytes]:
    """The block, and its index: segments (dimension, impact, end of its postings) in order, rows of the
    postings, the number of segments before each stop, and the missing lengths there."""
    x = block.x.astype(np.int64)
    n, dims = x.shape
    step = max(1, -(-(int(np.abs(x).max(initial=0)) + 1) // LEVELS))
    level = np.abs(x) // step
    row, dim = np.nonzero(level)
    impact = np.sign(x[row, dim]) * level[row, dim] * step
    order = np.lexsort((row, impact, dim, -np.abs(impact)))
    row, dim, impact = row[order], dim[order], impact[order]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(dim) != 0) | (np.diff(impact) != 0)])) if len(row) else np.zeros(0, np.int64)
    ends = np.concatenate([heads[1:], [len(row)]]) if len(row) else heads
    stops = np.unique(np.concatenate([[len(ends)], np.searchsorted(ends, [s * len(row) for s in STOPS[:-1]], "left") + 1 if len(ends) else []]).clip(0, len(ends)).astype(np.int64))
    missing = np.zeros((len(stops), n))
    rest, at = x.copy(), 0
    for i, s in enumerate(stops.tolist()):
        upto = int(ends[s - 1]) if s else 0
        rest[row[at:upto], dim[at:upto]] -= impact[at:upto]
        missing[i], at = np.sqrt((rest.astype(np.float64) ** 2).sum(1)), upto
    segments = np.stack([dim[heads], impact[heads], ends], 1) if len(row) else np.zeros((0, 3), np.int64)
    return {"block": block.dump(), "index": dumped(segments.astype(np.int64), row.astype(np.int32), stops, missing)}


def search(block: Block, body: bytes, q: Block, floors: np.ndarray, k: int, left: float = LEFT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Pairs (query, row, exact score) among which are all that can be members of a query's k best, and
    how many postings were read. ``floors`` holds proven k-th best scores, and rises."""
    segments, rows, stops, missing = loaded(body, "i8", "i4", "i8", "f8")
    segments, missing = segments.reshape(-1, 3), missing.reshape(len(stops), -1)
    width = max(block.x.shape[1], q.x.shape[1])
    x, y = widened(block.x, width), widened(q.x, width)
    length = np.sqrt((y.astype(np.float64) ** 2).sum(1)) * (1 + SLACK)
    kind = np.int32 if exact_kind(x, y) is np.float32 else np.int64
    scores = np.zeros((len(x), len(y)), kind)
    weights = np.ascontiguousarray(y.T.astype(kind))
    done = at = 0
    for i, stop in enumerate(stops.tolist()):
        for dim, impact, end in segments[done:stop].tolist():
            scores[rows[at:end]] += weights[dim] * impact
            at = end
        done = stop
        off = missing[i][:, None] * length * (1 + SLACK)
        if len(x) > k:  # one of the k + 1 best may be the query's own row
            floors[:] = np.maximum(floors, np.partition(scores - off, len(x) - k - 1, axis=0)[len(x) - k - 1])
        able = scores + off >= floors - SLACK * np.abs(floors)
        if i + 1 == len(stops) or np.count_nonzero(able) <= left * able.size:
            break
    r, c = np.nonzero(able)
    own = block.row[r] == q.row[c]
    r, c = r[~own], c[~own]
    exact = np.concatenate([np.zeros(0, np.int64), *(np.einsum("ij,ij->i", x[r[i : i + PAIRS]].astype(np.int64), y[c[i : i + PAIRS]].astype(np.int64)) for i in range(0, len(r), PAIRS))])
    return c, r, exact, at


def _hits(blocks: DataFrame, wave: Block, k: int, left: float) -> DataFrame:
    """Per task the k best rows of each query: query (its row's number), query_id, vec_id, score."""
    shared = blocks.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        floors = np.full(len(q.row), -np.inf)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))  # query, score, has, id
        for batch in batches:
            for body, index in zip(batch.column("block").to_pylist(), batch.column("index").to_pylist(), strict=True):
                block = Block.load(body)
                found = [best]
                for a in range(0, len(q.row), TOGETHER):
                    own = slice(a, min(a + TOGETHER, len(q.row)))
                    c, r, score, _ = search(block, index, q.take(own), floors[own], k, left)
                    found.append((c + a, score, block.has[r], block.ids[r]))
                key, score, has, ids = (np.concatenate(x) for x in zip(*found, strict=True))
                some = firsts(key, score, has, ids, k)
                best = tuple(x[some] for x in (key, score, has, ids))
                full = np.bincount(best[0], minlength=len(floors)) >= k
                worst = np.full(len(floors), np.iinfo(np.int64).max)
                np.minimum.at(worst, best[0], best[1])
                floors[full] = np.maximum(floors[full], worst[full])
        key, score, has, ids = best
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array(q.row[key]), pa.array(q.ids[key]), pa.array(ids, mask=~has), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return blocks.select("block", "index").mapInArrow(lean(run), "query long, query_id long, vec_id long, score long")


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The index: a table of blocks."""
    return pack(vectors, "impact-index", scale, index_of, id_col, vector_col)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE, left: float = LEFT) -> DataFrame:
    """Per query and rank: query_id, rank, id, score."""
    spark = vectors.sparkSession
    index = build(vectors, id_col, vector_col, scale)
    schema = "query_id long, rank int, vec_id long, score long"
    out = None
    for wave in waves_of(queries_of(index, every)):
        order = W.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        ranked = _hits(index, wave, k, left).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kept, _ = materialise(ranked.select("query_id", "rank", "vec_id", "score"), "top")
        out = kept if out is None else out.union(kept)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("vec_id", id_col)


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
