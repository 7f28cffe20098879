"""Exact cosine top-k of a stated query set, as blocked matrix products.

Candidates are dealt evenly over tasks, whatever files they lie in, and meet the broadcast queries in
blocks of bounded size. A product of unit vectors in single precision says which pairs can be among a
query's k best; its error is bounded by the number of components, so none is lost. Only these are
scored, in double precision and in the order of the components as ``metrics.cosine`` does, so scores,
and places that depend on their last digit, are the same. A task goes on with the k-th best score that
earlier blocks gave it, and Spark ranks what the tasks return.

Each pair of a query and a candidate costs one multiplication of each component, so the work grows
with the product of the two; memory does not. Queries are broadcast in waves of ``WAVE_BYTES``.

Defined results, as those of ``metrics.cosine``: a pair scores 0 if a vector is null, holds a null
component or has no length, or if the two are of unequal length; not a number is the highest score;
candidates equal to the query are left out (null is equal to null); ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of queries that are broadcast at once, rows and components of a block, queries that are
#: multiplied together, pairs that are scored at once, and decimal places of a score.
WAVE_BYTES, BLOCK_ROWS, BLOCK_CELLS, TOGETHER, PAIRS, PLACES = 16 << 20, 4096, 1 << 20, 256, 1 << 15, 6


def _summed(products: np.ndarray) -> np.ndarray:
    """Sums of the rows, one component after the other."""
    out = np.zeros(len(products))
    for column in products.T:
        out += column
    return out


@dataclass(slots=True)
class Group:
    """Vectors of one length without null components: which rows they are, their components, norms,
    unit vectors in single precision, and the rows whose products these do not bound."""

    at: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    unit: np.ndarray
    wild: np.ndarray

    @staticmethod
    def of(at: np.ndarray, x: np.ndarray) -> Group:
        with np.errstate(all="ignore"):
            norm = np.sqrt(_summed(x * x))
            tame = (norm > 1e-100) & (norm < 1e100)
            unit = np.where(tame[:, None], x / norm[:, None], 0).astype(np.float32)
        return Group(at, x, norm, unit, ~tame & (norm != 0))

    def part(self, a: int, b: int) -> Group:
        return Group(self.at[a:b], self.x[a:b], self.norm[a:b], self.unit[a:b], self.wild[a:b])


def _split(column: pa.ListArray) -> tuple[list, dict[int, Group]]:
    """A key for each row, the same for equal vectors, and the vectors by length."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    valid = np.asarray(column.is_valid())
    missing = np.asarray(column.values.is_null())
    flat = np.asarray(column.values.fill_null(0), np.float64) + 0.0  # no negative zeros
    flat[np.isnan(flat)] = np.nan
    holes = np.concatenate([[0], np.cumsum(missing)])[offsets]
    sound = valid & (np.diff(holes) == 0)
    raw, cuts = flat.tobytes(), (offsets * 8).tolist()
    keys: list = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for i in np.flatnonzero(~sound).tolist():
        keys[i] = (keys[i], missing[offsets[i] : offsets[i + 1]].tobytes()) if valid[i] else None
    sizes = np.diff(offsets)
    groups = {}
    for size in np.unique(sizes[sound]).tolist():
        at = np.flatnonzero(sound & (sizes == size))
        groups[size] = Group.of(at, flat[offsets[at][:, None] + np.arange(size)].reshape(len(at), size))
    return keys, groups


def _scores(x: Group, y: Group, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = [np.zeros(0)]
    with np.errstate(all="ignore"):
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            by = x.norm[p] * y.norm[q]
            out.append(np.where(by == 0, 0.0, _summed(x.x[p] * y.x[q]) / by))
    return np.concatenate(out)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of the last place, halves up as in decimal, not a number highest."""
    units = score * 10**PLACES
    out = np.floor(units + 0.5)
    with np.errstate(invalid="ignore"):
        close = np.flatnonzero(np.abs(units + 0.5 - np.rint(units + 0.5)) < 1e-6)
    for i in close.tolist():
        out[i] = float((Decimal(repr(float(score[i]))) * 10**PLACES).to_integral_value(ROUND_HALF_UP))
    return np.where(np.isnan(score), np.inf, np.where(np.isinf(score), np.copysign(np.finfo(float).max, score), out))


class Search:
    """The k best rows of each query of a wave, block by block."""

    def __init__(self, queries: pa.ListArray, k: int):
        self.k, self.n = k, len(queries)
        keys, self.groups = _split(queries)
        self.equal: dict = {}
        for i, key in enumerate(keys):
            self.equal.setdefault(key, []).append(i)
        odd = np.setdiff1d(np.arange(self.n), np.concatenate([np.zeros(0, np.int64), *(g.at for g in self.groups.values())]))
        self.groups[-1] = Group.of(odd, np.zeros((len(odd), 0)))  # these score 0 with all rows
        self.best = np.full((self.n, k), -np.inf)

    def block(self, ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Triples of queries, rows of the block, and scores."""
        keys, groups = _split(vectors)
        seen: dict = {}
        kept = []  # in the order of ids; of equal vectors the first k
        for r in pc.array_sort_indices(ids, null_placement="at_start").to_pylist():
            n = seen.get(keys[r], 0)
            if n < self.k:
                kept.append(r)
                seen[keys[r]] = n + 1
        rows = np.array(kept, np.int64)
        same = [(i, place) for place, r in enumerate(kept) for i in self.equal.get(keys[r], ())]
        same_q, same_r = np.array(same, np.int64).reshape(-1, 2).T
        for size, group in self.groups.items():
            mine = groups.get(size)
            local = np.full(len(keys), -1)
            if mine is not None:
                local[mine.at] = np.arange(len(mine.at))
            local = local[rows]
            for a in range(0, len(group.at), TOGETHER):
                yield from self._part(group.part(a, a + TOGETHER), size, mine, local, rows, same_q, same_r)

    def _part(self, q: Group, size: int, x: Group | None, local: np.ndarray, rows: np.ndarray, same_q: np.ndarray, same_r: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        k, slack = self.k, (max(size, 0) + 8) * 1.2e-7
        met = np.flatnonzero(local >= 0)
        near = np.zeros((len(q.at), len(rows)), np.float32)
        wild = np.zeros(len(rows), bool)
        if len(met) == len(rows) and x is not None:
            near = q.unit @ x.unit[local].T
        elif x is not None:
            near[:, met] = q.unit @ x.unit[local[met]].T
        if x is not None:
            wild[met] = x.wild[local[met]]
        back = np.full(self.n, -1)
        back[q.at] = np.arange(len(q.at))
        own = back[same_q] >= 0
        gone = back[same_q[own]], same_r[own]
        near[gone] = -np.inf
        near[:, wild] = -np.inf
        bound = (self.best[q.at].min(1) - 0.5) / 10**PLACES - slack
        new = np.flatnonzero(np.isneginf(bound))
        if len(new) and len(rows) > k:
            bound[new] = np.partition(near[new], len(rows) - k, axis=1)[:, len(rows) - k] - 2 * slack - 2 * 0.1**PLACES
        able = near >= np.where(np.isfinite(bound), np.nextafter(bound.astype(np.float32), np.float32(-np.inf)), bound.astype(np.float32))[:, None]
        able[:, wild] = True
        able[q.wild] = True
        able[gone] = False
        i, r = np.nonzero(able)
        if not len(i):
            return
        score = np.zeros(len(i))
        exact = np.flatnonzero(local[r] >= 0)
        if x is not None:
            score[exact] = _scores(x, q, local[r[exact]], i[exact])
        units = _rounded(score)
        order = np.lexsort((r, -units, i))
        i, r, score, units = i[order], r[order], score[order], units[order]
        heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        rank = np.arange(len(i)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(i)]])))
        top = rank < k
        i, r, score, units, rank = i[top], r[top], score[top], units[top], rank[top]
        found = np.full((len(q.at), k), -np.inf)
        found[i, rank] = units
        self.best[q.at] = np.sort(np.concatenate([self.best[q.at], found], 1), axis=1)[:, -k:]
        left = units >= self.best[q.at].min(1)[i]
        yield q.at[i[left]], rows[r[left]], score[left]


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in parts of bounded rows and components."""
    ends = np.asarray(batch.column("vector").offsets).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, ends[at] + BLOCK_CELLS, "right")) - 1
        n = max(1, min(upto - at, BLOCK_ROWS))
        yield batch.slice(at, n)
        at += n


def _whole(column: pa.ListArray) -> pa.ListArray:
    """The column with its values from 0 on, and nothing under its nulls."""
    return pa.concat_arrays([column.take(pa.array(np.arange(len(column))))])


def hits(queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """(query_id, cand_id, score) among which are the k best candidates of each query. queries
    (query_id, query) are broadcast at once; pool is (cand_id, cand)."""
    spark = pool.sparkSession
    stated = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow().combine_chunks()
    names = [stated.column(c).chunk(0) if stated.num_rows else pa.array([], stated.schema.field(c).type) for c in ("query_id", "query")]
    shared = spark.sparkContext.broadcast(tuple(names))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        search = None
        for batch in batches:
            for block in _blocks(batch):
                search = search or Search(_whole(vectors), k)
                cand = block.column("id")
                for q, r, score in search.block(cand, _whole(block.column("vector"))):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), cand.take(pa.array(r)), pa.array(score)], names=["query_id", "cand_id", "score"])

    dealt = pool.select(F.col("cand_id").alias("id"), F.col("cand").alias("vector")).repartition(parts)
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("cand_id", pool.schema["cand_id"].dataType), T.StructField("score", T.DoubleType())])
    return dealt.mapInArrow(run, schema)


def waves(queries: DataFrame) -> list[DataFrame]:
    """The queries in parts of about ``WAVE_BYTES``."""
    cells = queries.agg(F.sum(F.coalesce(F.size("query"), F.lit(0)) + 8)).first()[0] or 0
    n = max(1, -(-8 * cells // WAVE_BYTES))
    return [queries] if n == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) for b in range(n)]
