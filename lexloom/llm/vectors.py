"""Whole-number vectors in packed blocks, for the operators that search or cluster vectors (11 to 13).

A component x becomes floor(scale * x), x as double, kept within ``MOST`` on either side (an |x| of a
million at a scale of 64), so that scores and squared distances fit a long. Rows whose vector is null,
or holds a null or non-finite component, take no part. Rows are packed where they lie, without a
shuffle, into blocks of a bounded number of rows and components; one block is one row of a Parquet
table. Each row that takes part has a number of its own, so a row can be told from another with the
same id. A vector that is shorter than others counts as if it went on with zeros.

A stated query set is dealt into waves of bounded bytes, each broadcast by itself; a wave meets every
block once, and keeps the best hits of each query in a task, which are merged by a ranking that Spark
cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm._text import dumped, lean, loaded
from lexloom.llm.storage import materialise

MOST = 1 << 26
#: Rows and components of a block at most (one row may have more components), and rows that one task packs.
BLOCK_ROWS, BLOCK_CELLS, TASK_ROWS = 2048, 1 << 18, 1 << 16
#: Bytes of queries that are broadcast at once.
WAVE_BYTES = 8 << 20
#: Relative slack of bounds that are computed in floating point.
SLACK = 1e-9


@dataclass(slots=True)
class Block:
    """Rows of a table: their numbers, ids (0 where null), whether they have one, labels, and vectors
    as whole numbers, one row each."""

    row: np.ndarray
    ids: np.ndarray
    has: np.ndarray
    label: np.ndarray
    x: np.ndarray

    def take(self, at: np.ndarray | slice) -> Block:
        return Block(self.row[at], self.ids[at], self.has[at], self.label[at], self.x[at])

    def dump(self) -> bytes:
        return dumped(self.row, self.ids, self.has, self.label, np.array(self.x.shape, np.int64), self.x)

    @staticmethod
    def load(body: bytes) -> Block:
        row, ids, has, label, shape, x = loaded(body, "i8", "i8", "?", "i8", "i8", "i4")
        return Block(row, ids, has, label, x.reshape(shape))


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -MOST, MOST).astype(np.int32)


def _usable(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a vector of finite components, and where each one's lie in the values."""
    col = batch.column("vector")
    offsets = np.asarray(col.offsets).astype(np.int64)
    flat = col.values
    bad = np.asarray(flat.is_null()) | ~np.isfinite(np.asarray(flat.fill_null(0), np.float64))
    wrong = np.concatenate([[0], np.cumsum(bad)])
    live = np.flatnonzero(np.asarray(col.is_valid()) & (wrong[offsets[1:]] == wrong[offsets[:-1]]))
    return live, offsets[live], offsets[live + 1]


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[Block]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 36
    held: list[tuple] = []
    width = rows = 0

    def closed() -> Block:
        x = np.zeros((rows, width), np.int32)
        at = 0
        for _, _, _, starts, ends, flat in held:
            sizes = ends - starts
            where = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            x[np.repeat(np.arange(at, at + len(sizes)), sizes), where - np.repeat(starts, sizes)] = whole_numbers(flat[where], scale)
            at += len(sizes)
        ids, has, label = (np.concatenate([h[i] for h in held]) for i in range(3))
        return Block(number + np.arange(rows), ids, has, label, x)

    for batch in batches:
        live, starts, ends = _usable(batch)
        flat = np.asarray(batch.column("vector").values.fill_null(0))
        ids, label = (np.asarray(batch.column(c).fill_null(0))[live].astype(np.int64) for c in ("id", "label"))
        has = np.asarray(batch.column("id").is_valid())[live]
        at = 0
        while at < len(live):
            upto = np.maximum.accumulate(np.maximum(width, ends[at:] - starts[at:]))
            fits = (rows + np.arange(1, len(upto) + 1) <= BLOCK_ROWS) & ((rows + np.arange(1, len(upto) + 1)) * upto <= BLOCK_CELLS)
            n = len(fits) if fits.all() else int(np.argmin(fits))
            if not n and rows:
                yield closed()
                number, held, width, rows = number + rows, [], 0, 0
                continue
            own = slice(at, at + max(1, n))
            held.append((ids[own], has[own], label[own], starts[own], ends[own], flat))
            width, rows, at = int(upto[max(1, n) - 1]), rows + max(1, n), at + max(1, n)
    if rows:
        yield closed()


def pack(table: DataFrame, label: str, scale: int, build: Callable[[Block], dict[str, bytes]], id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column | None = None) -> DataFrame:
    """The table of blocks: ``rows``, and for each name that ``build`` returns a binary column."""
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    slim = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), (F.lit(0) if label_col is None else F.col(label_col) if isinstance(label_col, str) else label_col).cast("long").alias("label"))
    parts = max(spark.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))
    empty = Block(*(np.zeros(0, k) for k in ("i8", "i8", "?", "i8")), np.zeros((0, 0), np.int32))
    names = list(build(empty))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, scale):
            made = build(block)
            yield pa.RecordBatch.from_arrays([pa.array([len(block.row)], pa.int64()), *(pa.array([made[n]], pa.binary()) for n in names)], names=["rows", *names])

    schema = ", ".join(["rows long", *(f"{n} binary" for n in names)])
    return materialise(slim.coalesce(parts).mapInArrow(lean(run), schema), label)[0]


def queries_of(blocks: DataFrame, every: int, column: str = "block", labelled: bool = False) -> DataFrame:
    """Blocks of the rows whose id is divisible by ``every``, as rows (wave, n, query), in waves of
    about ``WAVE_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(column).to_pylist():
                block = Block.load(body)
                own = block.take(np.flatnonzero(block.has & (block.ids % every == 0)))
                if len(own.row):
                    yield pa.RecordBatch.from_arrays([pa.array([own.x.nbytes + 25 * len(own.row)], pa.int64()), pa.array([own.dump()], pa.binary())], names=["bytes", "query"])

    made, _ = materialise(blocks.select(column).mapInArrow(lean(run), "bytes long, query binary"), "queries")
    total = made.agg(F.sum("bytes")).first()[0] or 0
    waves = max(1, -(-total // WAVE_BYTES))
    return made.select(F.pmod(F.xxhash64("query"), F.lit(waves)).cast("int").alias("wave"), "query")


def waves_of(queries: DataFrame) -> Iterator[Block]:
    """One wave after another; only one is in the driver's memory."""
    for (wave,) in sorted(map(tuple, queries.select("wave").distinct().collect())):
        yield joined([Block.load(r.query) for r in queries.where(F.col("wave") == wave).collect()])


def joined(blocks: list[Block]) -> Block:
    width = max((b.x.shape[1] for b in blocks), default=0)
    return Block(*(np.concatenate([getattr(b, f) for b in blocks]) for f in ("row", "ids", "has", "label")), np.concatenate([widened(b.x, width) for b in blocks]))


def widened(x: np.ndarray, width: int) -> np.ndarray:
    """Vectors of ``width`` components: cut, or gone on with zeros. Cut components meet zeros only."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The fastest number type in which inner products of these are exact."""
    most = (int(np.abs(a).max(initial=0)) + 1) * (int(np.abs(b).max(initial=0)) + 1) * max(1, a.shape[1])
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def firsts(key: np.ndarray, score: np.ndarray, has: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each key the places of its ``most`` highest scores, ties to smaller ids, null ids last."""
    order = np.lexsort((ids, ~has, -score, key))
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    rank = np.arange(len(key)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(key)]])))
    return order[rank < most]
