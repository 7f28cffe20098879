"""Token-ID / binary output: training-order materialisation (operator 7).

Each text is encoded with the same vocabulary as in operator 4 (pieces by a compiled library, as
the transducer is not asked for here) and cut into sequences of ``seq_len`` ids, the last padded.
Documents are dealt by the first digits of a hash of their id and ids, and sorted by it within each
part; the parts' counts (one number a part) give each its offset, so the sequences are numbered 0 to
n-1 in an order that depends on the documents alone, however the input is split. A keyed Feistel permutation on the smallest even
number of bits that holds n, walked along its cycle until it falls below n, gives every sequence
its global slot, a bijection that needs no table. Slots are range-partitioned, sorted, and packed
into shards of ``per_shard`` records of one fixed stride, so the record of slot s is in shard
s // per_shard at byte (s % per_shard) * stride, and a reader can go on from any slot.

Record: little-endian int64 document id, uint32 number of the sequence in its document, uint32
count of ids, then ``seq_len`` ids (uint16 if the vocabulary allows, else uint32), padded with 0.

Shards are rows of a Parquet table (shard, first_slot, n_slots, stride, data), committed by Spark's
writer, so a lost executor only repeats its tasks. Defined results: null and empty texts make no
sequence; a null id is stored as -1; rows with equal ids and other texts are documents of their own,
and so are repeated rows; ids are integers; an empty table makes no shard; columns other than id and
text may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm import bpe
from lexloom.llm._text import fmix, lean, pieces
from lexloom.llm.storage import drop, fresh_path, materialise

SEQ_LEN = 512
PER_SHARD = 1024
#: About so much text is numbered in a part, in so many parts at most, whose counts are broadcast. The
#: number of parts is that of the whole text by this, so equal tables have equal orders.
PART_BYTES, MOST_PARTS = 8_000_000, 100_000
KEY = 0x5EED_0F_0DD
ROUNDS = 6
_U = np.uint64
HEAD = np.dtype([("doc", "<i8"), ("part", "<u4"), ("n", "<u4")])


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The slots of these numbers under the keyed permutation of 0 to n-1."""
    half = _U(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (_U(1) << half) - _U(1)
    keys = fmix(np.arange(1, rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) ^ _U(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (fmix(right ^ k) & mask)
        return left << half | right

    out = once(index.astype(_U))
    while (far := np.flatnonzero(out >= _U(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


class QuickBPE(bpe.ByteBPE):
    """Pieces by tiktoken, where ids are in the order of the merges, which is what it goes by."""

    def __init__(self, spec: dict):
        super().__init__(spec)
        ids = {b: i for i, b in spec["tokens"]}
        made = [ids[a + b] for a, b in spec["merges"]]
        ordered = all(a < b for a, b in zip(made, made[1:], strict=False))
        self._core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ids, special_tokens={})._core_bpe if ordered else None

    def piece(self, text: str) -> tuple[int, ...]:
        if self._core is None:
            return super().piece(text)
        return tuple(self._core.encode_single_piece(text.encode("utf-8", "surrogatepass")))


def stride_of(seq_len: int, width: int) -> int:
    return HEAD.itemsize + seq_len * width


def _encoded(docs: DataFrame, shared, parts: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per document with ids: p, its part, order in it, doc, ids as bytes."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.of_worker(shared, QuickBPE)
        for batch in pieces(batches, "body", 150_000):
            ids, bounds = coder.encode([t or "" for t in batch.column("body").to_pylist()])
            live = np.flatnonzero(np.diff(bounds))
            raw = ids.astype(f"<u{width}")
            body = pa.array([raw[bounds[k] : bounds[k + 1]].tobytes() for k in live], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(live)), body], names=["doc", "ids"])

    made = slim.mapInArrow(lean(run, "bpe"), "doc long, ids binary").withColumn("order", F.xxhash64("doc", "ids"))
    return made.withColumn("p", F.pmod(F.shiftrightunsigned("order", 20), F.lit(parts)).cast("int"))


def _numbered(encoded: DataFrame, seq_len: int, width: int) -> DataFrame:
    """p, start (its first sequence's number in the part), parts, doc, ids."""
    rows = encoded.withColumn("parts", F.ceil(F.octet_length("ids") / (seq_len * width)))
    upto = F.sum("parts").over(W.partitionBy("p").orderBy("order", "doc", "ids").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("p", (upto - F.col("parts")).alias("start"), "parts", "doc", "ids")


def _slotted(encoded: DataFrame, offsets: dict[int, int], total: int, seq_len: int, width: int, key: int) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride, room = stride_of(seq_len, width), seq_len * width
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                parts = np.asarray(batch.column("parts"))
                if not len(parts):
                    continue
                part = np.concatenate([np.arange(p) for p in parts])
                first = np.asarray(batch.column("start")) + np.array([shared.value[t] for t in batch.column("p").to_pylist()])
                slots = permute(np.repeat(first, parts) + part, total, key)
                block = np.zeros((len(part), stride), np.uint8)
                head = np.zeros(len(part), HEAD)
                head["doc"], head["part"] = np.repeat(np.asarray(batch.column("doc")), parts), part
                raws = batch.column("ids").to_pylist()
                sizes = np.array([len(r) for r in raws])
                head["n"] = np.minimum(np.repeat(sizes, parts) - part * room, room) // width
                block[:, : HEAD.itemsize] = head.view(np.uint8).reshape(len(part), -1)
                k = 0
                for raw, p in zip(raws, parts.tolist(), strict=True):
                    padded = np.zeros(p * room, np.uint8)
                    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
                    block[k : k + p, HEAD.itemsize :] = padded.reshape(p, room)
                    k += p
                records = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((np.arange(len(part) + 1) * stride).astype(np.int32)), pa.py_buffer(block)])
                yield pa.RecordBatch.from_arrays([pa.array(slots), records], names=["slot", "record"])

    return encoded.mapInArrow(lean(run), "slot long, record binary")


SHARD = "shard long, first_slot long, n_slots long, stride long, data binary"


def _packed(slotted: DataFrame, total: int, per_shard: int, stride: int, partitions: int) -> DataFrame:
    """Shards of the sorted records. Partitions are ranges of whole shards; as slots are 0 to total - 1,
    their bounds are known, and no sample is taken."""
    shards = -(-total // per_shard)
    dealt = slotted.withColumn("range", F.floor(F.floor(F.col("slot") / per_shard) * partitions / shards).cast("int"))
    ordered = dealt.repartitionById(partitions, "range").select("slot", "record").sortWithinPartitions("slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, slots, data = None, [], []

        def closed() -> pa.RecordBatch:
            own = np.concatenate(slots)
            if (np.diff(own) != 1).any():
                raise ValueError(f"shard {open_} has a gap")
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (open_, int(own[0]), len(own), stride)] + [pa.array([b"".join(data)], pa.binary())], names=["shard", "first_slot", "n_slots", "stride", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own, records = np.asarray(batch.column("slot")), batch.column("record")
            at = np.frombuffer(records.buffers()[1], np.int32)[records.offset : records.offset + len(records) + 1]
            raw = memoryview(records.buffers()[2])
            shard = own // per_shard
            heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            for x, y in zip(heads, [*heads[1:], len(own)], strict=True):
                if shard[x] != open_:
                    if slots:
                        yield closed()
                    open_, slots, data = int(shard[x]), [], []
                slots.append(own[x:y])
                data.append(bytes(raw[at[x] : at[y]]))
        if slots:
            yield closed()

    return ordered.mapInArrow(lean(run), SHARD)


def write(docs: DataFrame, path: str, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD, key: int = KEY) -> int:
    """Write the shards below ``path``; the number of sequences."""
    spark = docs.sparkSession
    spec = bpe.load(vocabulary or bpe.default_vocabulary())
    width = 2 if max([i for i, _ in spec["tokens"]] + [*spec["special"].values()]) < 1 << 16 else 4
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(MOST_PARTS, max(8, -(-size // PART_BYTES)))
    encoded, kept = materialise(_numbered(_encoded(docs, spark.sparkContext.broadcast(spec), parts, width, id_col, text_col), seq_len, width), "tokens")
    counts = encoded.groupBy("p").agg(F.max(F.col("start") + F.col("parts")).alias("n")).orderBy("p").collect()
    offsets, total = {}, 0
    for r in counts:
        offsets[r.p], total = total, total + r.n
    partitions = max(1, min(-(-total // per_shard), -(-total * stride_of(seq_len, width) // (32 << 20))))
    slotted = _slotted(encoded, offsets, total, seq_len, width, key)
    _packed(slotted, max(1, total), per_shard, stride_of(seq_len, width), partitions).write.option("compression", "zstd").parquet(path)
    drop(spark, kept)
    return total


def read(spark: SparkSession, path: str, from_slot: int = 0, seq_len: int = SEQ_LEN, per_shard: int = PER_SHARD) -> DataFrame:
    """Records from a slot on: slot, doc, part, n, crc32 of the ids' bytes. No shard has more than
    ``per_shard``, so Parquet's own bounds rule out those that end before the slot."""
    shards = spark.read.schema(SHARD).parquet(path).where((F.col("first_slot") > from_slot - per_shard) & (F.col("first_slot") + F.col("n_slots") > from_slot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, stride, data in zip(*(batch.column(c).to_pylist() for c in ("first_slot", "n_slots", "stride", "data")), strict=True):
                width = (stride - HEAD.itemsize) // seq_len
                block = np.frombuffer(data, np.uint8).reshape(n, stride)
                head = np.ascontiguousarray(block[:, : HEAD.itemsize]).view(HEAD).reshape(-1)
                crc = [zlib.crc32(block[i, HEAD.itemsize : HEAD.itemsize + int(head["n"][i]) * width]) for i in range(n)]
                out = pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), pa.array(head["doc"]), pa.array(head["part"].astype(np.int64)), pa.array(head["n"].astype(np.int64)), pa.array(crc, pa.int64())], names=["slot", "doc", "part", "n", "crc32"])
                yield out.slice(max(0, from_slot - first))

    return shards.select("first_slot", "n_slots", "stride", "data").mapInArrow(lean(run), "slot long, doc long, part long, n long, crc32 long")


def report(docs: DataFrame, id_col: str = "doc_id", per_shard: int = PER_SHARD, seq_len: int = SEQ_LEN, **how) -> DataFrame:
    """The shards written in the shared folder and read back: slot, shard, id, part, n_tokens,
    crc32."""
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    write(docs, path, id_col=id_col, per_shard=per_shard, seq_len=seq_len, **how)
    return read(spark, path, seq_len=seq_len, per_shard=per_shard).select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), F.col("doc").alias(id_col), "part", F.col("n").alias("n_tokens"), "crc32")
