"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles (operator 1).

A shingle is a run of five words; its weight in a text is how often it occurs times the mean
inverse document frequency of its words, 1 + ln((1+N)/(1+df)) / ln(2+N), which lies between 1 and
2, so that copies of copies do not lose each other as a group grows. Document frequencies are
counted exactly over all documents, by 64-bit hash. Those of the ``KNOWN`` most frequent words at
most are broadcast; the rarer ones, where there are more, share their mean.

For each of BANDS * ROWS samples, improved consistent weighted sampling draws of every shingle
r, c ~ Gamma(2,1) and beta ~ U(0,1) from its hash, t = floor(ln w / r + beta), and
ln a = ln c - r (t - beta + 1); the smallest a, which names (shingle, t), is the sample. Two texts
agree in a sample with the probability of their weighted Jaccard similarity.

Equal texts are one class from the start and send one row. Texts that agree in a whole band meet in
a bucket. Buckets are read in sorted order and each emits a linear number of candidates: the
edges of its maximum spanning forest by estimated similarity, and where that leaves doubt the three
best partners of each text. A bucket over ``MOST`` texts is dealt anew by samples of each of the next
bands (``FINER``), which similar texts share, and if need be into parts that have the bucket's first
text in common; this is for the candidates only. Each is verified by the exact weighted Jaccard
similarity of the whole texts; verified links at ``threshold`` or more make classes, as connected
components.

Then the whole buckets, of any size, that still hold several classes are gone through in blocks, parts
of the texts that are not of the bucket's largest class against parts of all its texts. Texts with a
partner in another class whose estimate is within ``DOUBT`` of the threshold are compared anew,
exactly, against all such texts of the bucket, by postings of their shingles; a block returns only
the links that join classes, never its pairs. So no two texts that share a bucket lose a link to the
choice of candidates.

Defined results: null counts as empty; texts without words belong together if they are equal; a
text with fewer than five words is one shingle; null ids are left out of the classes; rows with one
id and different texts are judged by their own texts; an empty table gives none; columns other than
id and text may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import Words, fmix, lean, pieces, shingles
from lexloom.llm.components import connected_components
from lexloom.llm.storage import drop, materialise

SIZE = 5
THRESHOLD = 0.8
BANDS, ROWS = 19, 5
KNOWN = 1 << 18
MOST = 512
FINER = (4, 3)  # a large bucket is dealt anew by this many bands, each by so many of its samples
DOUBT = 0.18
BLOCK = 256, 2048  # texts of a part of a bucket that ask, and that are asked, by their samples
BLOCK_BYTES = 500_000, 2_000_000  # the same for whole texts, in bytes
HELD_BYTES = 8_000_000
SENT = 1_000_000  # ids of candidates that are broadcast at most; beyond, they are joined by shuffle
_U = np.uint64


@dataclass
class Frequencies:
    """Documents that have a word: of the most frequent words by sorted hash, and the mean of others."""

    words: np.ndarray
    df: np.ndarray
    others: float
    n: int

    def weights(self) -> np.ndarray:
        """Inverse document frequency of each word, and at the end of any other."""
        return 1 + np.log((1 + self.n) / (1 + np.append(self.df, self.others))) / np.log(2 + self.n)


def document_frequencies(docs: DataFrame, text_col: str = "text", known: int = KNOWN) -> Frequencies:
    """How many documents have each word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = n = 0

        def counted(n: int) -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate([np.zeros(0, _U), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(words.view(np.int64), 0)), pa.array(np.append(counts, n)), pa.array(np.arange(len(words) + 1) == len(words))], names=["word", "n", "all"])

        for batch in pieces(batches, "body"):
            words = Words(batch.column("body"))
            row = np.repeat(np.arange(batch.num_rows, dtype=_U), np.diff(words.rows))
            _, one = np.unique(fmix(words.hashes + row * _U(0x9E3779B97F4A7C15)), return_index=True)
            held.append(words.hashes[one])
            n += batch.num_rows
            size += len(words.buf)
            if size > HELD_BYTES:
                yield counted(n)
                held, size, n = [], 0, 0
        if n:
            yield counted(n)

    rows = docs.select(F.col(text_col).alias("body")).mapInArrow(lean(run), "word long, n long, all boolean")
    counts, counts_at = materialise(rows.groupBy("word", "all").agg(F.sum("n").alias("n")).withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "frequencies")
    levels = sorted(((r.level, r.words, r.n) for r in counts.where("not all").groupBy("level").agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    sizes = np.cumsum([w for _, w, _ in levels]) if levels else np.zeros(0, int)
    kept = int((sizes <= known).sum())
    rest = levels[kept:]
    least = levels[kept - 1][0] if kept else 1 << 20
    table = counts.where(~F.col("all") & (F.col("level") >= least)).select("word", "n").toArrow()
    total = counts.where("all").agg(F.sum("n")).first()[0] or 0
    drop(docs.sparkSession, counts_at)
    words, df = table.column("word").to_numpy().view(_U), table.column("n").to_numpy()
    order = np.argsort(words)
    return Frequencies(words[order], df[order], sum(n for *_, n in rest) / max(1, sum(w for _, w, _ in rest)), int(total))


def weighted_shingles(words: Words, idf: tuple[np.ndarray, np.ndarray], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles' hashes and weights, by row and hash, and each row's range of them. idf:
    sorted hashes of words, and their weights, with that of other words at the end."""
    h, bounds = shingles(words, size)
    known, weight = idf
    at = np.searchsorted(known, words.hashes)
    own = np.where(np.append(known, _U(0))[at] == words.hashes, weight[at], weight[-1])
    sums = np.concatenate([[0.0], np.cumsum(own)])
    counts = np.diff(words.rows)
    made = np.diff(bounds)
    first = np.repeat(words.rows[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(counts, size), made)
    mean = (sums[first + length] - sums[first]) / np.maximum(length, 1)
    row = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((h, row))
    h, row, mean = h[order], row[order], mean[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return h[at], np.round(mean[at], 9) * tf, np.searchsorted(row[at], np.arange(len(made) + 1))


def _gamma2(n: int) -> np.ndarray:
    """Quantiles of Gamma(2,1), by Newton's method on 1 - exp(-x)(1+x)."""
    u = (np.arange(n) + 0.5) / n
    x = np.maximum(np.sqrt(2 * u), -np.log1p(-u))
    for _ in range(60):
        x = np.maximum(x - (1 - np.exp(-x) * (1 + x) - u) / (x * np.exp(-x) + 1e-300), 1e-9)
    return x


_tables: list[np.ndarray] = []


def signatures(h: np.ndarray, weight: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """k samples for each row that has shingles, as 16-bit values; 0 for rows without."""
    if not _tables:
        quantiles = _gamma2(1 << 16)
        _tables.extend([quantiles, np.log(quantiles)])
    r_of, ln_c_of = _tables
    out = np.zeros((len(bounds) - 1, k), np.uint16)
    live = np.flatnonzero(np.diff(bounds))
    if not len(live):
        return out
    starts, ln_w = bounds[live], np.log(weight)
    seeds = fmix(np.arange(1, k + 1, dtype=_U) * _U(0xD1B54A32D192ED03))
    for j in range(k):
        x = (h ^ seeds[j]) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        x ^= x >> _U(29)
        r = r_of[x & _U(0xFFFF)]
        ln_a = ln_c_of[(x >> _U(16)) & _U(0xFFFF)]
        beta = (x >> _U(32)) * 2.0**-32
        t = np.floor(ln_w / r + beta)
        t -= beta
        t += 1
        t *= r
        ln_a -= t
        out[live, j] = fmix(np.minimum.reduceat(ln_a, starts).view(_U)) >> _U(48)
    return out


def _signed(docs: DataFrame, shared_idf) -> DataFrame:
    """Per document: id, digest of the text, signature and sum of weights (null without words)."""
    schema = T.StructType([docs.schema["id"], T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("mass", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared_idf.value
        known: dict[bytes, tuple[bytes | None, float | None]] = {}
        for batch in pieces(batches, "body", 400_000):
            digests = [hashlib.md5(t or b"").digest() for t in batch.column("body").cast(pa.binary()).to_pylist()]
            fresh = [i for i, d in enumerate(digests) if d not in known]
            if len(known) > 20_000:
                known = {d: known[d] for d in digests if d in known}
            h, w, bounds = weighted_shingles(Words(batch.column("body").take(pa.array(fresh, pa.int64()))), idf)
            sig = signatures(h, w, bounds, BANDS * ROWS)
            mass = np.bincount(np.repeat(np.arange(len(fresh)), np.diff(bounds)), w, len(fresh)).tolist()
            for i, s, m, n in zip(fresh, sig, mass, np.diff(bounds), strict=True):
                known[digests[i]] = (s.tobytes(), m) if n else (None, None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array([known[d][0] for d in digests], pa.binary()), pa.array([known[d][1] for d in digests], pa.float64())], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def _banded(texts: DataFrame) -> DataFrame:
    """Per text with words and band: bucket, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(batch.num_rows), BANDS)).cast(pa.int64()), pa.array(_bands(sig).reshape(-1).view(np.int64))], names=["n", "bucket"]).set_column(0, "id", batch.column("id").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS))))

    return texts.select("id", "sig").mapInArrow(lean(run), T.StructType([texts.schema["id"], T.StructField("bucket", T.LongType())]))


def _bands(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), _U)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, _U)
        for r in range(ROWS):
            x = fmix(x * _U(0x9E3779B97F4A7C15) + sig[:, b * ROWS + r].astype(_U))
        out[:, b] = x
    return out


def _shared(rows: DataFrame, most: int) -> DataFrame:
    """Rows (bucket, id) of buckets of two texts or more; larger ones than ``most`` are parted, and
    the first text of the bucket is in every part."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("first")).where("size > 1")
    met = rows.join(sizes, "bucket")
    parts = F.ceil(F.col("size") / (most // 2))
    part = F.when(F.col("size") <= most, 0).otherwise(F.pmod(F.xxhash64("id", "bucket"), parts))
    parted = met.select("bucket", "id", part.alias("part"))
    heads = sizes.where(F.col("size") > most).select("bucket", F.col("first").alias("id"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return parted.union(heads).distinct().select(F.xxhash64("bucket", "part").alias("bucket"), "id")


def _refined(rows: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Buckets over ``most`` dealt anew by the samples of further bands."""
    large = rows.groupBy("bucket").count().where(F.col("count") > most).select("bucket")
    within = rows.join(large, "bucket").join(texts, "id").select("bucket", "id", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            bucket = np.asarray(batch.column("bucket")).view(_U)
            band = (_bands(sig) == bucket[:, None]).argmax(1)
            for k in range(1, FINER[0] + 1):
                x = fmix(bucket + _U(k))
                for r in range(FINER[1]):
                    x = fmix(x * _U(0x9E3779B97F4A7C15) + sig[np.arange(len(sig)), (band + k) % BANDS * ROWS + r].astype(_U))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x.view(np.int64))], names=["id", "bucket"])

    finer = within.mapInArrow(lean(run), T.StructType([rows.schema["id"], rows.schema["bucket"]]))
    return rows.join(large, "bucket", "left_anti").select("id", "bucket").unionByName(finer)


def _forest(sig: np.ndarray, least: float, doubt: float) -> set[tuple[int, int]]:
    """Edges of the maximum spanning forest by share of equal samples, from ``least`` on, and the
    three best of each member whose best is not beyond doubt."""
    n, k = sig.shape
    out: set[tuple[int, int]] = set()
    best, to = np.full(n, -1.0), np.zeros(n, int)
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n):
        inside[at] = True
        near = (sig == sig[at]).sum(1) / k
        near[at] = -1
        own = near.max(initial=-1)
        if least <= own < least + 2 * doubt and n > 2:
            for j in np.argsort(-near, kind="stable")[:3].tolist():
                if near[j] >= least:
                    out.add((min(at, j), max(at, j)))
        better = ~inside & (near > best)
        best[better], to[better] = near[better], at
        rest = np.where(inside, -2, best)
        following = int(rest.argmax())
        if rest[following] == -2:
            break
        if rest[following] >= least:
            out.add((min(following, int(to[following])), max(following, int(to[following]))))
        at = following
    return out


def _candidates(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ids to verify. members: bucket, id, sig."""
    kind = members.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    dealt = members.repartition("bucket")
    least = threshold - DOUBT

    def of_groups(bucket: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(cuts, len(bucket)))
        two = cuts[sizes == 2]
        alike = (sig[two] == sig[two + 1]).sum(1) >= least * sig.shape[1] if len(two) else np.zeros(0, bool)
        left, right = [two[alike]], [two[alike] + 1]
        for c, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            edges = _forest(sig[c : c + n], least, DOUBT)
            if edges:
                e = np.array(sorted(edges))
                left.append(c + e[:, 0])
                right.append(c + e[:, 1])
        a, b = ids[np.concatenate(left).astype(int)], ids[np.concatenate(right).astype(int)]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: set[tuple] = set()

        def done(table: pa.Table) -> pa.RecordBatch:
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            a, b = of_groups(table.column("bucket").to_numpy(), np.arange(table.num_rows), sig)
            ids = table.column("id").combine_chunks()
            pairs = {(x, y) if x < y else (y, x) for x, y in zip(ids.take(pa.array(a)).to_pylist(), ids.take(pa.array(b)).to_pylist(), strict=True)} - seen
            if len(seen) < 500_000:
                seen.update(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], ids.type), pa.array([p[1] for p in pairs], ids.type)], names=["a", "b"])

        for batch in batches:  # sorted by bucket: all but the last bucket is complete
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column("bucket").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield done(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield done(table)

    return dealt.sortWithinPartitions("bucket").mapInArrow(lean(run), schema).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, shared_idf, threshold: float) -> DataFrame:
    """The pairs whose texts' exact similarity is at least the threshold. texts: id, body."""
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("body").alias("body_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("body_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared_idf.value
        for batch in pieces(batches, "body_a", 400_000):
            one = weighted_shingles(Words(batch.column("body_a")), idf)
            two = weighted_shingles(Words(batch.column("body_b")), idf)
            yield batch.select(["a", "b"]).filter(pa.array(similarities(one, two) >= threshold - 1e-12))

    return sides.select("a", "b", "body_a", "body_b").mapInArrow(lean(run), pairs.schema)


def similarities(one: tuple, two: tuple) -> np.ndarray:
    """Weighted Jaccard similarity of each row of one with that of two."""
    (h1, w1, b1), (h2, w2, b2) = one, two
    n = len(b1) - 1
    row = np.concatenate([np.repeat(np.arange(n), np.diff(b1)), np.repeat(np.arange(n), np.diff(b2))])
    h, w = np.concatenate([h1, h2]), np.concatenate([w1, w2])
    order = np.lexsort((h, row))
    h, w, row = h[order], w[order], row[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    common = np.bincount(row[same], np.minimum(w[same], w[same + 1]), n)
    total = np.bincount(row, w, n)
    return np.where(total > 0, common / np.maximum(total - common, 1e-300), 0.0)


def _mixed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Of rows (bucket, id), those of buckets of three texts or more that hold more than one class,
    with the class. A bucket of two has no other pair than its candidate."""
    told = rows.select("bucket", "id").join(classes, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("class"))
    mixed = told.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("n")).where("n > 2 and low <> high").select("bucket")
    return told.join(mixed, "bucket")


def _blocks(mixed: DataFrame, block: tuple[int, int]) -> DataFrame:
    """Rows (key, bucket, id, class, asks) such that any two texts of a bucket that are of different
    classes meet under a key, one of them asking. mixed: bucket, id, class, cost; block: what the
    texts of a key that ask, and that are asked, cost in all. The texts of a bucket's largest class
    need not ask, so a bucket that is one class but for a few texts is sent about once, whatever its
    size."""
    counts = mixed.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"))
    sizes = counts.groupBy("bucket").agg(F.max_by("class", F.struct("n", "class")).alias("largest"), F.sum("cost").alias("size"), F.max_by("cost", F.struct("n", "class")).alias("spared"))
    dealt = mixed.drop("cost").join(sizes, "bucket").withColumn("asking", F.ceil((F.col("size") - F.col("spared")) / block[0])).withColumn("asked", F.ceil(F.col("size") / block[1]))
    asking = dealt.where("class <> largest").select("bucket", "id", "class", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id", "bucket"), "asking").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asked") - 1)).alias("j"))
    asked = dealt.select("bucket", "id", "class", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("i"), F.pmod(F.xxhash64("id", "bucket"), "asked").alias("j"))
    return asking.union(asked.select(asking.columns)).select(F.xxhash64("bucket", "i", "j").alias("key"), "bucket", "id", "class", "asks")


def _by_key(of_keys: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """A task's function over batches in order of key: whole keys go to ``of_keys`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # all but the last key is complete
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield of_keys(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield of_keys(table)

    return lean(run)


def _undecided(mixed: DataFrame, texts: DataFrame, threshold: float, block: tuple[int, int]) -> DataFrame:
    """Rows (bucket, id, class) of texts that have a partner of another class in the bucket whose
    estimate, and whose sum of weights, do not rule out the threshold."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("bucket", "id", "class")])
    rows = _blocks(mixed.withColumn("cost", F.lit(1)), block).join(texts.select("id", "sig", "mass"), "id").select("key", "bucket", "id", "class", "asks", "sig", "mass")
    least = threshold - DOUBT

    def of_keys(table: pa.Table) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(table.num_rows, -1)
        mass, own, key = (table.column(n).to_numpy() for n in ("mass", "class", "key"))
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        asking, asked = np.flatnonzero(asks), np.flatnonzero(~asks)
        low, high = np.searchsorted(key[asked], key[asking]), np.searchsorted(key[asked], key[asking], "right")
        total = np.concatenate([[0], np.cumsum(high - low)])
        open_ = np.zeros(table.num_rows, bool)
        at = 0
        while at < len(asking):  # some 100,000 pairs at a time
            end = max(at + 1, int(np.searchsorted(total, total[at] + 100_000, "right")) - 1)
            n = (high - low)[at:end]
            x = np.repeat(asking[at:end], n)
            y = asked[np.repeat(low[at:end] - (total[at:end] - total[at]), n) + np.arange(n.sum())]
            able = (own[x] != own[y]) & (np.minimum(mass[x], mass[y]) >= (threshold - 1e-9) * np.maximum(mass[x], mass[y]))
            x, y = x[able], y[able]
            near = (sig[x] == sig[y]).mean(1) >= least if len(x) else np.zeros(0, bool)
            open_[x[near]] = open_[y[near]] = True
            at = end
        return table.select(schema.names).filter(pa.array(open_)).combine_chunks().to_batches()[0] if open_.any() else pa.RecordBatch.from_pylist([], table.select(schema.names).schema)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(of_keys), schema).distinct()


def joining_links(one: tuple, own: np.ndarray, asks: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Of rows' weighted shingles, links between rows that ask and rows that do not whose exact
    similarity is at least the threshold: as many as it takes to join the classes that they join."""
    h, w, bounds = one
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    mass = np.bincount(row, w, n)
    open_ = ~asks[row]
    order = np.argsort(h[open_], kind="stable")
    terms, posts, weights = h[open_][order], row[open_][order], w[open_][order]
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = []
    for i in np.flatnonzero(asks).tolist():
        a, b = int(bounds[i]), int(bounds[i + 1])
        lo = np.searchsorted(terms, h[a:b])
        counts = np.searchsorted(terms, h[a:b], "right") - lo
        at = np.repeat(lo - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        common = np.bincount(posts[at], np.minimum(weights[at], np.repeat(w[a:b], counts)), n)
        near = np.flatnonzero(common >= (threshold - 1e-12) * (mass[i] + mass - common))
        near = near[(own[near] != own[i]) & ~asks[near] & (mass[near] > 0)]
        for c, j in zip(*np.unique(own[near], return_index=True), strict=True):
            x, y = find(int(own[i])), find(int(c))
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((i, int(near[j])))
    return out


def _joining(undecided: DataFrame, bodies: DataFrame, shared_idf, threshold: float, block: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join classes of a bucket. undecided: bucket, id, class; bodies: id, body."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    cost = undecided.join(bodies.select("id", F.octet_length("body").alias("cost")), "id").select("bucket", "id", "class", "cost")
    rows = _blocks(cost, block).join(bodies, "id").select("key", "id", "class", "asks", "body")

    def of_keys(table: pa.Table) -> pa.RecordBatch:
        ids, own, key = (table.column(n).to_numpy() for n in ("id", "class", "key"))
        asks = np.asarray(table.column("asks").to_pylist(), bool)
        links = []
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(key)).tolist(), strict=True):
            told = weighted_shingles(Words(table.column("body").slice(a, b - a)), shared_idf.value)
            links += [(ids[a + i], ids[a + j]) for i, j in joining_links(told, own[a:b], asks[a:b], threshold)]
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=schema.names)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(of_keys), schema)


def _bodies(wanted: DataFrame, slim: DataFrame, label: str) -> DataFrame:
    """(id, body) of the texts with these ids, once each, as a table of its own."""
    ids, ids_at = materialise(wanted.select("id").distinct(), "wanted")
    small = ids.count() <= SENT  # then the texts need not be shuffled to find those of candidates
    bodies, _ = materialise(slim.select(_node("body").alias("id"), "body").join(F.broadcast(ids) if small else ids, "id", "left_semi").dropDuplicates(["id"]), label)
    drop(slim.sparkSession, ids_at)
    return bodies


def _node(text: str) -> Column:
    """A text's number among the texts: 64 bits of its digest."""
    return F.xxhash64(F.unhex(F.md5(F.col(text).cast("binary"))))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, most: int, block: tuple[int, int], block_bytes: tuple[int, int]) -> DataFrame:
    """Per row with an id: id, digest of its text, class_id."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).where("id is not null")
    found = document_frequencies(slim, "body")
    shared = spark.sparkContext.broadcast((found.words, found.weights()))
    signed, _ = materialise(_signed(slim, shared), "signed")
    firsts, _ = materialise(signed.groupBy("digest").agg(F.min("id").alias("first"), F.first("sig").alias("sig"), F.first("mass").alias("mass")).withColumn("id", F.xxhash64("digest")), "firsts")
    texts = firsts.where("sig is not null").select("id", "sig", "mass")
    banded, banded_at = materialise(_banded(texts), "banded")
    rows = _refined(banded, texts, most) if banded.groupBy("bucket").count().where(F.col("count") > most).limit(1).count() else banded
    pairs, pairs_at = materialise(_candidates(_shared(rows, most).join(texts, "id").select("bucket", "id", "sig"), threshold), "pairs")
    links, _ = materialise(_verified(pairs, _bodies(pairs.select(F.explode(F.array("a", "b")).alias("id")), slim, "bodies"), shared, threshold), "links")
    drop(spark, pairs_at)
    classes, classes_at = materialise(connected_components(links), "classes")
    mixed, mixed_at = materialise(_mixed(banded, classes), "mixed")  # whole buckets, not their parts
    drop(spark, banded_at)
    undecided, undecided_at = materialise(_undecided(mixed, texts, threshold, block), "undecided")
    drop(spark, mixed_at)
    more, _ = materialise(_joining(undecided, _bodies(undecided, slim, "undecided-bodies"), shared, threshold, block_bytes), "more")
    drop(spark, undecided_at)
    if more.limit(1).count():
        drop(spark, classes_at)
        classes, _ = materialise(connected_components(links.union(more)), "classes")
    least = classes.join(firsts.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("class_id"))
    told = classes.join(least, "component").select("id", "class_id")
    by_text = firsts.select("digest", "id", "first").join(told, "id", "left").select("digest", F.coalesce("class_id", "first").alias("class_id"))
    return signed.select("id", "digest").join(by_text, "digest")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = MOST, block: tuple[int, int] = BLOCK, block_bytes: tuple[int, int] = BLOCK_BYTES) -> DataFrame:
    """Per row with an id: id, and class_id, the smallest id of its class of near copies."""
    return _classes(docs, id_col, text_col, threshold, most, block, block_bytes).select(F.col("id").alias(id_col), "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most: int = MOST, block: tuple[int, int] = BLOCK, block_bytes: tuple[int, int] = BLOCK_BYTES) -> DataFrame:
    """The documents without all but the smallest id of each class, in the same columns. Rows with
    a null id stay, and so do rows that repeat a kept one's id and text."""
    kept = _classes(docs, id_col, text_col, threshold, most, block, block_bytes).where("id = class_id").select("id", "digest").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("digest"))
    stays = rows.join(kept, ["id", "digest"], "left_semi").union(rows.where("id is null").select("id", "digest", "row"))
    return stays.select("row.*")
