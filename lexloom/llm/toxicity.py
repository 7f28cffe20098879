"""Toxicity: a counterfactual-regularised classifier (operator 3).

A logistic model over the presence of words and of words' first 3 to 6 bytes, hashed to 64 bits.
Features are chosen where toxic and other labelled texts differ most. Training minimises the log
loss, a small ridge, and ``cf_weight`` times the mean squared change of the score that comes from
swapping each identity term of a labelled text for another of its kind (or, in texts without one, from
mentioning one), so that a neutral mention of a group moves the score as little as the data allow.
Which one is decided by a hash of the text's words, so training does not depend on how rows are
dealt out.

Only labelled rows whose crc32(id as text) mod 5 is not 0 are learnt from, and of these a sample of
about ``max_rows``, chosen by hash; ``MAX_CANDIDATES`` bounds the features that are looked at, the
most frequent of toxic texts, and ``max_features`` the model, so it may be broadcast. The driver
holds the numbers of the features of ``max_rows`` rows. Scoring covers every whole text and uses
nothing but the text.

Defined results: null and empty texts score the model's prior; without labelled rows every score is
0; rows with null labels or ids are not learnt from; a document with several labels is learnt from
with each, and so is a text that several rows have; rows with a null id count as not held out, and are
scored like others; repeated rows have equal scores; an empty table gives an empty result; columns other
than id and text, and id and label, may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import WORD_VALUE, Words, fmix, lean, pieces, prefix_sums, spans_hash

MAX_ROWS = 20_000
MAX_FEATURES = 4096
MAX_CANDIDATES = 60_000
CF_WEIGHT = 0.5
PREFIXES = (3, 4, 5, 6)
_U = np.uint64
#: Neutral names of groups by kind; a term is swapped for another of its line.
IDENTITY_KINDS = tuple(tuple(line.split()) for line in """
women men woman man girls boys
frauen männer
femmes hommes
mujeres hombres
black white asian latino african european american mexican chinese arab natives
muslim christian jewish hindu buddhist atheist
muslime christen juden
musulmans chrétiens juifs
gay straight lesbian bisexual transgender queer
immigrants refugees
disabled blind deaf
elderly young
""".strip().split("\n"))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all features of the rows, with repeats, and the word that each comes from."""
    sums = prefix_sums(words.buf, WORD_VALUE)
    sizes = words.ends - words.starts
    out, of = [words.hashes], [np.arange(len(sizes))]
    for n in PREFIXES:
        long = np.flatnonzero(sizes >= n)
        out.append(fmix(spans_hash(sums, words.starts[long], words.starts[long] + n) ^ _U(0xA5A5 + n)))
        of.append(long)
    return np.concatenate(out), np.concatenate(of)


def _row_of_word(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))


@dataclass
class Model:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, words: Words) -> np.ndarray:
        n = len(words.rows) - 1
        z = np.full(n, self.bias)
        if len(self.hashes) and len(words.hashes):
            row, k = present(self.hashes, words)
            z += np.bincount(row, self.weights[k], n)
        return np.where(z <= -500, 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500))))


def present(known: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each known feature that a row has, once each."""
    h, of = features(words)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    hit = np.flatnonzero(known[at] == h)
    pair = np.unique(_row_of_word(words)[of[hit]] * len(known) + at[hit])
    return pair // len(known), pair % len(known)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(body, toxic) of about ``max_rows`` labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(known, "id").select("body", "toxic")


def _counted(rows: DataFrame, shared) -> DataFrame:
    """Per feature: documents that have it, by label; with ``shared``, only of its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if shared is None else np.frombuffer(shared.value, _U)
        for batch in pieces(batches, "body"):
            words = Words(batch.column("body"))
            if not len(words.hashes):
                continue
            toxic = np.asarray(batch.column("toxic")) == 1
            if only is None:
                h, of = features(words)
                order = np.lexsort((_row_of_word(words)[of], h))
                h, row = h[order], _row_of_word(words)[of][order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                h, row = h[new], row[new]
            else:
                row, k = present(only, words)
                h = only[k]
            own, inverse = np.unique(h, return_inverse=True)
            pos = np.bincount(inverse, toxic[row], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(pos), pa.array(np.bincount(inverse, minlength=len(own)) - pos)], names=["h", "pos", "neg"])

    return rows.mapInArrow(lean(run), "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _design(rows: DataFrame, shared, kinds: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Per labelled row: label, its features' numbers, and those of its counterfactual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, _U)
        terms = [t for kind in kinds for t in kind]
        first = [k for kind, k in zip(kinds, np.cumsum([0, *map(len, kinds)]).tolist(), strict=False) for _ in kind]
        size = [len(kind) for kind in kinds for _ in kind]
        names = Words(pa.array(terms, pa.string()))
        each = [present(known, Words(pa.array([t])))[1].tolist() for t in terms]
        place = {int(h): i for i, h in enumerate(names.hashes)}
        for batch in pieces(batches, "body"):
            words = Words(batch.column("body"))
            row, k = present(known, words)
            have = [k[a:b].tolist() for a, b in zip(*(np.searchsorted(row, np.arange(batch.num_rows) + s) for s in (0, 1)), strict=True)]
            which = np.flatnonzero(np.isin(words.hashes, names.hashes))
            mentioned: dict[int, set[int]] = {}
            for r, h in zip(_row_of_word(words)[which].tolist(), words.hashes[which].tolist(), strict=True):
                mentioned.setdefault(r, set()).add(place[h])
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(words.hashes)])
            draws = fmix(sums[words.rows[1:]] - sums[words.rows[:-1]]).tolist()
            other = []
            for own, draw, r in zip(have, draws, range(batch.num_rows), strict=True):
                drop, add = set(), set()
                for i in mentioned.get(r, ()):
                    drop |= {*each[i]}
                    add |= {*each[first[i] + (i - first[i] + 1 + draw % max(1, size[i] - 1)) % size[i]]}
                if r not in mentioned and terms:
                    add = {*each[draw % len(terms)]}
                other.append(sorted(({*own} - drop) | add))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(have, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["toxic", "own", "other"])

    return rows.mapInArrow(lean(run), "toxic int, own array<int>, other array<int>")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists])
    return np.repeat(np.arange(len(lists)), sizes), np.array([i for x in lists for i in x], np.int64)


def fit(toxic: np.ndarray, own: list[list[int]], other: list[list[int]], n_features: int, cf_weight: float = CF_WEIGHT, ridge: float = 1e-4, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent."""
    n = len(toxic)
    share = np.where(toxic == 1, n / (2 * max(1, toxic.sum())), n / (2 * max(1, n - toxic.sum()))) / n  # both classes count alike
    (r1, k1), (r2, k2) = _flat(own), _flat(other)
    w, b = np.zeros(n_features), -1.0
    seen = np.bincount(k1, minlength=n_features)
    # each weight's own step, from the curvature that its column can have at most
    rate = 1 / (0.25 * np.bincount(k1, share[r1], n_features) * max(1, len(k1) / max(n, 1)) + 20 * cf_weight * (seen + np.bincount(k2, minlength=n_features)) / n + ridge + 1e-3)
    v, vb = w.copy(), b
    for step in range(steps):
        z = vb + np.bincount(r1, v[k1], n)
        z2 = vb + np.bincount(r2, v[k2], n)
        err = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - toxic) * share
        change = 2 * cf_weight * (z - z2) / n
        grad = np.bincount(k1, (err + change)[r1], n_features) - np.bincount(k2, change[r2], n_features) + ridge * v
        w2, b2 = v - rate * grad, vb - 2.0 * err.sum()
        m = step / (step + 3)
        v, vb = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, cf_weight: float = CF_WEIGHT, kinds: tuple[tuple[str, ...], ...] = IDENTITY_KINDS) -> Model:
    spark = docs.sparkSession
    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows).persist()
    try:
        totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
        n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
        if not n_pos + n_neg:
            return Model(np.zeros(0, _U), np.zeros(0), -500.0)
        # what toxic texts have, then how often the others have it
        common = _counted(rows.where("toxic = 1"), None).where("pos >= 3").orderBy(F.desc("pos"), "h").limit(MAX_CANDIDATES)
        candidates = np.sort(np.array([r.h for r in common.collect()], np.int64).view(_U))
        chosen = np.zeros(0, _U)
        if len(candidates):
            counts = _counted(rows, spark.sparkContext.broadcast(candidates.tobytes()))
            p, q = (F.col("pos") + 0.5) / (n_pos + 1), (F.col("neg") + 0.5) / (n_neg + 1)
            ratio = F.log(p) - F.log(q)
            apart = ratio / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
            best = counts.withColumn("z", apart).where((F.abs("z") > 2) & (F.abs(ratio) > 1.5)).orderBy(F.desc(F.abs("z")), "h").limit(max_features)
            chosen = np.array([r.h for r in best.collect()], np.int64).view(_U)
        mine = features(Words(pa.array([t for kind in kinds for t in kind], pa.string())))[0]
        chosen = np.unique(np.concatenate([chosen, mine]))
        data = _design(rows, spark.sparkContext.broadcast(chosen.tobytes()), kinds).collect()
        w, b = fit(np.array([r.toxic for r in data], float), [r.own for r in data], [r.other for r in data], len(chosen), cf_weight)
        return Model(chosen, w, b)
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = T.StructType([slim.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(Words(batch.column("body"))))], names=["id", "score"])

    return slim.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> DataFrame:
    """Per document: id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, label_col, **how)
    return score(docs, model, id_col, text_col).select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents that the classifier does not call toxic, in the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            scores = shared.value.score(Words(batch.column(batch.schema.get_field_index(text_col))))
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
