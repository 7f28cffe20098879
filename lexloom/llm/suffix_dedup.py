"""Suffix-array dedup of long byte strings across documents (operator 5).

Bytes covered by a ``span``-byte string that also starts in a document of a smaller id are removed.

1. Winnowing: of each ``span``-byte window the smallest hash of its ``GRAM``-byte grams is its
   anchor; equal windows have equal anchors at equal places. Anchors are gathered by hash range; a
   task first looks for repeats among its own, which do not travel but for one, so that a string in
   a third of all documents sends at most a mark for each task. An anchor in very many documents
   (``HOT``, estimated from every ``SAMPLED``-th document, which decides about balance only) gives
   way to its windows one by one, so its contexts are spread over all ranges.
2. Ranges answer by bucket of documents, a row for each; documents meet their bucket's answers and
   send the segments whose windows the repeated anchors stand for. Of equal segments that a task
   holds only that of the smallest id is sent, the others are repeats already.
3. Each range of anchors keeps one of equal segments, builds a suffix array of these by two-stage
   sorting (see ``suffix_array``); windows whose adjacent common prefix reaches ``span`` are equal,
   and of each run all but those of the smallest id are repeats.
4. Repeats return to their bucket as intervals, and are cut.

Equal segments are recognised by 128-bit hashes, equal texts by MD5. Memory is bounded: a range or
bucket stands for about ``RANGE_BYTES`` of text, and a suffix array for about ``SORTED_BYTES`` of
segments.

Defined results: null is empty; ids are integers, rows with a null id repeat nothing and are left
as they are; rows with equal ids and texts all have that document's result, rows with equal ids and
other texts do not repeat each other; texts under ``span`` bytes lose nothing; an empty table gives
an empty result; only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import BYTE_VALUE, OTHER_VALUE, dumped, fmix, lean, loaded, pieces, powers, prefix_sums, spans_hash, string_buffer
from lexloom.llm.storage import drop, materialise
from lexloom.llm.suffix_array import adjacent_prefixes, two_stage_sort, words_at

SPAN = 50
GRAM = 16
RANGE_BYTES = 16_000_000
HELD_BYTES = 16_000_000
PIECE_BYTES = 150_000  # whose arrays stay in a core's cache
SORTED_BYTES = 4_000_000
#: Documents from which an anchor is split into its windows; the share of documents that is looked
#: at for this; and how many anchors are split at most. These change the balance, never a result.
HOT, SAMPLED, MOST_HOT = 50_000, 64, 100_000
_U = np.uint64
_NONE = np.zeros(0, np.int64)


def anchors(buf: np.ndarray, offsets: np.ndarray, span: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows inside rows: anchors' hashes, and the first and last start of the windows that
    each stands for (they are neighbours). hot: sorted hashes of anchors to split."""
    n, wide = len(buf), span - GRAM + 1
    if n < span:
        return _NONE.astype(_U), _NONE, _NONE
    sums = prefix_sums(buf)
    inverse = powers(n + 1)[1]
    grams = fmix((sums[GRAM:] - sums[:-GRAM]) * inverse[: n - GRAM + 1])
    bits = _U(n.bit_length())
    low = grams >> bits << bits | np.arange(len(grams), dtype=_U)  # the position breaks ties, the same way in equal windows
    size = 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if wide > size:
        low = np.minimum(low[: size - wide], low[wide - size :])
    inside = np.zeros(len(low) + 1, np.int32)
    lengths = np.diff(offsets)
    long = lengths >= span
    inside[offsets[:-1][long]] += 1
    np.subtract.at(inside, (offsets[1:][long] - span + 1), 1)
    ok = np.flatnonzero(np.cumsum(inside[:-1]))
    place = (low[ok] & ((_U(1) << bits) - _U(1))).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1] + 1)]) if len(ok) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    h, first, last = grams[place[head]], ok[head], ok[np.append(head[1:], len(ok)) - 1] if len(head) else ok
    if hot is not None and len(hot) and len(h):
        split = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        if split.any():
            each = _ranges(first[split], last[split] - first[split] + 1)
            own = ~fmix((sums[each + span] - sums[each]) * inverse[each])
            h, first, last = np.concatenate([h[~split], own]), np.concatenate([first[~split], each]), np.concatenate([last[~split], each])
            order = np.argsort(first, kind="stable")
            h, first, last = h[order], first[order], last[order]
    return h, first, last


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """An even share of the anchors for each range: their hashes, being minima, are small, and are
    mixed anew."""
    return ((fmix(h ^ _U(0x7E57ED)) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _rows_of(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, at, "right") - 1


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grouped(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, each group's start, and whether it has two documents or more."""
    order = np.argsort(h)
    heads = _heads(h[order])
    if not len(h):
        return order, heads, np.zeros(0, bool)
    d = doc[order]
    return order, heads, np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)


def _parted(p: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and where, in order."""
    by = np.argsort(p.astype(np.uint16) if parts <= 1 << 16 else p, kind="stable")
    cuts = np.searchsorted(p[by], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), by[cuts[k] : cuts[k + 1]]


def _listed(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of documents: which documents, how many of each, and the gaps."""
    heads = _heads(doc)
    gaps = np.diff(at, prepend=0)
    gaps[heads] = at[heads]
    return doc[heads], np.diff(np.append(heads, len(doc))).astype("<u4"), gaps.astype("<u4")


def _places(counts: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps.astype(np.int64))
    heads = np.cumsum(counts.astype(np.int64)) - counts
    return total - np.repeat(total[heads] - gaps[heads], counts) if len(gaps) else total


def hot_anchors(docs: DataFrame, span: int, hot: int, sampled: int) -> np.ndarray:
    """Sorted hashes of anchors that about ``hot`` documents have or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 500_000):
            buf, offsets = string_buffer(batch.column("text"))
            h, first, _ = anchors(buf, offsets, span)
            row = _rows_of(offsets, first)
            order = np.lexsort((row, h))
            one = order[_heads(h[order], row[order])]
            each = _heads(h[one])
            yield pa.RecordBatch.from_arrays([pa.array(h[one][each].view(np.int64)), pa.array(np.diff(np.append(each, len(one))))], names=["h", "n"])

    seen = docs.where(F.pmod(F.xxhash64("id"), F.lit(sampled)) == 0).select("text").mapInArrow(lean(run), "h long, n long")
    found = seen.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2, hot // sampled)).orderBy(F.desc("n"), "h").limit(MOST_HOT).toArrow()
    return np.sort(found.column("h").to_numpy().view(_U))


_OPEN = ("<u4", *("<i8", "<i4", "<u4", "<u4", "<u4", "u1") * 2)


def _gathered(docs: DataFrame, ranges: int, span: int, shared_hot) -> DataFrame:
    """(p, body): anchors by hash range; those that the task knows to repeat go anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared_hot.value
        held: list[tuple[np.ndarray, ...]] = []
        docs_held: list[np.ndarray] = []
        size = n_docs = 0

        def flushed() -> pa.RecordBatch:
            h, doc, at, wide = (np.concatenate([x[k] for x in held]) for k in range(4))
            ids, buckets = (np.concatenate([x[k] for x in docs_held]) for k in range(2))
            order, heads, repeats = _grouped(h, ids[doc])
            known = np.zeros(len(h), bool)
            known[order] = np.repeat(repeats, np.diff(np.append(heads, len(h))))
            marks = h[order][heads[repeats]]  # tell others that it repeats; need no answer
            p = np.where(known, doc % ranges, _range_of(h, ranges))
            marked = dict(_parted(_range_of(marks, ranges), ranges))
            parts, bodies = [], []
            for k, where in _parted(p, ranges):
                sure = known[where]
                open_, told = where[~sure], where[sure]
                body = [marks[marked.pop(k, _NONE)].astype("<u4")]
                for w in (open_, told):
                    d, counts, gaps = _listed(doc[w], at[w])
                    body += [ids[d], buckets[d], counts, gaps, h[w].astype("<u4"), wide[w]]
                parts.append(k)
                bodies.append(dumped(*body))
            for k, where in marked.items():
                parts.append(k)
                bodies.append(dumped(marks[where].astype("<u4"), *(_NONE.astype(kind) for kind in _OPEN[1:])))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], names=["p", "body"])

        for batch in pieces(batches, "text", PIECE_BYTES):
            buf, offsets = string_buffer(batch.column("text"))
            h, first, last = anchors(buf, offsets, span, hot)
            if len(h):
                row = _rows_of(offsets, first)
                held.append((h, (row + n_docs).astype(np.int32), (first - offsets[row]).astype(np.uint32), (last - first).astype(np.uint8)))
            docs_held.append((np.asarray(batch.column("id")), np.asarray(batch.column("bucket"))))
            n_docs += batch.num_rows
            size += len(buf)
            if size > HELD_BYTES and held:
                yield flushed()
                held, docs_held, size, n_docs = [], [], 0, 0
        if held:
            yield flushed()

    return docs.mapInArrow(lean(run), "p int, body binary")


def _repeated(gathered: DataFrame, ranges: int) -> DataFrame:
    """(bucket, n, body): places of the bucket's documents' anchors that other documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, body in zip(batch.column("p").to_pylist(), batch.column("body").to_pylist(), strict=True):
                by.setdefault(p, []).append(body)
        while by:
            marks, *open_ = both = [[] for _ in range(11)]
            for body in by.popitem()[1]:
                own, *rest = loaded(body, *_OPEN)
                marks.append(own)
                for into, (ids, buckets, counts, gaps, h, wide) in ((open_[:5], rest[:6]), (open_[5:], rest[6:])):
                    for col, v in zip(into, (np.repeat(ids, counts), np.repeat(buckets, counts), _places(counts, gaps), h, wide), strict=True):
                        col.append(v)
            marks, *open_ = (np.concatenate(c) for c in both)
            doc, h = open_[0], open_[3]
            order, heads, repeats = _grouped(h, doc)
            hit = np.zeros(len(h), bool)
            hit[order] = np.repeat(repeats, np.diff(np.append(heads, len(h))))
            hit |= np.isin(h, marks)
            cols = [np.concatenate([x[hit], y]) for x, y in zip(open_[:5], open_[5:], strict=True)]
            order = np.lexsort((cols[2], cols[0], cols[1]))
            doc, bucket, at, h, wide = (c[order] for c in cols)
            heads = _heads(bucket)
            ends = np.append(heads[1:], len(doc))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array(ends - heads), pa.array([dumped(*_listed(doc[a:b], at[a:b]), h[a:b], wide[a:b]) for a, b in zip(heads, ends, strict=True)], pa.binary())], names=["bucket", "n", "body"])

    return gathered.repartitionById(ranges, "p").mapInArrow(lean(run), "bucket int, n long, body binary")


def _met(docs: DataFrame, told: DataFrame, copies: DataFrame, buckets: int) -> DataFrame:
    """Documents dealt by bucket, each bucket's answers and copies before them."""
    answers = told.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("key"), F.lit(None).cast(docs.schema["own"].dataType).alias("own"), F.lit(None).cast("string").alias("text"), "body")
    whole = copies.select("bucket", F.lit(1).alias("kind"), "id", "key", F.lit(None).cast(docs.schema["own"].dataType).alias("own"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("body"))
    rows = docs.select("bucket", F.lit(2).alias("kind"), "id", "key", "own", "text", F.lit(None).cast("binary").alias("body"))
    return answers.unionByName(whole).unionByName(rows).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind", "id")


def _buckets(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, list[bytes], set, pa.RecordBatch]]:
    """Documents in some batches of a bucket, with all answers and copies of the bucket."""
    now, bodies, whole = None, [], set()
    for batch in pieces(batches, "text", most):
        bucket, kind = np.asarray(batch.column("bucket")), np.asarray(batch.column("kind"))
        heads = _heads(bucket, kind)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows], strict=True):
            if bucket[a] != now:
                now, bodies, whole = int(bucket[a]), [], set()
            part = batch.slice(a, b - a)
            if kind[a] == 0:
                bodies.extend(part.column("body").to_pylist())
            elif kind[a] == 1:
                whole.update(zip(part.column("id").to_pylist(), part.column("key").to_pylist(), strict=True))
            else:
                yield now, bodies, whole, part


def _marks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each span."""
    return spans_hash(prefix_sums(text, BYTE_VALUE), starts, ends), spans_hash(prefix_sums(text, OTHER_VALUE), starts, ends)


def _united(doc: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of intervals, which are in order of document and place."""
    if not len(doc):
        return doc, at, end
    wide = int(end.max()) + 1
    number = np.zeros(len(doc), np.int64)
    number[_heads(doc)[1:]] = 1
    shift = np.cumsum(number) * wide
    reach = np.maximum.accumulate(end + shift)
    new = np.flatnonzero(np.concatenate([[True], (at + shift)[1:] > reach[:-1]]) | np.concatenate([[True], doc[1:] != doc[:-1]]))
    stop = np.append(new[1:], len(doc)) - 1
    return doc[new], at[new], (reach - shift)[stop]


_SEGMENTS = (*("<i8", "<i8", "<i4", "<u4", "<u4", "<u4"), "u1", *("<i8", "<i8", "<i4", "<u4", "<u4", "<u4"))


def _segments(met: DataFrame, ranges: int, span: int) -> DataFrame:
    """(p, body): segments to compare, by anchor range, and intervals that repeat already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        docs_held: list[tuple[np.ndarray, ...]] = []
        size = n_docs = 0
        now, doc, places = None, _NONE, _NONE[None]

        def flushed() -> pa.RecordBatch:
            p, doc, at, length, one, two, raw = (np.concatenate([x[k] for x in held]) for k in range(7))
            ids, keys, buckets = (np.concatenate([x[k] for x in docs_held]) for k in range(3))
            begins = np.cumsum(length) - length
            order = np.lexsort((ids[doc], two, one))
            heads = _heads(one[order], two[order])
            least = np.repeat(ids[doc[order[heads]]], np.diff(np.append(heads, len(order))))
            sure = np.zeros(len(doc), bool)
            sure[order] = ids[doc[order]] > least
            united = _united(doc[sure], at[sure], at[sure] + length[sure])
            spread = dict(_parted(united[0] % ranges, ranges))
            mine = np.flatnonzero(~sure)
            sent = {k: mine[where] for k, where in _parted(p[mine], ranges)}
            parts, bodies = [], []
            for k in sorted({*sent, *spread}):
                w, v = sent.get(k, _NONE), spread.get(k, _NONE)
                d, counts, gaps = _listed(doc[w], at[w])
                e, numbers, steps = _listed(united[0][v], united[1][v])
                parts.append(k)
                bodies.append(dumped(ids[d], keys[d], buckets[d], counts, gaps, length[w].astype("<u4"), raw[_ranges(begins[w], length[w])], ids[e], keys[e], buckets[e], numbers, steps, (united[2] - united[1])[v].astype("<u4")))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(bodies, pa.binary())], names=["p", "body"])

        for bucket, answers, whole, batch in _buckets(batches, PIECE_BYTES):
            if bucket != now:
                found = [loaded(b, "<i8", "<u4", "<u4", "<u4", "u1") for b in answers]
                doc, at, h, wide = (np.concatenate([_NONE, *x]) for x in ((np.repeat(f[0], f[1]) for f in found), (_places(f[1], f[2]) for f in found), (f[3] for f in found), (f[4] for f in found)))
                order = np.lexsort((at, doc))
                doc, places, now = doc[order], np.stack([at[order], wide[order] + span, _range_of(h[order].astype(_U), ranges)]), bucket
            ids, keys = np.asarray(batch.column("id")), np.asarray(batch.column("key"))
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
            live = (hi > lo) & np.array([k not in whole for k in zip(ids.tolist(), keys.tolist(), strict=True)], bool)
            if not live.any():
                continue
            batch, ids, keys, lo, hi = batch.filter(pa.array(live)), ids[live], keys[live], lo[live], hi[live]
            buf, offsets = string_buffer(batch.column("text"))
            row = np.repeat(np.arange(len(ids)), hi - lo)
            at, length, p = places[:, _ranges(lo, hi - lo)]
            inside = at + length <= np.diff(offsets)[row]  # answers are by id, and may be of another text
            at, length, p, row = at[inside], length[inside], p[inside], row[inside]
            first = at + offsets[row]
            one, two = _marks(buf, first, first + length)
            held.append((p, row + n_docs, at, length, one, two, buf[_ranges(first, length)]))
            docs_held.append((ids, keys, np.full(len(ids), bucket, np.int32)))
            n_docs += len(ids)
            size += int(length.sum())
            if size > HELD_BYTES and held:
                yield flushed()
                held, docs_held, size, n_docs = [], [], 0, 0
        if held:
            yield flushed()

    return met.mapInArrow(lean(run), "p int, body binary")


def repeats_of(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments laid end to end, runs of windows that start in a smaller document too: segment,
    first start, last start."""
    begins = np.cumsum(sizes) - sizes
    counts = sizes - span + 1
    of = np.repeat(np.arange(len(sizes)), counts)
    wanted = _ranges(begins, counts)
    words = words_at(text)
    order = two_stage_sort(text, wanted, span, words)
    common = adjacent_prefixes(order, span, words)
    heads = np.flatnonzero(common < span)
    where = np.full(len(text) + 1, -1)
    where[wanted] = doc[of]
    owner = where[order]
    least = np.repeat(np.minimum.reduceat(owner, heads), np.diff(np.append(heads, len(order))))
    late = np.zeros(len(text) + 1, bool)
    late[order[owner > least]] = True
    hit = np.flatnonzero(late[wanted])
    new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])]) if len(hit) else np.zeros(0, bool)
    a = hit[new]
    b = hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1] if len(hit) else a
    return of[a], wanted[a] - begins[of[a]], wanted[b] - begins[of[a]]


def _intervals(segments: DataFrame, ranges: int, span: int) -> DataFrame:
    """(bucket, body): intervals of repeated bytes of the bucket's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for p, body in zip(batch.column("p").to_pylist(), batch.column("body").to_pylist(), strict=True):
                held.setdefault(p, []).append(body)
        while held:
            cols: list[list[np.ndarray]] = [[] for _ in range(11)]
            for body in held.popitem()[1]:
                ids, keys, buckets, counts, gaps, length, raw, *sure = loaded(body, *_SEGMENTS)
                own = (np.repeat(x, counts) for x in (ids, keys, buckets))
                told = (np.repeat(x, sure[3]) for x in sure[:3])
                for col, v in zip(cols, (*own, _places(counts, gaps), length.astype(np.int64), raw, *told, _places(sure[3], sure[4]), sure[5].astype(np.int64)), strict=True):
                    col.append(v)
            doc, key, bucket, at, length, raw, *sure = (np.concatenate(c) for c in cols)
            if len(doc):
                begins = np.cumsum(length) - length
                one, two = _marks(raw, begins, begins + length)
                order = np.lexsort((doc, two, one))
                heads = _heads(one[order], two[order])
                group = np.zeros(len(doc), np.int64)
                group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
                kept = order[heads]  # one of the smallest id stands for equal segments
                s, a, b = repeats_of(raw[_ranges(begins[kept], length[kept])], length[kept], doc[kept], span)
                late = doc > doc[kept][group]
                mine = np.flatnonzero(~late)
                lo, hi = np.searchsorted(s, group[mine]), np.searchsorted(s, group[mine], "right")
                each, of = _ranges(lo, hi - lo), np.repeat(mine, hi - lo)
                late = np.flatnonzero(late)
                own = np.concatenate([of, late])
                sure = [np.concatenate([x, y]) for x, y in zip(sure, (doc[own], key[own], bucket[own], np.concatenate([at[of] + a[each], at[late]]), np.concatenate([b[each] - a[each] + span, length[late]])), strict=True)]
            doc, key, bucket, at, length = sure
            if not len(doc):
                continue
            order = np.lexsort((at, key, doc, bucket))
            doc, key, bucket, at, end = doc[order], key[order], bucket[order], at[order], (at + length)[order]
            text = _heads(doc, key, bucket)
            number = np.repeat(np.arange(len(text)), np.diff(np.append(text, len(doc))))
            number, at, end = _united(number, at, end)
            bucket = bucket[text][number]
            heads = _heads(bucket)
            bodies = []
            for x, y in zip(heads, np.append(heads[1:], len(number)), strict=True):
                t, counts, gaps = _listed(number[x:y], at[x:y])
                bodies.append(dumped(doc[text[t]], key[text[t]], counts, gaps, (end - at)[x:y].astype("<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads].astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    return segments.repartitionById(ranges, "p").mapInArrow(lean(run), "bucket int, body binary")


OUT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())])


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """The documents (own, id, key, text) dealt by bucket behind their answers: bodies of repeated
    intervals, and the copies of whole texts, of which nothing stays; see ``_buckets``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("own"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(4, -(-total // RANGE_BYTES))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(ranges)).cast("int"))
    slim = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= span))
    heads = slim.select("bucket", "id", "key", F.md5(F.col("text").cast("binary")).alias("digest"))
    least = heads.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies, _ = materialise(heads.join(least, "digest").where("id > least").select("bucket", "id", "key").distinct(), "copies")
    shared = spark.sparkContext.broadcast(hot_anchors(slim, span, hot, sampled))
    places, places_at = materialise(_repeated(_gathered(slim.select("bucket", "id", "text"), ranges, span, shared), ranges), "places")
    told = places.agg(F.sum("n")).first()[0] or 0
    parts = max(4, -(-told * (2 * span - GRAM) // SORTED_BYTES))
    met = _met(slim, places, copies, ranges)
    spans, _ = materialise(_intervals(_segments(met, parts, span), parts, span), "spans")
    drop(spark, places_at)
    return _met(rows, spans, copies, ranges)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, **how) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = T.StructType([T.StructField("own", docs.schema[id_col].dataType), *OUT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, spans = None, {}, []
        for bucket, bodies, whole, batch in _buckets(batches, 2_000_000):
            if bucket != now:
                found = [loaded(b, "<i8", "<i8", "<u4", "<u4", "<u4") for b in bodies]
                doc, key, at, length = (np.concatenate([_NONE, *x]) for x in ((np.repeat(f[0], f[2]) for f in found), (np.repeat(f[1], f[2]) for f in found), (_places(f[2], f[3]) for f in found), (f[4] for f in found)))
                order = np.lexsort((at, key, doc))
                heads = _heads(doc[order], key[order])
                number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
                number, a, b = _united(number, at[order], (at + length)[order])
                cuts = np.searchsorted(number, np.arange(len(heads) + 1))
                of = {k: n for n, k in enumerate(zip(doc[order][heads].tolist(), key[order][heads].tolist(), strict=True))}
                spans, now = np.stack([a, b], 1), bucket
            out = []
            for body, d, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("id").to_pylist(), batch.column("key").to_pylist(), strict=True):
                n = of.get((d, k))
                runs = [[0, len(body)]] if (d, k) in whole else [] if n is None else spans[cuts[n] : cuts[n + 1]].tolist()
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(body[at:a])
                    at = b
                kept.update(body[at:])
                out.append((len(body), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("own"), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], names=schema.names)

    return spans_of(docs, id_col, text_col, span, **how).mapInArrow(lean(run), schema).withColumnRenamed("own", id_col)


def brute_force(docs: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple]:
    """The report's rows by a dictionary of all windows, for tests."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    first: dict[bytes, int] = {}
    for d, b in raw:
        for i in range(len(b) - span + 1):
            w = b[i : i + span]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in raw:
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < d:
                gone[i : i + span] = b"\1" * span
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return out


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT doc_id, 512 * c AS o, substr(x, 1024 * c + 1, {1022 + 2 * SPAN}) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 1024 + 1)) AS c FROM d)),
w AS (SELECT doc_id, o + j AS i, hash(substr(y, 2 * j + 1, {2 * SPAN})) AS g FROM (SELECT doc_id, o, y, unnest(range(0, length(y) // 2 - {SPAN - 1})) AS j FROM e WHERE length(y) >= {2 * SPAN})),
f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE doc_id > least),
s AS (SELECT doc_id, i, CASE WHEN i <= max(i + {SPAN}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM s),
v AS (SELECT doc_id, run, min(i) AS a, max(i) + {SPAN} AS b FROM n GROUP BY ALL),
c AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS following, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM v),
k AS (SELECT d.doc_id, string_agg(CASE WHEN c.k = 1 THEN substr(x, 1, 2 * a) ELSE '' END || substr(x, 2 * b + 1, 2 * (coalesce(following, length(x) // 2) - b)), '' ORDER BY a) AS kept, sum(b - a) AS gone, count(*) AS spans FROM d JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
