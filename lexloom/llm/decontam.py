"""Benchmark decontamination by a generalised suffix automaton (operator 9).

The items' normalised words build one suffix automaton that spells every run of words of any item.
Each document is streamed through it, tracking the longest run of words ending at each position
that some item contains. A position whose run reaches the window length completes a window: those
words are hits. An item shorter than the window counts as one window of its own length.

Items are read and broadcast in blocks of about ``block_bytes`` of text, which bounds an automaton (some
300 bytes for each byte of text) and the driver alike. One block is searched in one pass. Where there
are several, all documents are read twice, however many blocks there are: hashes of the items'
windows (``MARKS`` at a time) first say which blocks a text can have a match with, most texts with
none; the few that can are written, and each block goes over its own of them. A hash only ever adds
a text to be searched, so results are exact. A Python worker builds a block's automaton once, and knows
it by the run and the number of the block.

Defined results: a null or empty text has no words and no hits; items without words never match;
equal items each count; rows with a null or repeated id are documents like others; items with a null
id or text are left out; an empty item table leaves every document clean, an empty document table
gives an empty result; very long texts are streamed, never cut; columns other than the id and text
may have any name.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import Words, cache, lean, pieces, shingles
from lexloom.llm.storage import drop, materialise

WINDOW = 10
BLOCK_BYTES = 1_000_000
MAX_COVERAGE = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._label(items)

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1)
        self.next[c] = dict(self.next[q])
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _ancestor(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of what ``state`` spells."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _label(self, items: list[tuple[str, list[int]]]) -> None:
        """windows[state]: (length, items) that a match reaching that length completes there."""
        by_gram: dict[tuple[int, int], set[str]] = {}
        for item, words in items:
            need = min(len(words), self.window)
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= need:
                    by_gram.setdefault((self._ancestor(state, need), need), set()).add(item)
        own: dict[int, list[tuple[int, frozenset[str]]]] = {}
        for (state, need), found in by_gram.items():
            own.setdefault(state, []).append((need, frozenset(found)))
        self.windows: list[list[tuple[int, frozenset[str]]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.windows[state] = own.get(state, []) + self.windows[self.link[state]]

    def stream(self, words: list[int], base: int, hits: list[tuple[int, int]], found: set[str]) -> None:
        nxt, link, length, windows = self.next, self.link, self.length, self.windows
        state = matched = 0
        for i, w in enumerate(words, base + 1):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            widest = 0
            for need, items in windows[state]:
                if need <= matched:
                    found |= items
                    widest = max(widest, need)
            if widest:
                if hits and hits[-1][1] >= i - widest:
                    hits[-1] = (min(hits[-1][0], i - widest), i)
                    while len(hits) > 1 and hits[-2][1] >= hits[-1][0]:
                        top = hits.pop()
                        hits[-1] = (min(hits[-1][0], top[0]), top[1])
                else:
                    hits.append((i - widest, i))


class Index:
    """What tasks need of one block of items: vocabulary, automaton and shortest window."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        spelled = [(i, ids[a:b].tolist()) for (i, _), a, b in zip(items, words.rows, words.rows[1:], strict=False) if b > a]
        self.automaton = SuffixAutomaton(spelled, window)
        self.shortest = min([window, *(len(w) for _, w in spelled)])

    def scan(self, words: Words) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per row: merged spans of hit words, counted from the row's first, and the items."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in range(len(words.rows) - 1)]
        if not len(self.vocabulary) or not len(words.hashes):
            return out
        at = np.minimum(np.searchsorted(self.vocabulary, words.hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == words.hashes
        # runs of known words, cut at the rows' ends, that are long enough to hold a window
        edge = np.zeros(len(known) + 1, bool)
        edge[words.rows] = True
        begin = np.flatnonzero(known & (edge[:-1] | np.concatenate([[True], ~known[:-1]])))
        end = np.flatnonzero(known & (edge[1:] | np.concatenate([~known[1:], [True]]))) + 1
        long = end - begin >= self.shortest
        begin, end = begin[long], end[long]
        rows = np.searchsorted(words.rows, begin, "right") - 1
        for a, b, r in zip(begin.tolist(), end.tolist(), rows.tolist(), strict=True):
            hits, found = out[r]
            self.automaton.stream(at[a:b].tolist(), a - int(words.rows[r]), hits, found)
        return out


SCANNED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
])


_built: dict[str, object] = cache("decontam")


def _kept(name: str, make):
    """What a worker has made of a broadcast value, by a name that no other value has."""
    if name not in _built:
        _built.clear()
        _built[name] = make()
    return _built[name]


def _over_blocks(rows: DataFrame, items: DataFrame, item_id: str, item_text: str, window: int, block_bytes: int, last_schema: T.StructType, finish) -> DataFrame:
    """rows (body, ..., runs, names) after all blocks: finish(batch, words, runs, names) makes what
    the last one returns of word runs and items found."""
    slim = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n, run = max(1, -(-total // block_bytes)), uuid.uuid4().hex
    spark = rows.sparkSession

    def scanned(some: DataFrame, b: int, last: bool) -> tuple[DataFrame, Broadcast]:
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        shared = spark.sparkContext.broadcast([(r.i, r.t) for r in part.collect()])
        return some.mapInArrow(lean(_scanner(shared, f"{run}-{b}", window, finish if last else None), "decontam"), last_schema if last else some.schema), shared

    if n == 1:
        return scanned(rows, 0, True)[0]
    marked = _marked(rows, slim.select("t", F.pmod(F.xxhash64("i", "t"), F.lit(n)).alias("b")), window, run)
    clean = marked.where(F.size("marks") == 0).drop("marks").mapInArrow(lean(_scanner(None, run, window, finish), "decontam"), last_schema)
    some, kept = materialise(marked.where(F.size("marks") > 0), "decontam")
    for b in range(n):
        out, shared = scanned(some.where(F.array_contains("marks", b)), b, False)
        done, path = materialise(out.unionByName(some.where(~F.array_contains("marks", b))), "decontam")
        drop(spark, kept)
        shared.destroy()
        some, kept = done, path
    return clean.unionByName(some.drop("marks").mapInArrow(lean(_scanner(None, run, window, finish), "decontam"), last_schema))


#: Windows of items, as hashes, that are broadcast at once.
MARKS = 8_000_000


def _marked(rows: DataFrame, items: DataFrame, window: int, run: str) -> DataFrame:
    """rows with a column marks: the blocks that have an item of which a window's hash is in the text.
    Texts without marks hold no window; what has one is searched exactly. items: t, b."""
    spark = rows.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("t"))
            h, bounds = shingles(words, window)
            each, n = np.diff(bounds), np.minimum(np.diff(words.rows), window)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("b")).astype(np.int32), each)), pa.array(np.repeat(n, each).astype(np.int32))], names=["h", "b", "n"])

    grams, kept = materialise(items.mapInArrow(lean(hashed), "h long, b int, n int").distinct(), "windows")
    sizes = sorted(r.n for r in grams.select("n").distinct().collect())  # as many as a window has words
    chunks = max(1, -(-grams.count() // MARKS))
    out = rows.withColumn("marks", F.array().cast("array<int>"))
    for c in range(chunks):
        table = grams.where(F.pmod("h", F.lit(chunks)) == c).select("h", "b").orderBy("h").toArrow()
        shared = spark.sparkContext.broadcast((np.asarray(table.column("h")), np.asarray(table.column("b"))))

        def run_(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, blocks = shared.value
            for batch in pieces(batches, "body"):
                words = Words(batch.column("body"))
                found = [np.zeros(0, np.int64)]
                for n in sizes:
                    h, bounds = shingles(words, n)
                    h = h.view(np.int64)
                    low, high = np.searchsorted(known, h), np.searchsorted(known, h, "right")
                    at = np.flatnonzero(high > low)
                    many = (high - low)[at]
                    which = np.repeat(low[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    row = np.searchsorted(bounds, at, "right") - 1
                    found.append(np.unique(np.repeat(row, many) << 32 | blocks[which]))
                both = np.unique(np.concatenate(found))
                cuts = np.searchsorted(both >> 32, np.arange(batch.num_rows + 1))
                marks = [sorted({*old, *(both[a:b] & 0xFFFFFFFF).tolist()}) for old, a, b in zip(batch.column("marks").to_pylist(), cuts, cuts[1:], strict=False)]
                yield batch.set_column(batch.num_columns - 1, "marks", pa.array(marks, pa.list_(pa.int32())))

        out = out.mapInArrow(lean(run_, "decontam"), out.schema)
        if c + 1 < chunks:
            out, _ = materialise(out, "decontam")
            shared.destroy()
    return out


def _scanner(shared: Broadcast | None, name: str, window: int, finish):
    """A task's function: the block's matches join those of before. Without a block, only finish."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            words = Words(batch.column("body"))
            before = zip(batch.column("runs").to_pylist(), batch.column("names").to_pylist(), strict=True)
            now = _kept(name, lambda: Index(shared.value, window)).scan(words) if shared else [([], set())] * batch.num_rows
            runs, names = [], []
            for (spans, found), (old, old_names) in zip(now, before, strict=True):
                runs.append(_merged([*zip(old[::2], old[1::2], strict=True), *spans]) if old else spans)
                names.append(sorted(found | set(old_names or ())))
            if finish:
                yield finish(batch, words, runs, names)
            else:
                k = batch.schema.get_field_index("runs")
                flat = [pa.array([[x for span in r for x in span] for r in runs], pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield batch.set_column(k, "runs", flat[0]).set_column(k + 1, "names", flat[1])

    return run


def _nothing_yet(*columns: Column) -> list[Column]:
    return [*columns, F.lit(None).cast(T.ArrayType(T.LongType())).alias("runs"), F.lit(None).cast(T.ArrayType(T.StringType())).alias("names")]


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: id, n_words, n_hit, hit_items, and hit_spans: byte starts and ends of the hit
    runs, alternating. ``window`` is the length limit in words."""
    rows = docs.select(*_nothing_yet(F.col(id_col).alias("id"), F.col(text_col).alias("body")))

    def finish(batch: pa.RecordBatch, words: Words, runs: list, names: list) -> pa.RecordBatch:
        spans = []
        for r, run in enumerate(runs):
            w, o = words.rows[r], words.offsets[r]
            spans.append([int(x) for a, b in run for x in (words.starts[w + a] - o, words.ends[w + b - 1] - o)])
        hit = [sum(b - a for a, b in run) for run in runs]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(words.rows), pa.int64()), pa.array(hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))], names=["id", *SCANNED.names])

    out = _over_blocks(rows, items, item_id, item_text, window, block_bytes, T.StructType([rows.schema["id"], *SCANNED.fields]), finish)
    return out.withColumnRenamed("id", id_col)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The digest of ``scan``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    id_col = how.get("id_col", "doc_id")
    joined: Column = F.concat_ws(",", F.array_sort("hit_items"))
    return scan(docs, items, **how).select(
        F.col(id_col), "n_words", "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", max_coverage: float = MAX_COVERAGE, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without their hit runs, in the same columns. A document with more than
    ``max_coverage`` of its words hit goes altogether. ``n_chars``, if there, follows the text."""
    columns = docs.columns
    rows = docs.select(*_nothing_yet(F.struct(*(F.col(c) for c in columns if c != text_col), F.lit(0).alias("_")).alias("others"), F.col(text_col).alias("body")))

    def finish(batch: pa.RecordBatch, words: Words, runs: list, names: list) -> pa.RecordBatch:
        texts, keep = batch.column("body").to_pylist(), []
        for r, spans in enumerate(runs):
            n = int(words.rows[r + 1] - words.rows[r])
            keep.append(not spans or sum(b - a for a, b in spans) <= max_coverage * n)
            if spans and keep[-1]:
                w, o = words.rows[r], words.offsets[r]
                raw = words.buf[o : words.offsets[r + 1]].tobytes()
                cut, at = [], 0
                for a, b in spans:
                    cut.append(raw[at : words.starts[w + a] - o])
                    at = int(words.ends[w + b - 1] - o)
                texts[r] = b"".join([*cut, raw[at:]]).decode("utf-8", "replace")
        others = dict(zip((c for c in columns if c != text_col), batch.column("others").flatten(), strict=False))
        whole = pa.RecordBatch.from_arrays([batch.column("body") if c == text_col else others[c] for c in columns], names=columns)
        return with_text(whole, text_col, texts).filter(pa.array(keep))

    return _over_blocks(rows, items, item_id, item_text, window, block_bytes, docs.schema, finish)


def with_text(batch: pa.RecordBatch, text_col: str, texts: list[str | None]) -> pa.RecordBatch:
    """The batch with other texts, and n_chars to suit."""
    k = batch.schema.get_field_index(text_col)
    out = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
    n = batch.schema.get_field_index("n_chars")
    if n >= 0:
        old = batch.column(n).to_pylist()
        new = [o if t is None else len(t) for o, t in zip(old, texts, strict=True)]
        out = out.set_column(n, batch.schema.field(n), pa.array(new, batch.schema.field(n).type))
    return out


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The report's rows by direct search, for tests."""
    import re

    spell = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams: dict[tuple[str, ...], set[str]] = {}
    for i, t in items:
        w = spell(t)
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[a : a + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = spell(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a : a + n])) in grams:
                    hit |= {*range(a, a + n)}
                    names |= grams[g]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPELLED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SPELLED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SPELLED} AS w FROM benchmark),
g AS (SELECT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0))),
x AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM x JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
