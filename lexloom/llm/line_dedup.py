"""Line dedup by winnowing over line hashes (operator 8).

Lines are compared by their words (``_text``); lines without words are kept and passed over. A
window is a smallest run of lines that begins, or that ends, at a given line and has at least
``min_words`` words. Each window selects the smallest of its line hashes, the first of equal ones, as
its fingerprint, so any two runs of at least ``min_words`` words that are equal select equal
fingerprints at equal places: nothing that long is missed. Only selected positions travel, one row
for each, with the lines around them as one hash for each window that selected it.

Positions are joined on the fingerprint alone; where it occurs once, nothing repeats and the
position goes no further. Those that meet others are extended both ways to the windows that they
stand for; of equal windows the earliest (id, text, line) is the original, and every later one is a
match. Merged with the windows that begin and end at the neighbouring lines, matches reach exactly
the ends of the longest equal runs, since such a run's first window begins and its last window ends
with it. The later runs' lines are deleted, judged on the input as it was.

No group is ever gathered: fingerprints and originals are partial minima, and each later window
meets one row.

Defined results: null or empty text, or rows with a null id, stay as they are; rows with one id and
different texts are different documents, in the order of their texts' hashes; rows that repeat an id
and its text all keep the same lines; an empty table gives an empty result; columns other than id and
text may have any name and are carried along untouched (``n_chars``, if there, follows the text). Not
caught: a passage that repeats within a longer line, or that begins or ends in mid-line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import Words, fmix, lean, pieces, powers
from lexloom.llm.decontam import with_text
from lexloom.llm.storage import materialise

MIN_WORDS = 30
_U = np.uint64


class Lines:
    """The lines that have words: byte spans in the buffer, words, hashes, and each row's range."""

    def __init__(self, col: pa.Array):
        words = Words(col)
        self.words = words
        newline = np.flatnonzero(words.buf == 10) + 1
        begins = np.unique(np.concatenate([words.offsets, newline]))
        of_word = np.searchsorted(begins, words.starts, "right") - 1
        live, first, counts = np.unique(of_word, return_index=True, return_counts=True)
        self.starts = begins[live]
        self.ends = np.append(begins, len(words.buf))[live + 1]
        self.counts = counts
        self.rows = np.searchsorted(self.starts, words.offsets)
        self.hashes = _runs(_sums(words.hashes), first, first + counts)
        self.sums = _sums(self.hashes)

    def windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First line, line after the last, and row of every window."""
        total = np.concatenate([[0], np.cumsum(self.counts)])
        n = len(self.counts)
        row = np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))
        at = np.arange(n)
        ahead = np.searchsorted(total, total[:-1] + min_words)
        back = np.searchsorted(total, total[1:] - min_words, "right") - 1
        ok, ko = ahead <= self.rows[row + 1], back >= self.rows[row]
        first = np.concatenate([at[ok], back[ko]])
        after = np.concatenate([ahead[ok], at[ko] + 1])
        both = np.unique(first * (n + 1) + after)
        first, after = both // (n + 1), both % (n + 1)
        return first, after, row[first] if n else first


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, _U)
    np.cumsum(h * powers(len(h))[0], out=out[1:])
    return out


def _runs(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return fmix((sums[b] - sums[a]) * powers(len(sums))[1][a] + (b - a).astype(_U))


def _selected(docs: DataFrame, min_words: int) -> DataFrame:
    """Per selected position: fingerprint, id, key, place, and the windows that selected it."""
    window = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("content", T.LongType())])
    schema = T.StructType([T.StructField("fingerprint", T.LongType()), docs.schema["id"], T.StructField("key", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("windows", T.ArrayType(window))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            lines = Lines(batch.column("body"))
            first, after, row = lines.windows(min_words)
            if not len(first):
                continue
            place = minima(lines.hashes, first, after)
            order = np.argsort(place, kind="stable")
            first, after, row, place = first[order], after[order], row[order], place[order]
            heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            begins = lines.rows[row]
            content = _runs(lines.sums, first, after).view(np.int64)
            windows = pa.StructArray.from_arrays([pa.array((first - begins).astype(np.int32)), pa.array((after - first).astype(np.int32)), pa.array(content)], names=window.names)
            rows = pa.array(row[heads])
            yield pa.RecordBatch.from_arrays([pa.array(lines.hashes[place[heads]].view(np.int64)), batch.column("id").take(rows), batch.column("key").take(rows), pa.array((place - begins)[heads].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(heads, len(place)).astype(np.int32)), windows)], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def minima(hashes: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where each window's smallest hash is, the first of equal ones."""
    lengths = after - first
    begins = np.cumsum(lengths) - lengths
    at = np.repeat(first - begins, lengths) + np.arange(lengths.sum())
    least = np.flatnonzero(hashes[at] == np.repeat(np.minimum.reduceat(hashes[at], begins), lengths))
    return at[least[np.searchsorted(least, begins)]]


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per text with any: id, key (the text's hash) and runs, an array of <line, n>: the windows that
    repeat earlier ones. Lines are counted among those that have words."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id is not null and body is not null").withColumn("key", F.xxhash64("body"))
    selected, _ = materialise(_selected(slim, min_words), "selected")
    place = F.xxhash64("id", "key", "place")
    met = selected.groupBy("fingerprint").agg(F.min(place).alias("one"), F.max(place).alias("other")).where("one <> other").select("fingerprint")
    windows = selected.join(met, "fingerprint", "left_semi").select("id", "key", F.inline("windows"))
    at = F.struct("id", "key", "line")
    origin = windows.groupBy("content", "n").agg(F.min(at).alias("origin"), F.max(at).alias("last")).where("origin < last").drop("last")
    later = windows.join(origin, ["content", "n"]).where(at > F.col("origin"))
    return later.groupBy("id", "key").agg(F.collect_set(F.struct("line", "n")).alias("runs"))


def _cut(lines: Lines, row: int, runs: list[dict]) -> tuple[bytes, int, int]:
    """The row's bytes without its repeated lines, how many these are, and in how many runs."""
    lo, hi = int(lines.words.offsets[row]), int(lines.words.offsets[row + 1])
    gone = np.zeros(int(lines.rows[row + 1] - lines.rows[row]) + 1, bool)
    for r in runs:
        gone[r["line"] : r["line"] + r["n"]] = True
    keep, at = [], lo
    for k in np.flatnonzero(gone[:-1]) + int(lines.rows[row]):
        keep.append(lines.words.buf[at : lines.starts[k]].tobytes())
        at = int(min(lines.ends[k], hi))
    keep.append(lines.words.buf[at:hi].tobytes())
    raw = b"".join(keep)
    if gone[:-1].any() and at == hi and lines.words.buf[hi - 1] != 10:  # no line end was its own
        raw = raw.removesuffix(b"\n")
    return raw, int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(gone) > 1 else 0


def _with_runs(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(row, runs): each document whole, and its repeated runs."""
    runs = repeated_lines(docs, id_col, text_col, min_words)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"))
    return rows.join(runs, ["id", "key"], "left").select("row", "runs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later repeated runs of lines, in the same columns. A document that
    loses every line that had words goes altogether: an earlier document has all it said."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (pa.RecordBatch.from_arrays([*b.column("row").flatten(), b.column("runs")], names=[*names, "\0runs"]) for b in batches)
        for batch in pieces(flat, text_col):
            texts, keep = batch.column(names.index(text_col)).to_pylist(), []
            found = batch.column(len(names)).to_pylist()
            lines = Lines(batch.column(names.index(text_col))) if any(found) else None
            for r, runs in enumerate(found):
                keep.append(True)
                if runs:
                    raw, n, _ = _cut(lines, r, runs)
                    keep[-1] = n < lines.rows[r + 1] - lines.rows[r]
                    texts[r] = raw.decode("utf-8", "replace")
            yield with_text(batch.select(range(len(names))), text_col, texts).filter(pa.array(keep))

    return _with_runs(docs, id_col, text_col, min_words).mapInArrow(lean(run), docs.schema)


REPORT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed", "n_runs")] + [T.StructField("kept_sha256", T.StringType())])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: id, n_lines with words, n_removed of them, in n_runs, and kept_sha256, of the
    text that is left."""
    joined = _with_runs(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), "id", "body", min_words).select("row.id", "row.body", "runs")
    schema = T.StructType([joined.schema["id"], *REPORT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            lines = Lines(batch.column("body"))
            out = [_cut(lines, r, runs or []) for r, runs in enumerate(batch.column("runs").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(lines.rows), pa.int64()), pa.array([n for _, n, _ in out], pa.int64()), pa.array([k for _, _, k in out], pa.int64()), pa.array([hashlib.sha256(b).hexdigest() for b, _, _ in out], pa.string())], names=schema.names)

    return joined.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def brute_force(docs: list[tuple[int, str | None]], min_words: int = MIN_WORDS) -> list[tuple]:
    """The report's rows by comparing all runs of lines, for tests."""
    spell = lambda t: tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    split = {d: (t or "").split("\n") for d, t in docs}
    told = {d: [(k, w) for k, line in enumerate(lines) if (w := spell(line))] for d, lines in split.items()}
    seen: dict[tuple, tuple] = {}
    runs = []
    for d in sorted(told):
        for a in range(len(told[d])):
            for b in range(a + 1, len(told[d]) + 1):
                if sum(len(w) for _, w in told[d][a:b]) >= min_words:
                    key = tuple(w for _, w in told[d][a:b])
                    runs.append((d, a, b, key))
                    seen[key] = min(seen.get(key, (d, a)), (d, a))
    gone: dict = {d: set() for d in told}
    for d, a, b, key in runs:
        if seen[key] < (d, a):
            gone[d] |= {*range(a, b)}
    out = []
    for d, _ in docs:
        drop = {told[d][k][0] for k in gone[d]}
        text = "\n".join(line for k, line in enumerate(split[d]) if k not in drop)
        out.append((d, len(told[d]), len(drop), len([k for k in gone[d] if k - 1 not in gone[d]]), hashlib.sha256(text.encode()).hexdigest()))
    return out


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS k FROM s),
w AS (SELECT doc_id, k, line, regexp_extract_all(translate(line, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM l),
t AS (SELECT doc_id, k, array_to_string(ws, ' ') AS spelled, len(ws) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM w WHERE len(ws) > 0),
p AS (SELECT a.doc_id, a.i AS i, b.i AS j FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.n >= {MIN_WORDS} AND (b.upto - b.n - a.upto + a.n < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})),
c AS (SELECT p.doc_id, p.i, p.j, string_agg(t.spelled, chr(10) ORDER BY t.i) AS content FROM p JOIN t ON t.doc_id = p.doc_id AND t.i BETWEEN p.i AND p.j GROUP BY ALL),
o AS (SELECT content, min((doc_id, i)) AS origin FROM c GROUP BY content),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM c JOIN o USING (content) WHERE (doc_id, i) > origin),
r AS (SELECT g.doc_id, count(*) AS n_removed, count(*) FILTER (b.i IS NULL) AS n_runs FROM g LEFT JOIN g b ON b.doc_id = g.doc_id AND b.i = g.i - 1 GROUP BY g.doc_id),
d AS (SELECT t.doc_id, t.k FROM g JOIN t USING (doc_id, i)),
q AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.k) AS kept FROM l ANTI JOIN d ON d.doc_id = l.doc_id AND d.k = l.k GROUP BY l.doc_id)
SELECT s.doc_id, (SELECT count(*) FROM t WHERE t.doc_id = s.doc_id) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM s LEFT JOIN r ON r.doc_id = s.doc_id LEFT JOIN q ON q.doc_id = s.doc_id
"""
