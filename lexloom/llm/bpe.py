"""Byte-level BPE as a streaming transducer, and its inverse (operator 4).

Encoding. A text is cut at special tokens, then into pieces by the vocabulary's pattern, then each
piece runs through a transducer that reads bytes left to right. For every position it keeps the
last token of the encoding of the bytes before it; that token is the only one whose left
neighbour, itself such a last token, would stay apart from it under the merges. Later bytes can
only reach back through tokens that start at one of the last M positions, M being the longest
token that the merge list makes: the sufficient lookahead. Where the paths back from those
positions meet, all before is stable, is emitted and forgotten, so memory does not grow with the
piece. Pieces of up to ``SHORT`` bytes are shorter than any need to forget; their transducer keeps
all its positions, and shares those of equal beginnings. Texts are read in chunks as well, of which
only an unfinished last piece is carried on; digests of texts over ``LONG`` characters take each
chunk's ids as they come.

Decoding. Token bytes are fed to an incremental UTF-8 state machine, which holds at most three
bytes; what is not UTF-8 becomes U+FFFD, one for each maximal invalid part.

Defined results: null or empty text gives no ids and decodes to the empty text; equal texts give
equal ids; rows with a null or repeated id are encoded like others; an empty table gives an empty
result; columns other than id and text may have any name. ``SHORT``, ``LONG``, ``CACHE`` and the
sizes of tables change the cost, not a result. Pieces' encodings are cached per Python worker, up to ``CACHE`` pieces, and looked up
for many texts at once (see ``Batch``).
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm._text import cache, fmix, lean, powers
from lexloom.llm._text import pieces as text_pieces

CACHE = 40_000
SHORT = 48
LONG = 1 << 20
CHUNK = 1 << 16
#: White space as Unicode defines it, and English contractions of the pattern.
SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class_of(initial: str, last: int) -> str:
    """A character class of all characters up to ``last`` whose category begins with ``initial``."""
    parts, begin = [], None
    for c in range(last + 2):
        inside = c <= last and unicodedata.category(chr(c))[0] == initial
        if inside and begin is None:
            begin = c
        elif not inside and begin is not None:
            parts.append(re.escape(chr(begin)) + ("-" + re.escape(chr(c - 1)) if c - 1 > begin else ""))
            begin = None
    return "".join(parts)


def _pattern(last: int) -> re.Pattern[str]:
    letter, number = _class_of("L", last), _class_of("N", last)
    return re.compile(f"{CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


_patterns: dict[int, re.Pattern[str]] = {}
_astral = re.compile("[\U00010000-\U0010ffff]")


def pattern_for(text: str) -> re.Pattern[str]:
    """The piece pattern, without the rare planes where the text has none of their characters."""
    last = sys.maxunicode if _astral.search(text) else 0xFFFF
    if last not in _patterns:
        _patterns[last] = _pattern(last)
    return _patterns[last]


def cut_pieces(text: str, chunk: int = CHUNK) -> Iterator[list[str]]:
    """Pieces of a text, a list for each chunk read. What the last piece of a chunk will be depends
    on what follows, so it is read again with the next chunk."""
    find = pattern_for(text).findall
    if len(text) <= chunk:
        yield find(text)
        return
    at, size, held = 0, chunk, ""
    while at < len(text):
        part = held + text[at : at + size]
        at += size
        found = find(part)
        if at < len(text):
            held = found.pop()
            size = chunk if found else 2 * size
        yield found


class ByteBPE:
    """A merge list as a transducer. ``spec`` is what ``load`` returns."""

    def __init__(self, spec: dict):
        self.bytes_of: dict[int, bytes] = dict(spec["tokens"])
        self.special: dict[str, int] = spec["special"]
        ids = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(spec["merges"]):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((x, y), r)
            halves.setdefault(z, (x, y, r))
        self.halves = halves
        # no merge makes a longer token, so no boundary further back can still move
        self.lookahead = max([len(a) + len(b) for a, b in spec["merges"]] + [len(b) for b in self.bytes_of.values()])
        self.trie: dict = {}
        for b, i in ids.items():
            node = self.trie
            for c in reversed(b):
                node = node.setdefault(c, {})
            node[-1] = i
        self.text_of = {i: str(i) for i in [*self.bytes_of, *self.special.values()]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self._apart: dict[tuple[int, int], bool] = {}
        self._spines: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._cache: dict[str, tuple[int, ...]] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._prefixes: dict[bytes, tuple[int, ...]] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols at one edge of a token while it is built, each with the rank that ends it."""
        if token not in self._spines[side]:
            out, end = [(token, float("inf"))], token
            while end in self.halves:
                x, y, r = self.halves[end]
                end = (x, y)[side]
                out.append((end, r))
            self._spines[side][token] = out[::-1]
        return self._spines[side][token]

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether no merge ever crosses the boundary between tokens a and b. The edges' symbols
        pass in order of rank; a crossing pair wins if its rank comes before both sides' next
        (of equal pairs the leftmost is first)."""
        known = self._apart.get((a, b))
        if known is None:
            left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
            known = True
            while True:
                (x, x_end), (y, y_end) = left[i], right[j]
                p = self.rank.get((x, y))
                if p is not None and p < x_end and p <= y_end:
                    known = False
                    break
                if x_end <= y_end and i + 1 < len(left):
                    i += 1
                elif j + 1 < len(right):
                    j += 1
                else:
                    break
            self._apart[a, b] = known
        return known

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of a piece that comes in parts, each emitted once no later byte can change it."""
        tail, last, start = b"", [-1], [0]  # of each live position: its last token, and where that starts
        for part in data:
            tail += part
            while len(last) <= len(tail):
                n = len(last)
                node, ends, k = self.trie, [], n - 1
                while k >= 0 and (node := node.get(tail[k])) is not None:
                    if -1 in node:
                        ends.append((k, node[-1]))
                    k -= 1
                for k, token in reversed(ends):
                    if not k and last[0] == -1 or last[k] != -1 and self.stays_apart(last[k], token):
                        break
                else:
                    k, token = n, -1  # inside a character's bytes that no token ends at; never met with all bytes as tokens
                last.append(token)
                start.append(k)
                if n >= 4 * self.lookahead and n % self.lookahead == 0:
                    ids, n = self._stable(last, start)
                    if n:
                        yield from ids
                        tail, last, start = tail[n:], last[n:], [max(0, s - n) for s in start[n:]]
        yield from self._path(last, start, len(tail), 0)

    def _stable(self, last: list[int], start: list[int]) -> tuple[list[int], int]:
        """Tokens before the position where the paths back from all live positions meet."""
        n = len(last) - 1
        live = set(range(n - self.lookahead + 1, n + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(start[top])
        meet = live.pop()
        return self._path(last, start, meet, 0), meet

    @staticmethod
    def _path(last: list[int], start: list[int], at: int, to: int) -> list[int]:
        out = []
        while at > to:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece. What is found is kept in two generations: when the young one is full, it
        takes the place of the old, so that pieces in use stay."""
        ids = self._old.pop(text, None)
        if ids is None:
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                parts = (raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK))
                return tuple(self.stream(parts))
            ids = self._prefix(raw)
        if len(self._cache) >= CACHE:
            self._cache, self._old, self._prefixes = {}, self._cache, {}
        self._cache[text] = ids
        return ids

    def _prefix(self, raw: bytes) -> tuple[int, ...]:
        """The transducer's state after these bytes, as all ids so far: its last token is the one
        that stays apart from the last token of what is before it. Pieces share their prefixes'."""
        ids = self._prefixes.get(raw)
        if ids is None:
            node, ends, k = self.trie, [], len(raw)
            while k and (node := node.get(raw[k - 1])) is not None:
                k -= 1
                if -1 in node:
                    ends.append((k, node[-1]))
            for k, token in reversed(ends):
                if not k:
                    ids = (token,)
                    break
                before = self._prefix(raw[:k])
                if self.stays_apart(before[-1], token):
                    ids = (*before, token)
                    break
            if len(self._prefixes) >= 4 * CACHE:
                self._prefixes.clear()
            self._prefixes[raw] = ids
        return ids

    def encode(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text, a list for each part that is done."""
        for part, special in self._sections(text or ""):
            for found in cut_pieces(part):
                get = self._cache.get  # the young generation at the time; the rest goes through piece()
                yield list(chain.from_iterable([get(p) or self.piece(p) for p in found]))
            if special is not None:
                yield [special]

    def _sections(self, text: str) -> Iterator[tuple[str, int | None]]:
        if not self.special or not any(s in text for s in self.special):
            yield text, None
            return
        at = 0
        for m in re.finditer("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))), text):
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, parts: Iterable[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        get = self.bytes_of.__getitem__
        for ids in parts:
            yield machine.decode(b"".join(map(get, ids)))
        yield machine.decode(b"", True)


LETTER, NUMBER, BLANK, BREAK = 1, 2, 3, 4
STOP = 0x110000  # stands between texts
TABLE_BITS = 20
POOL = 4_000_000
_U = np.uint64
_known: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and hash value of every character."""
    if not _known:
        kinds = {"L": LETTER, "N": NUMBER}
        classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(STOP)), np.uint8, STOP)
        classes = np.append(classes, np.uint8(BREAK))
        for part in re.findall("(.)(?:-(.))?", SPACE, re.S):
            classes[ord(part[0]) : ord(part[1] or part[0]) + 1] = BLANK
        _known.extend([classes, fmix(np.arange(STOP + 1, dtype=_U) + _U(0x51ED2701)) | _U(1)])
    return _known[0], _known[1]


def piece_starts(chars: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a piece of the pattern starts at each character: runs of one class, with one space
    before them; of other white space all but what is last goes first; contractions apart."""
    n = len(chars)
    kind = classes[chars]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
    ahead = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] < BLANK))  # the last blank before a word
    start[ahead] = True
    start[ahead[chars[ahead] == 32] + 1] = False
    for q in np.flatnonzero((chars[:-1] == 39) & start[:-1] & (kind[1:] == LETTER)).tolist():
        one, two = chr(chars[q + 1]), "".join(map(chr, chars[q + 1 : q + 3].tolist())) if q + 2 < n and chars[q + 2] < STOP else ""
        k = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") else 0
        if k:
            start[q + 1] = False
            if q + 1 + k < n:
                start[q + 1 + k] = True
    return start


def gathered(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices of a pool one after another, and where each ends."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return pool[at], ends


class Batch:
    """Encodes many texts at once. Pieces are found, hashed and looked up as arrays, in a table with
    one place for each value of some bits; pieces that it does not hold go through the transducer."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.classes, self.values = _characters()
        self._clear()
        top = max(bpe.bytes_of) + 1
        raws, texts = [bpe.bytes_of.get(i, b"") for i in range(top)], [f"{i},".encode() for i in range(top)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raws), np.uint8), np.array([len(r) for r in raws])
        self.dec, self.dec_size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(r) for r in texts])
        self.raw_at, self.dec_at = np.cumsum(self.raw_size) - self.raw_size, np.cumsum(self.dec_size) - self.dec_size

    def _clear(self) -> None:
        self.hash = np.zeros(1 << TABLE_BITS, _U)
        self.begin = np.zeros(1 << TABLE_BITS, np.int64)
        self.size = np.zeros(1 << TABLE_BITS, np.int64)
        self.pool = np.zeros(POOL, np.int32)
        self.used = 0

    def is_odd(self, text: str) -> bool:
        """Whether a text is long, or has special tokens, and so is encoded by itself."""
        return len(text) > LONG or any(s in text for s in self.bpe.special)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, and hashes of these and of the decoded text, of one text at any length:
        nothing is held but a chunk."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

        def passing() -> Iterator[list[int]]:
            nonlocal n
            for ids in self.bpe.encode(text):
                if ids:
                    ids_hash.update(((b"," if n else b"") + ",".join(map(self.bpe.text_of.__getitem__, ids)).encode()))
                    n += len(ids)
                yield ids

        for part in self.bpe.decode(passing()):
            text_hash.update(part.encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and each text's range of them."""
        odd = [self.is_odd(t) for t in texts]
        if any(odd):
            parts = [np.fromiter(chain.from_iterable(self.bpe.encode(t)), np.int32) if o else self._plain([t])[0] for t, o in zip(texts, odd, strict=True)]
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        chars = np.full(int(sizes.sum()) + len(texts), STOP, np.uint32)
        stops = np.cumsum(sizes + 1) - 1
        whole = "\0".join(texts)
        chars[: len(whole)] = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[stops] = STOP
        starts = np.flatnonzero(piece_starts(chars, self.classes))
        ends = np.append(starts[1:], len(chars))
        live = chars[starts] != STOP
        starts, ends = starts[live], ends[live]
        power, inverse = powers(len(chars) + 1)
        sums = np.zeros(len(chars) + 1, _U)
        np.cumsum(self.values[chars] * power[:-1], out=sums[1:])
        h = fmix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U)) | _U(1)
        place = (h >> _U(64 - TABLE_BITS)).astype(np.int64)
        missing = np.flatnonzero(self.hash[place] != h)
        extra: dict[int, list[int]] = {}
        if len(missing):
            self._learn(missing, whole, starts, ends, h, place)
            missing = np.flatnonzero(self.hash[place] != h)  # what lost its place to another
            for k in missing.tolist():
                extra[k] = self.bpe.piece(whole[starts[k] : ends[k]])
        begin, size = self.begin[place], self.size[place]
        pool = self.pool
        if extra:
            more = [np.array(extra[k], np.int32) for k in missing.tolist()]
            size[missing] = [len(m) for m in more]
            begin[missing] = POOL + np.cumsum(size[missing]) - size[missing]
            pool = np.concatenate([pool, *more])
        ids, ids_end = gathered(pool, begin, size)
        # a text's pieces begin after the stop before it
        upto = np.concatenate([[0], ids_end])[np.searchsorted(starts, stops)]
        return ids, np.concatenate([[0], upto])

    def _learn(self, missing: np.ndarray, whole: str, starts, ends, h, place) -> None:
        """Encode the pieces that the table lacks, one for each of its places, and store them."""
        missing = missing[ends[missing] - starts[missing] <= SHORT]
        missing = missing[np.unique(h[missing], return_index=True)[1]]
        missing = missing[np.unique(place[missing], return_index=True)[1]]
        made = [self.bpe.piece(whole[a:b]) for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)]
        sizes = np.array([len(m) for m in made], np.int64)
        total = int(sizes.sum())
        if self.used + total > POOL:
            self._clear()
        if not total or total > POOL:
            return
        at = place[missing]
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(made), np.int32, total)
        self.hash[at], self.begin[at], self.size[at] = h[missing], self.used + np.cumsum(sizes) - sizes, sizes
        self.used += total

    def decimal(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids in decimal, a comma after each, and where each ends."""
        out, ends = gathered(self.dec, self.dec_at[ids], self.dec_size[ids])
        return out.tobytes(), ends

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        out, ends = gathered(self.raw, self.raw_at[ids], self.raw_size[ids])
        return out.tobytes(), ends


def decoded(raw: bytes, chunk: int = 1 << 20) -> Iterator[str]:
    """Text of token bytes through the incremental machine."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    for i in range(0, len(raw), chunk):
        yield machine.decode(raw[i : i + chunk])
    yield machine.decode(b"", True)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> dict:
    """Tokens, merges and special tokens of a byte-level tokenizer file, as bytes."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*printable}))}
    raw = lambda s: bytes(shown[c] for c in s)
    special = {t["content"]: t["id"] for t in doc["added_tokens"]}
    tokens = [(i, raw(t)) for t, i in doc["model"]["vocab"].items() if t not in special]
    merges = [m.split(" ") if isinstance(m, str) else m for m in doc["model"]["merges"]]
    return {"tokens": tokens, "merges": [(raw(a), raw(b)) for a, b in merges], "special": special}


_built: dict[tuple[int, type], Batch] = cache("bpe")


def of_worker(shared, kind: type[ByteBPE] = ByteBPE) -> Batch:
    """The encoder of a broadcast vocabulary, built once in each Python worker."""
    key = (id(shared.value), kind)
    if key not in _built:
        _built.clear()
        _built[key] = Batch(kind(shared.value))
    return _built[key]


DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids, as
    token_ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(load(vocabulary or default_vocabulary()))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    extra = [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([slim.schema["id"], *DIGESTS.fields, *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = of_worker(shared)
        for batch in text_pieces(batches, "body", 150_000):
            texts = [t or "" for t in batch.column("body").to_pylist()]
            alone = {} if with_ids else {k: coder.digests(t) for k, t in enumerate(texts) if coder.is_odd(t)}
            ids, bounds = coder.encode(["" if k in alone else t for k, t in enumerate(texts)])
            text, text_end = coder.decimal(ids)
            raw, raw_end = coder.bytes_of(ids)
            text_at, raw_at = np.concatenate([[0], text_end])[bounds].tolist(), np.concatenate([[0], raw_end])[bounds].tolist()
            ids_hex, decoded_hex = [], []
            for k in range(batch.num_rows):
                ids_hex.append(hashlib.sha256(text[text_at[k] : max(text_at[k], text_at[k + 1] - 1)]).hexdigest())
                of_text = hashlib.sha256()
                for part in decoded(raw[raw_at[k] : raw_at[k + 1]]):
                    of_text.update(part.encode("utf-8"))
                decoded_hex.append(of_text.hexdigest())
            counts = np.diff(bounds).tolist()
            for k, (n, of_ids, of_text) in alone.items():
                counts[k], ids_hex[k], decoded_hex[k] = n, of_ids, of_text
            cols = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())]
            cols += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return slim.mapInArrow(lean(run, "bpe"), schema).withColumnRenamed("id", id_col)
