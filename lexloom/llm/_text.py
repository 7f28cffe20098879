"""Vectorised words and rolling hashes over UTF-8 bytes of Arrow string columns.

A *word* is a maximal run of ASCII digits, ASCII letters and bytes of 0x80 and above, with A-Z
lower-cased. Hashes are sums of byte_value * BASE**position modulo 2**64, so that the hash of any
substring is a difference of prefix sums, times the inverse power of where it starts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)


def _table(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values from splitmix64."""
    with np.errstate(over="ignore"):
        return fmix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def fmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


BYTE_VALUE = _table(256, 7) | _U(1)
OTHER_VALUE = _table(256, 0x0DD) | _U(1)  # for a second, independent hash
_lower = np.arange(256)
_lower[65:91] += 32
WORD_VALUE = BYTE_VALUE[_lower]
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, grown by doubling and kept."""
    global _pow, _inv
    while len(_pow) < n:
        k = len(_pow)
        _pow = np.concatenate([_pow, _pow * _U(pow(BASE, k, 1 << 64))])
        _inv = np.concatenate([_inv, _inv * _U(pow(_INV, k, 1 << 64))])
    return _pow[:n], _inv[:n]


def prefix_sums(buf: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(values[buf] * powers(len(buf))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = powers(len(sums))[1]
    return fmix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(_U))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` text bytes, so that per-byte arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = string_buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a string column: byte spans, 64-bit hashes, and each row's range of words."""

    def __init__(self, col: pa.Array):
        self.buf, self.offsets = string_buffer(col)
        n = len(self.buf)
        inside = IS_WORD[self.buf]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.hashes = spans_hash(prefix_sums(self.buf, WORD_VALUE), self.starts, self.ends) if n else np.zeros(0, _U)
        self.rows = np.searchsorted(self.starts, self.offsets)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and each row's range of them. A row with fewer words, but
    some, has one shingle of all its words."""
    h, rows = words.hashes, words.rows
    counts = np.diff(rows)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    starts = np.repeat(rows[:-1] - bounds[:-1], made) + np.arange(bounds[-1])
    lengths = np.repeat(np.minimum(counts, size), made)
    out = lengths.astype(_U)
    for j in range(size):
        live = lengths > j
        at = np.minimum(starts + j, max(len(h) - 1, 0))
        out = np.where(live, fmix(out * _U(BASE) + h[at]), out) if len(h) else out
    return out, bounds


def dumped(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed string, for a row that stands for many; ``loaded`` reads it."""
    sizes = np.array([len(columns), *(c.nbytes for c in columns)], "<u8")
    raw = sizes.tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def loaded(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(body)[8:], int.from_bytes(body[:8], "little"), asbytes=True)
    sizes = np.frombuffer(raw, "<u8", len(kinds) + 1)
    ends = sizes.nbytes + np.cumsum(sizes[1:].astype(np.int64))
    return [np.frombuffer(raw[end - int(n) : end], kind) for kind, end, n in zip(kinds, ends, sizes[1:], strict=True)]


_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What a Python worker keeps from task to task of one operator, by name."""
    return _caches.setdefault(name, {})


def release(keep: str | None = None) -> bool:
    """Drop what other operators keep; whether there was any."""
    others = [held for name, held in _caches.items() if name != keep and held]
    for held in others:
        held.clear()
    return bool(others)


def trim() -> None:
    """Give free memory back to the system."""
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable:
    """The same function for a task, which gives free memory back to the system as it goes: Python
    workers live on between tasks, beside the executor's heap. keep: the cache that it uses."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # larger blocks are mapped, and so unmapped when freed
        pa.set_memory_pool(pa.system_memory_pool())
        if release(keep):
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return held
