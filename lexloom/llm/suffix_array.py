"""Two-stage suffix sorting to a fixed depth, and adjacent common prefixes."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position, as big-endian numbers; zeros follow the end."""
    out = np.concatenate([text, np.zeros(63, np.uint8)]).astype(_U)
    for k in (1, 2, 4):  # of 2 k bytes, from two of k
        out = out[:-k] << _U(8 * k) | out[k:]
    return out


def _chunks(depth: int) -> list[int]:
    """Offsets of 8-byte chunks that cover ``depth`` bytes (8 or more) and none beyond."""
    return [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """The wanted positions by their suffixes' first ``depth`` bytes.

    Only suffixes whose first byte is not above the second, which are smaller than their successor
    or begin with equal bytes, are sorted directly. The others begin with a byte above their
    successor's first, so scanning the buckets of first bytes upwards meets their successors in
    order and appends them to their own buckets: in each bucket the induced suffixes come first.
    """
    n = len(text)
    following = np.append(text[1:], 255)
    induced = text > following
    needed = np.zeros(n + 1, bool)
    needed[wanted] = True
    chain = wanted
    while len(chain):  # successors of the induced, down to one that is sorted directly
        chain = chain[induced[chain]] + 1
        chain = chain[~needed[chain]]
        needed[chain] = True
    at = np.flatnonzero(needed[:n])
    direct = at[~induced[at]]
    direct = direct[np.lexsort([words[direct + d] for d in reversed(_chunks(depth))])]
    heads = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for c in range(256):
        bucket = np.concatenate([*waiting[c], direct[heads[c] : heads[c + 1]]])
        waiting[c] = []
        if not len(bucket):
            continue
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before]]
        first = text[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            by_byte = np.argsort(first, kind="stable")
            cuts = np.searchsorted(first[by_byte], np.arange(c + 1, 257))
            for k in np.flatnonzero(np.diff(cuts)):
                waiting[c + 1 + k].append(before[by_byte[cuts[k] : cuts[k + 1]]])
    out = np.concatenate(order) if order else np.zeros(0, np.int64)
    mine = np.zeros(n, bool)
    mine[wanted] = True
    return out[mine[out]]


def adjacent_prefixes(order: np.ndarray, depth: int, words: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``depth`` bytes."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    a, b = order[:-1], order[1:]
    live = np.arange(len(a))
    for d in _chunks(depth):
        differ = words[a[live] + d] ^ words[b[live] + d]
        ends = differ != 0
        zeros = np.zeros(int(ends.sum()), np.int64)
        rest = differ[ends]
        for shift in (32, 16, 8):
            high = rest >> _U(64 - shift) == 0
            zeros += np.where(high, shift // 8, 0)
            rest = np.where(high, rest << _U(shift), rest)
        out[live[ends] + 1] = d + zeros
        live = live[~ends]
    out[live + 1] = depth
    return out
