"""Vectorised word and shingle hashing over Arrow string buffers.

All functions work on the concatenated UTF-8 bytes of a slice of a batch, so
their cost is a few numpy passes per byte and independent of the number of
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_ROLL = _RNG.integers(1, 2**63, 8, dtype=U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}

#: Bytes of a slice; a longer single document makes a slice of its own.
SLICE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def slices(column: pa.Array, size: int = SLICE, rows: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets): documents first..last-1, ``rows`` at most; a null text has no bytes."""
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n, at + rows if rows else n)
        own = offsets[at : to + 1]
        yield at, to, data[own[0] : own[-1]], own - own[0]
        at = to


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the maximal runs of word bytes, and the index of each document's first word (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    if len(data) > SLICE and len(offsets) == 2:
        return _long(data, is_word, lower)
    if lower:
        data = _LOWER[data]
    inside = is_word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1]
    first = first[first < len(data)]
    start[first] = inside[first]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    up, down = _powers(len(data))
    value = _VALUE[data]
    value *= up[: len(data)]
    value[~inside] = 0
    hashes = mix(np.add.reduceat(value, at) * down[at])
    return hashes, np.searchsorted(at, offsets)


def _long(data: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of one document longer than a slice: piece by piece, cut between words, so that memory stays that of a slice and the hashes."""
    parts, at = [], 0
    while at < len(data):
        to = at + SLICE // 2
        while to < len(data):  # a word that is longer than a piece stays whole
            gaps = np.flatnonzero(~is_word[data[to : to + 4096]])
            if len(gaps):
                to += int(gaps[0])
                break
            to += 4096
        to = min(to, len(data))
        if to - at <= SLICE:
            parts.append(word_hashes(data[at:to], np.array([0, to - at]), is_word, lower)[0])
        else:
            value = _VALUE[_LOWER[data[at:to]] if lower else data[at:to]]
            parts.append(_giant(value, is_word[data[at:to]]))
        at = to
    hashes = np.concatenate(parts)
    return hashes, np.array([0, len(hashes)])


def _giant(value: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of the words of a piece that holds a word longer than a slice; the powers are made for it and go with it."""
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    stop = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    out = []
    up, _ = _powers(SLICE)
    for a, b in zip(start.tolist(), stop.tolist(), strict=True):
        h, power = 0, 1
        for low in range(a, b, SLICE):
            part = value[low : min(low + SLICE, b)]
            h += int((part * up[: len(part)]).sum(dtype=U)) * power
            power = power * pow(int(_BASE), SLICE, 2**64) % 2**64
        out.append(h % 2**64)
    out = np.array(out, U)
    return mix(out)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's k-word runs and the bounds of its part.

    A document with fewer than k words (but at least one) has one: its whole sequence.
    """
    n = len(words)
    count = np.diff(bounds)
    part = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_bounds = np.concatenate(([0], np.cumsum(part)))
    if n >= k:
        full = words[: n - k + 1] * _ROLL[0]
        for j in range(1, k):
            full = full + words[j : n - k + 1 + j] * _ROLL[j]
    else:
        full = np.zeros(0, U)
    out = np.zeros(out_bounds[-1], U)
    long_ = count >= k
    if long_.any():
        lengths = part[long_]
        total = int(lengths.sum())
        shift = np.repeat(bounds[:-1][long_] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        source = np.arange(total) + shift
        where = np.arange(total) + np.repeat(out_bounds[:-1][long_] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        out[where] = mix(full[source])
    for d in np.flatnonzero((count > 0) & ~long_):
        own = words[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = mix(np.array([(own * _ROLL[: len(own)]).sum() + U(len(own))], U))[0]
    return out, out_bounds


def white_space_split() -> np.ndarray:
    """Word bytes: all but x20 and x09 to x0D."""
    table = np.ones(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Word bytes: ASCII letters and digits, and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table
