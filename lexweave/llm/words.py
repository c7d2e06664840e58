"""Words of a whole Arrow string column as 64-bit hashes, in numpy.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII, in lower case (one code point for one, so positions stay). The same in
Python: ``re.findall(r"[0-9a-z\\x80-\\U0010ffff]+", lower(text))``.

Texts are worked on in pieces of about a megabyte that end between words, so
that memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
_POWERS: list[np.ndarray] = []


class Piece(NamedTuple):
    """Words of some texts. doc: the text's place in the batch; start, end: bytes of the lowered column."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Column(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64 bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(seed: int) -> np.uint64:
    """A constant of 64 bits for a small number."""
    return mix(np.array([(seed + 1) * 0x9E3779B97F4A7C15 & _M], np.uint64))[0]


def release() -> None:
    """Gives memory that this worker no longer uses back to the system; workers live on from task to task."""
    # Imported here, as functions travel with their modules' globals, and a C library can't.
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:  # one giant word: not kept
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def column(texts: pa.Array, lower: bool = True) -> Column:
    """Bytes and offsets of the texts in lower case; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return Column(np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets)


def pieces(col: Column, size: int = PIECE) -> Iterator[Piece]:
    """All words of all texts, in order."""
    data, offsets = col
    at, total = int(offsets[0]), int(offsets[-1])
    while at < total:
        to = min(at + size, total)
        if to < total:
            to = _cut(data, offsets, at, to, total)
        yield _words(data, offsets, at, to)
        at = to


def _cut(data: np.ndarray, offsets: np.ndarray, at: int, to: int, total: int) -> int:
    """The last place in (at, to] between two words, or else the first beyond it."""
    k = int(offsets[np.searchsorted(offsets, to, side="right") - 1])
    gaps = np.flatnonzero(~_IS_WORD[data[max(at, k) : to]])
    best = max(at, k) + int(gaps[-1]) + 1 if len(gaps) else k
    if best > at:
        return best
    end = int(offsets[np.searchsorted(offsets, to, side="left")])
    for x in range(to, end, PIECE):
        gaps = np.flatnonzero(~_IS_WORD[data[x : min(x + PIECE, end)]])
        if len(gaps):
            return x + int(gaps[0]) + 1
    return min(end, total)


def _words(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> Piece:
    part = data[at:to]
    n = to - at
    is_word = _IS_WORD[part]
    first, last = is_word.copy(), is_word.copy()
    first[1:] &= ~is_word[:-1]
    last[:-1] &= ~is_word[1:]
    bounds = offsets[np.searchsorted(offsets, at, side="left") : np.searchsorted(offsets, to, side="left")] - at
    bounds = bounds[bounds < n]
    first[bounds] = is_word[bounds]
    before = bounds[bounds > 0] - 1
    last[before] = is_word[before]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s])
    doc = np.searchsorted(offsets, s + at, side="right") - 1
    return Piece(doc, h, s + at, e + at)


def word_hash(word: str) -> int:
    """The hash that pieces() gives a single word."""
    got = list(pieces(column(pa.array([word]))))
    if len(got) != 1 or len(got[0].hash) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(got[0].hash[0])


def member(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted array, and whether it is there."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    k = np.searchsorted(among, values)
    k[k == len(among)] = 0
    return k, among[k] == values


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, hash) in order of doc, with their counts. Pairs are told apart by 64 mixed bits."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    key = mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(new, len(key)))
    at = order[new]
    by_doc = np.argsort(doc[at], kind="stable")
    return doc[at][by_doc], h[at][by_doc], counts[by_doc]


class Batch(NamedTuple):
    """Some rows of a column with all their words. first: the batch's place of row 0; rows: how many."""

    first: int
    rows: int
    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    col: Column


def batches(texts: pa.Array | pa.ChunkedArray, size: int = 2 * PIECE, lower: bool = True) -> Iterator[Batch]:
    """The texts some megabytes at a time, never less than a whole text; doc counts from the batch's first row."""
    if isinstance(texts, pa.ChunkedArray):
        chunks = texts.cast(pa.large_string()).chunks
        texts = pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        col = column(texts.slice(at, to - at), lower)
        got = list(pieces(col))
        doc, h, s, e = (np.concatenate([p[i] for p in got]) if got else np.zeros(0, t) for i, t in enumerate((np.int64, np.uint64, np.int64, np.int64)))
        yield Batch(at, to - at, doc, h, s, e, col)
        del got, doc, h, s, e, col
        at = to
    release()


def shingles(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every n words in a row of one text."""
    if len(h) < n:
        return doc[:0], h[:0]
    got = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        got = mix(got * np.uint64(_BASE) + h[i : len(h) - n + 1 + i])
    same = doc[: len(h) - n + 1] == doc[n - 1 :]
    return doc[: len(h) - n + 1][same], got[same]
