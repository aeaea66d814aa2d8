"""Whole Arrow batches of texts as numpy arrays: words, lines and their 64-bit hashes.

Texts are worked on as UTF-8 bytes, in parts of a few MB, so that the tables of a task stay small whatever the length of
a text (a single word or line that is longer is a part of its own)."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PART_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64, cache: dict = {}) -> np.ndarray:  # noqa: B006  powers are kept for the next part
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, PART_BYTES), base, np.uint64)
        have[0] = 1
        cache[base] = have = np.multiply.accumulate(have)
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without separators; the third array has the first run of each text, and their number."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, lengths: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of data[start:end], and of the first bytes of each, as many as lengths says (the whole where it is shorter).
    The spans follow one another."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(lengths))]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART_BYTES, "right")))
        a = starts[i]
        piece = data[a : ends[j - 1]]
        piece = LOWER[piece] if lower else piece
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * _powers(len(piece), _P), out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        back = _powers(len(piece) + 1, _P_INVERSE)[s]
        for k, length in enumerate((None, *lengths)):
            stop = e if length is None else np.minimum(e, s + length)
            out[k][i:j] = mix((total[stop] - total[s]) * back + (stop - s).astype(np.uint64))
        i = j
    return out


def sequence_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs h[first:last], which depend on the order within."""
    n = len(h)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(n, _P))])
        return mix((total[last] - total[first]) * _powers(n + 1, _P_INVERSE)[first] + (last - first).astype(np.uint64))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word [^\\x20\\x09-\\x0D]+ and the offset of each text's first word. lower: A-Z count as a-z."""
    data, offsets = utf8(texts)
    starts, ends, first = spans(data, offsets, SPACE)
    return prefix_hashes(data, starts, ends, lower)[0], first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k consecutive words, sorted; of the whole sequence if there are fewer words, none if there is none."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = mix(out * np.uint64(0x100000001B3) + words[i : len(words) - k + 1 + i])
    return np.unique(mix(out + np.uint64(k)))


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of a text column; a longer text is a slice of its own."""
    _, offsets = utf8(batch.column(column)) if batch.num_rows else (None, np.zeros(1, np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system: Spark's Python workers outlive their tasks, and what they keep is
    missing in the steps that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task, which gives back its memory after the last one."""
    try:
        yield from batches
    finally:
        give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as a table, out of batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        at = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(at, at[1:]):
            key = tuple(c[a].as_py() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
