"""Whole-batch text work in numpy over the buffers of an Arrow string column.

Texts are handled as UTF-8 bytes. The word classes in use hold every byte from 0x80 on, or
only drop ASCII bytes, so splitting bytes equals splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
ALNUM = np.ones(256, dtype=bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_BASE, 1 << 16)
_INVERSES = _powers(_BASE_INV, 1 << 16)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """A run of texts: their bytes end to end, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> "Texts":
        return Texts(LOWER[self.data], self.offsets)


def column_texts(column: pa.Array) -> Texts:
    """The bytes of a string column without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if ends is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    first = int(offsets[0])
    return Texts(data[first : int(offsets[-1])], offsets.astype(np.int64) - first)


def chunks(texts: Texts, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text makes a run of its own."""
    lo, n = 0, len(texts)
    while lo < n:
        hi = int(np.searchsorted(texts.offsets, texts.offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        a, b = texts.offsets[lo], texts.offsets[hi]
        yield lo, hi, Texts(texts.data[a:b], texts.offsets[lo : hi + 1] - a)
        lo = hi


def word_spans(texts: Texts, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``texts.data``, and per text the index of its first word."""
    inside = is_word[texts.data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(texts) + 1, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = np.unique(texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))])
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, texts.offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, then mixed.

    Prefix sums over blocks of whole words give all the words of a block at once.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + block, "right")))
        n = int(ends[j - 1] - at)
        up, down = (_POWERS, _INVERSES) if n <= len(_POWERS) else (_powers(_BASE, n), _powers(_BASE_INV, n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[at : at + n]] * up[:n], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


_STEP = mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``k`` words within a text, and per text where its runs begin.

    A text of fewer words, but not none, has its whole sequence as the one run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(int(at[-1]), np.uint64)
    if len(words) >= k:
        n = len(words) - k + 1
        sums = words[:n] * _STEP[0]
        for d in range(1, k):
            sums += words[d : d + n] * _STEP[d]
        full = counts >= k
        take = np.repeat(first[:-1][full] - at[:-1][full], runs[full])
        place = np.flatnonzero(np.repeat(full, runs))
        out[place] = mix(sums[place + take])
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        w = words[first[i] : first[i + 1]]
        out[at[i]] = mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + _STEP[8 + len(w)])[0]
    return out, at
