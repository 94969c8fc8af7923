"""Vectorised words, word hashes and shingle sets of a batch of texts (numpy over Arrow buffers).

A word is a maximal run of bytes outside space and 0x09-0x0D, with A-Z lower-cased. Words
and shingles are known by 64-bit hashes: two different shingles of one comparison
share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text handled at once: bounds the temporary arrays of a task.
STEP_BYTES = 1 << 21

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE = _BYTE[_LOWER]
_BYTE[_SPACE] = 0
_PLACE = mix(np.arange(1, 4097, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)
_GRAM = mix(np.arange(11, 11 + SHINGLE, dtype=_U)) | _U(1)


def _places(n: int) -> np.ndarray:
    return _PLACE if n <= len(_PLACE) else mix(np.arange(1, n + 1, dtype=_U) * _U(0xD1B54A32D192ED03)) | _U(1)


class Words:
    """The words of some texts: ``start``/``end`` byte offsets in ``data``, ``doc`` (row), 64-bit ``hash``."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        n = len(texts)
        _, off, buf = texts.buffers()
        bounds = np.frombuffer(off, np.int32, n + 1, texts.offset * 4).astype(np.int64) if off else np.zeros(n + 1, np.int64)
        if texts.null_count:
            # a null's slot may hold bytes; give it none
            texts = texts.fill_null("")
            _, off, buf = texts.buffers()
            bounds = np.frombuffer(off, np.int32, n + 1, texts.offset * 4).astype(np.int64)
        lo, hi = int(bounds[0]), int(bounds[-1])
        data = np.frombuffer(buf, np.uint8, hi - lo, lo) if buf is not None and hi > lo else np.zeros(0, np.uint8)
        bounds = bounds - lo
        self.n, self.data, self.bounds = n, data, bounds
        word = ~_SPACE[data]
        before = np.empty_like(word)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            inner = bounds[(bounds > 0) & (bounds < len(word))]
            before[inner] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty_like(word)
        if len(word):
            after[-1] = False
            after[:-1] = word[1:]
            after[inner - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        if hashed:
            self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, _U)
        spans = np.diff(np.append(self.start, len(self.data)))
        first = self.start[0]
        place = np.arange(first, len(self.data), dtype=np.int64) - np.repeat(self.start, spans)
        length = (self.end - self.start).astype(_U)
        table = _places(int(length.max()))
        values = _BYTE[self.data[first:]] * table[np.minimum(place, len(table) - 1)]
        return mix(np.add.reduceat(values, self.start - first) + length * _U(0xA24BAED4963EE407))


def steps(texts: pa.Array, most: int = STEP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of ``texts`` with about ``most`` bytes each, with the row each begins at."""
    n = len(texts)
    if not n:
        return
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    off = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    row = 0
    while row < n:
        nxt = int(np.searchsorted(off, off[row] + most, side="right")) - 1
        nxt = min(n, max(nxt, row + 1))
        yield row, texts.slice(row, nxt - row)
        row = nxt


def shingle_sets(texts: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    Fewer words than ``width``: the whole sequence is one shingle. No word (or null): an empty set.
    """
    w = Words(texts)
    h, doc = w.hash, w.doc
    per_doc = np.bincount(doc, minlength=w.n)
    first = np.concatenate(([0], np.cumsum(per_doc)))
    grams = np.zeros(0, _U)
    if len(h) >= width:
        k = len(h) - width + 1
        grams = h[:k] * _GRAM[0]
        for j in range(1, width):
            grams = grams + h[j : j + k] * _GRAM[j]
        grams = mix(grams)
    out = []
    for d in range(w.n):
        m = per_doc[d]
        if m >= width:
            s = np.sort(grams[first[d] : first[d] + m - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif m:
            x = (h[first[d] : first[d + 1]] * _GRAM[:m]).sum(dtype=_U, keepdims=True)
            out.append(mix(x + np.array([m], _U) * _U(0x9FB21C651E98DF25)))
        else:
            out.append(np.zeros(0, _U))
    return out
