"""Words of a batch of texts as 64-bit hashes, computed over the bytes of the Arrow column at once.

Used inside Arrow functions by the operators that compare words. A word is a longest run of bytes that are not
ASCII white space, so it never crosses a text and is always valid UTF-8. Two words get the same hash if they are the
same bytes; different words collide with a probability near 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one go; bounds the working memory, whatever the length of a text.
BLOCK = 1 << 20
#: Bytes of text that `slices` hands out at once; a longer text comes alone.
SLICE = 4 << 20
#: The same for operators that make many numbers of a word.
SMALL_SLICE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_POW = _powers(_BASE, BLOCK)
_INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text each, at least one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        low = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, low + most, "right")))
        yield at, to
        at = to


class Words:
    """Words of `texts`: byte range, text and hash of each, in order.

    data    the bytes of all texts
    bounds  where each text starts in data, and the end
    starts, ends, doc   of each word
    """

    def __init__(self, texts: pa.Array, space: np.ndarray = SPACE):
        texts = pc.fill_null(texts, "")
        if len(texts) == 0:
            texts = pa.array([""])
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = whole[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        word = ~space[self.data]
        edge = word.copy()
        edge[1:] &= ~word[:-1]
        first = self.bounds[:-1][self.bounds[:-1] < len(self.data)]
        edge[first] = word[first]
        self.starts = np.flatnonzero(edge)
        edge = word.copy()
        edge[:-1] &= ~word[1:]
        last = self.bounds[1:][self.bounds[1:] > 0] - 1
        edge[last] = word[last]
        self.ends = np.flatnonzero(edge) + 1
        self.doc = np.searchsorted(self.bounds, self.starts, "right") - 1

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of its bytes up to `ends`."""
        ends = self.ends if ends is None else ends
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            low = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, low + BLOCK, "right")))
            size = int(self.ends[to - 1] - low)
            power, inverse = (_POW, _INV) if size <= BLOCK else (_powers(_BASE, size), _INV)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[self.data[low : low + size]] * power[:size], out=sums[1:])
            s, e = self.starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            at = to
        return out

    def counts(self) -> np.ndarray:
        """Number of words of each text."""
        return np.bincount(self.doc, minlength=len(self.bounds) - 1)


def windows(words: Words, hashes: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `n` words within a text, and the index of their first words.

    short: a text of 1 to n - 1 words gets one run of all its words.
    """
    size = len(hashes)
    total = np.zeros(max(0, size - n + 1), np.uint64)
    power = 1
    for j in range(n):
        power = power * int(_ODD) % (1 << 64)
        total += hashes[j : j + len(total)] * np.uint64(power)
    at = np.flatnonzero(words.doc[: len(total)] == words.doc[n - 1 :]) if len(total) else np.zeros(0, np.int64)
    found = mix(total[at])
    if not short or size == 0:
        return found, at
    counts = words.counts()
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    few = np.flatnonzero((counts > 0) & (counts < n))
    extra = np.zeros(len(few), np.uint64)
    for j in range(n - 1):
        have = counts[few] > j
        extra[have] = mix(extra[have] * _ODD + hashes[first[few][have] + j] + np.uint64(j + 1))
    at = np.concatenate([at, first[few]])
    order = np.argsort(at, kind="stable")
    return np.concatenate([found, extra])[order], at[order]
