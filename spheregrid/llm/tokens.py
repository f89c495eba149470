"""Vectorised word hashing over whole Arrow string batches.

A batch of texts is one byte buffer; words, their 64-bit hashes and the
hashes of their prefixes come from prefix sums over that buffer, so there is
no Python loop over words.  Hashes are 64-bit: two different words or
shingles share one with probability of about n^2 / 2^65 for n distinct ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash (2^64 / golden ratio).
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hash that stands for the end of a text.
END_HASH = np.int64(0x454E44)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random-looking 64-bit value for each byte, A-Z as a-z.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_BYTE[65:91] = _BYTE[97:123]

#: ASCII white space: a space and 0x09 to 0x0D.
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence.
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0..BASE^n-1 and their inverses, modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", int(BASE)), ("down", _inverse(int(BASE)))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: ``start``/``end`` byte positions, ``doc`` row numbers, ``first`` word of each row."""

    def __init__(self, texts: pa.Array, alnum: bool = False):
        self.bytes, self.offsets = text_bytes(texts)
        n = len(self.bytes)
        inside = (_ALNUM if alnum else _WORD)[self.bytes]
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            # A word ends with its text even if the next text starts at once.
            edges = self.offsets[1:-1]
            edges = edges[edges < n]
            begins[edges] = inside[edges]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:]
            edges = edges[edges > 0] - 1
            ends[edges] = inside[edges]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self._sums: np.ndarray | None = None

    def _roll(self) -> None:
        up, _ = _powers(len(self.bytes) + 1)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        self._sums = sums

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges, A-Z read as a-z."""
        if self._sums is None:
            self._roll()
        _, down = _powers(len(self.bytes) + 1)
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def prefixes(self, length: int) -> np.ndarray:
        """Hashes of the first ``length`` bytes of each word (of the whole word if it is shorter, mixed apart)."""
        end = np.minimum(self.start + length, self.end)
        return mix(self.hash_of(self.start, end) + np.uint64(length))


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``width``-word shingle hashes of each text, ascending, one after the other, and each text's offsets.

    A text with fewer words has its whole word sequence as its one shingle;
    a text without words (or a null) has none.
    """
    words = Words(texts)
    return weighed_sets(words, words.hashes(), None, width)[:2]


def weighed_sets(words: Words, h: np.ndarray, weight: np.ndarray | None, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``shingle_sets`` of words with hashes ``h``, and of each shingle the sum of its words' whole-number ``weight`` (0 for a text of fewer words)."""
    counts = words.counts
    n = len(h)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    value = h * factor[0]
    for k in range(1, min(width, n)):
        value[: n - k] += h[k:] * factor[k]
    left = np.repeat(words.first[1:], counts) - np.arange(n)  # words up to the end of the text, this one included
    keep = left >= width
    short = words.first[:-1][(counts > 0) & (counts < width)]
    for at in short.tolist():
        value[at] = (h[at : at + left[at]] * factor[: left[at]]).sum() + np.uint64(left[at])
    value = mix(value)
    if weight is not None:
        whole = weight.copy()
        for k in range(1, min(width, n)):
            whole[: n - k] += weight[k:]
        whole[short] = 0
    keep[short] = True
    value, doc = value[keep].view(np.int64), words.doc[keep]
    sizes = np.bincount(doc, minlength=len(counts)) if len(doc) else np.zeros(len(counts), np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parts, sums, offsets = [], [], np.zeros(len(counts) + 1, np.int64)
    if weight is not None:
        whole = whole[keep]
    for i in range(len(counts)):
        own = slice(bounds[i], bounds[i + 1])
        if weight is None:
            parts.append(np.unique(value[own]))
        else:
            one, at = np.unique(value[own], return_index=True)
            parts.append(one)
            sums.append(whole[own][at])
        offsets[i + 1] = offsets[i] + len(parts[-1])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(parts), offsets, None if weight is None else joined(sums)
