"""Words and their hashes for a batch of texts at once, with numpy over the UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are worked on in slices of about so many bytes, whatever the Arrow batch; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply): every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_SEED = [U(0x2545F4914F6CDD1D), U(0x8CB92BA72F3D8DD7)]
_ODD = [U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)]
#: Longer words (in bytes) are hashed one by one with BLAKE2.
LONG_WORD = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


class Words:
    """``start``, ``end`` (byte offsets in ``data``), ``doc`` (index of the text) and ``first`` (first word of each text, one more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        self.n_docs = len(texts)
        texts = pa.array(texts, pa.large_string()) if texts.type != pa.large_string() else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + self.n_docs + 1] if self.n_docs else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
        padded = np.zeros(hi - lo + 8, np.uint8)
        padded[:-8] = _LOWER[data] if lower else data
        self.data, self.eights = padded[:-8], np.ndarray((hi - lo + 1,), "<u8", padded, strides=(1,))
        self.offsets = offsets - lo
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        space = _SPACE[data]
        before = np.concatenate([[True], space[:-1]]) if n else np.zeros(0, bool)
        after = np.concatenate([space[1:], [True]]) if n else np.zeros(0, bool)
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; those of the two lanes are independent.

        Eight bytes at a time go through a bijective mixer, so words of at most eight
        bytes and one length never collide, and no sum or polynomial cancels in others.
        """
        size = self.end - self.start
        h = mix(size.astype(U) + _SEED[lane])
        live, k = np.flatnonzero(size <= LONG_WORD), 0
        while len(live):
            left = size[live] - k
            h[live] = mix((h[live] ^ (self.eights[self.start[live] + k] & _MASK[np.minimum(left, 8)])) * _ODD[lane] + U(k))
            live, k = live[left > 8], k + 8
        for i in np.flatnonzero(size > LONG_WORD):
            word = self.data[self.start[i] : self.end[i]].tobytes()
            h[i] = int.from_bytes(blake2b(word, digest_size=8, salt=bytes([lane])).digest(), "little")
        return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two."""
    return mix(a * U(0xC2B2AE3D27D4EB4F) + mix(b + U(0x165667B19E3779F9)))


def shingles(words: Words, width: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of ``width`` words; of a shorter text's whole sequence, if it has words."""
    n = len(h)
    out, ok = h.copy(), np.ones(n, bool)
    for k in range(1, width):
        nxt = np.concatenate([h[k:], np.zeros(min(k, n), U)])
        inside = np.arange(n) + k < words.first[words.doc + 1]
        out = np.where(inside, combine(out, nxt), out)
        ok &= inside
    short = (words.count < width)[words.doc] & (np.arange(n) == words.first[words.doc])
    keep = ok | short
    return out[keep], words.doc[keep]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has about ``limit`` bytes of text (one text at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
