"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Both word classes used here are decided by single bytes: every byte of a non-ASCII code point is 0x80 or more, so a
byte table gives exactly the code-point classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: [^\x20\x09-\x0D]
NOT_SPACE = ~SPACES
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: The lowest 0..8 bytes of a value.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base & _MASK, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of the texts in data, one more than texts
    starts: np.ndarray  # of the words in data
    ends: np.ndarray
    doc: np.ndarray  # text of each word
    first: np.ndarray  # first word of each text, one more than texts

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word: eight bytes at a time, each eight mixed into what those before gave.

        No two words of up to eight bytes are alike; words of more than 64 bytes are hashed by XXH3.
        """
        size = self.ends - self.starts
        h = mixed(size.astype(np.uint64) + np.uint64((seed * _BASE + 1) & _MASK))
        long = np.flatnonzero(size > 64)
        at = np.flatnonzero(size <= 64) if len(long) else np.arange(len(size))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # of the bytes from each place on
        for step in range(0, 64, 8):
            if not len(at):
                break
            left = np.minimum(size[at] - step, 8)
            part = eight[self.starts[at] + step] & (_MASKS[left])
            h[at] = mixed((h[at] ^ part) + np.uint64(_BASE))
            at = at[size[at] > step + 8]
        data = memoryview(self.data)
        for i in long.tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[self.starts[i] : self.ends[i]], seed)
        return h

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, offsets = raw(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = kind[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | fresh[1:])) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, offsets, starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about `most` bytes of text, so that working memory follows the longest text."""
    _, offsets = raw(batch.column(column))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
