"""Vectorised word splitting and hashing over Arrow string arrays.

The operators on words and shingles work inside ``mapInArrow`` tasks. Here a
slice of documents becomes numpy arrays: where each word begins and ends, the
first word of each document, and a 64-bit hash of each word and of each run of
consecutive words. All hashes are polynomials modulo 2**64 over random byte
values, finished by a bit mixer; 64 (or twice 64) bits stand for the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MARK = _SEPARATOR.copy()
_MARK[[b for b in range(128) if not chr(b).isalnum()]] = True
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[_SEPARATOR] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all bits (splitmix64's last steps)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    """Words of some documents: document i has words first[i] to first[i + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    def runs(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the word sequences that begin at these words."""
        _, down = _WORDS.get(len(self.hashes) + 1)
        return mix((self.sums[begin + length] - self.sums[begin]) * down[begin] + np.asarray(length).astype(np.uint64) * _U(0x632BE59BD9B4E019))

    def text(self, begin: int, end: int) -> bytes:
        """The bytes from word begin to word end - 1, separators as they stand."""
        return self.data[self.starts[begin] : self.ends[end - 1]].tobytes() if end > begin else b""


def split(texts: pa.Array, lower: bool = False, marks: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; a null text has none. lower: A-Z become a-z. marks: ASCII marks separate words, too."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _FOLD[data]
    n = len(data)
    gap = (_MARK if marks else _SEPARATOR)[data]
    before, after = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    up, down = _BYTES.get(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((np.where(gap, _U(0), _BYTE[data]) if marks else _BYTE[data]) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    up, _ = _WORDS.get(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=run[1:])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes, run)


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of so many words, from the words' hashes."""
    up, down = _WORDS.get(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    n = max(0, len(words) - length + 1)
    return mix((sums[length : length + n] - sums[:n]) * down[:n] + _U(length) * _U(0x632BE59BD9B4E019))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``most`` bytes each, a longer document alone."""
    wide = texts.cast(pa.large_string())
    ends = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, min(to, len(texts))
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)
