"""Vectorised hashes of the words in an Arrow batch of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _trim = ctypes.CDLL(None).malloc_trim  # GNU's C library
except (AttributeError, OSError):
    _trim = None
_U = np.uint64
#: Bytes hashed at once; bounds the working arrays whatever the length of a text.
CHUNK = 1 << 20
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[SPACES] = 0
_PLACES = 4096
_PLACE = _rng.integers(1, 2**63, _PLACES, dtype=np.uint64) * _U(2) + _U(1)
_STEPS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool and the C library keep what the largest batch needed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker, which other tasks use again, holds no more than before."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def raw_texts(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch, and where each text starts and ends; null is empty."""
    text = text.fill_null("").cast(pa.large_string())
    n = len(text)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts or bytes into (start, end) of at most ``most`` bytes each; a longer one stands alone."""
    ends = np.append(0, np.cumsum(pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, side="right")) - 1)
        yield a, b
        a = b


def word_starts(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin: bytes other than ASCII white space after white space or a text's start."""
    inside = ~SPACES[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    begins[first] = inside[first]
    return np.flatnonzero(begins)


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word; a word's white space behind it adds nothing."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK)))
        end = int(starts[b]) if b < len(starts) else len(raw)
        own = starts[a:b]
        place = np.arange(own[0], end) - np.repeat(own, np.diff(np.append(own, end)))
        values = _BYTE[raw[own[0] : end]] * _PLACE[place % _PLACES]
        if len(place) and place.max() >= _PLACES:
            values *= (place // _PLACES).astype(np.uint64) * _U(2) + _U(1)
        out[a:b] = np.add.reduceat(values, own - own[0])
        a = b
    return mix64(out)


def texts_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch, and the bounds of each text's words among them."""
    raw, bounds = raw_texts(text)
    if lower:
        raw = LOWER[raw]
    starts = word_starts(raw, bounds)
    return word_hashes(raw, starts), np.searchsorted(starts, bounds)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of ``k`` words in a row; of all words where there are fewer."""
    n = len(words)
    if not n:
        return words
    if n < k:
        return mix64((words * _STEPS[:n]).sum(keepdims=True) + _U(n))
    total = words[: n - k + 1] * _STEPS[0]
    for i in range(1, k):
        total = total + words[i : n - k + 1 + i] * _STEPS[i]
    return np.unique(mix64(total + _U(k)))
