"""Words and word hashes of whole texts, as array work over UTF-8 bytes.

A word is a run of characters other than space and \\t..\\r. These are single bytes in UTF-8, so
words can be found in the bytes of a text. Hashes have 64 bits; equal words or word
sequences always hash alike, and two different ones of a collection of n collide with a chance of
about n * n / 2**65.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def give_back_memory(threshold: int = 1 << 20, top: int = 1 << 17) -> None:
    """Have the C library return arrays of ``threshold`` bytes or more to the system as soon as they are freed, and of the others what lies free above ``top`` bytes.

    Left alone it keeps them for the next ones, and a worker that lives through many stages stays as large as the largest of them. Work that makes
    many arrays in a row is faster with what it has freed; it asks for more to be kept, and trims and calls this again when it is done.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, threshold)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, top)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def trim() -> None:
    """Have the C library return what lies free between smaller allocations too; workers wait between stages with what they keep."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


give_back_memory()
SPACES = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint8)
_GAP = np.isin(np.arange(256), SPACES)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2**64, kept between calls and grown by an eighth more than needed."""
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) <= n:
        size = max(1 << 16, n + n // 8)
        _POWERS[key] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, base, dtype=np.uint64)]), dtype=np.uint64)
    return _POWERS[key][: n + 1]


SLICE = 1 << 20


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow column, about ``limit`` bytes at a time (a longer text comes alone).

    Gives the row of the first text, the bytes of the texts with one space after each, and where each
    text starts (one entry more than texts). Null is an empty text.
    """
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    size = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], dtype=size)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        starts = ends[row : stop + 1] - ends[row]
        yield row, np.insert(data[ends[row] : ends[stop]], starts[1:], np.uint8(32)), starts + np.arange(len(starts))
        row = stop
    trim()


def spans(data: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~gap[data]
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * _powers(_BASE, len(data))[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[last] - sums[first]) * _powers(_INVERSE, len(data))[first] + (last - first).astype(np.uint64))


def slice_words(data: np.ndarray, starts: np.ndarray, lower: bool = True, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first byte, end and hash of every word of a slice; A-Z count as a-z if ``lower``."""
    if lower:
        data = _LOWER[data]
    first, last = spans(data, gap)
    return np.searchsorted(starts, first, "right") - 1, first, last, span_hashes(data, first, last)


def word_hashes(text: str | None, lower: bool = True, gap: np.ndarray = _GAP) -> np.ndarray:
    """Hash of every word of one text, in order."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return slice_words(data, np.array([0, len(data)]), lower, gap)[3]


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; of the whole sequence where there are fewer, of nothing where there are none."""
    if not len(words):
        return words
    n_here, total = min(n, len(words)), np.uint64(min(n, len(words)))
    count = len(words) - n_here + 1
    total = np.full(count, total, dtype=np.uint64)
    for k in range(n_here):
        total = total * _BASE + words[k : k + count]
    return mixed(total)


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs of a text."""
    return np.unique(sequence_hashes(word_hashes(text), n))


def slice_sequences(text: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word number where it starts and hash of every run of ``n`` words that stays inside one text."""
    count = max(0, len(words) - n + 1)
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total = total * _BASE + words[k : k + count]
    inside = np.flatnonzero(text[:count] == text[n - 1 :]) if count else np.empty(0, dtype=np.int64)
    return inside, mixed(total[inside])


def slice_shingles(text: np.ndarray, words: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, hash) of the ``n``-word runs; a shorter text is one run, an empty one has none."""
    at, hashes = slice_sequences(text, words, n)
    owner = text[at]
    counts = np.bincount(text, minlength=texts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        first = np.searchsorted(text, short)
        own = [sequence_hashes(words[a : a + c], n)[0] for a, c in zip(first, counts[short])]
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, np.array(own, dtype=np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]
