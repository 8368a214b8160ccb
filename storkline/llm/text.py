"""Words, lines and shingles of whole texts as numpy arrays, for use inside Arrow tasks.

Texts are the UTF-8 bytes of an Arrow column, so a byte costs a few vector operations and no Python
object is made for a word. A word is known by a 64-bit hash of its bytes: a polynomial over random
byte values, computed for all words of a chunk from one running sum, then mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
#: bytes whose words are hashed at once; the tables that a worker keeps for it take 16 times as much
HASHED_BYTES = 256 << 10
_STEP = 0x9E3779B97F4A7C15
_RATIO = 0xD1342543DE82EF95
_RATIO_INVERSE = pow(_RATIO, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_PLACES = mix(np.arange(1001, 1065, dtype=np.uint64) * np.uint64(_STEP)) | np.uint64(1)

#: bytes between words: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: every ASCII byte but letters and digits
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Give memory that no array uses any more back to the system; a worker goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_kept: dict[str, Any] = {}


def kept(key: str, make: Callable[[], Any]) -> Any:
    """What this worker keeps under a key for its next task; it goes with the first task that does not name the key."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def rows_of(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows one by one, so that only one stands in memory as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the ratio and of its inverse, kept for the next words."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_RATIO, _RATIO_INVERSE)):
            table = np.full(max(n, HASHED_BYTES), base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table)
    return _powers


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `limit` bytes of text each; a longer text is a chunk of its own. Of what
    the worker kept from earlier tasks only that under the key `keep` stays."""
    for key in _kept.keys() - {keep}:
        del _kept[key]
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    let_go()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array and the n + 1 offsets of its texts; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def split(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside `gap`, and for each text where its runs
    begin among them (n + 1 bounds). No run crosses texts."""
    inside = ~gap[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def _long_hash(data: np.ndarray) -> np.ndarray:
    """The hash of one stretch, summed up over parts of it."""
    power, _ = _power_tables(HASHED_BYTES)
    total = 0
    for at in range(0, len(data), HASHED_BYTES):
        part = data[at:at + HASHED_BYTES]
        total += int((_BYTE_VALUES[part] * power[:len(part)]).sum(dtype=np.uint64)) * pow(_RATIO, at, 1 << 64)
    return mix(np.array([total % (1 << 64)], np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes; equal stretches have equal hashes wherever they stand. Of
    more than HASHED_BYTES, ascending stretches are taken in groups that span no more than that."""
    if len(data) <= HASHED_BYTES or len(starts) == 0 or (starts[1:] < starts[:-1]).any():
        return _hashes(data, starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    far = np.maximum.accumulate(ends)
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(far, base + HASHED_BYTES, "right"))
        if j > i:
            out[i:j] = _hashes(data[base:base + HASHED_BYTES], starts[i:j] - base, ends[i:j] - base)
        else:
            j = i + 1
            out[i:j] = _long_hash(data[base:ends[i]])
        i = j
    return out


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` consecutive entries, whatever text they belong to."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += words[i:i + n] * _PLACES[i]
    return mix(total)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted as signed 64-bit numbers. A text of fewer words is
    one shingle, a text without words none."""
    every = joined(words, width)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = every[a:b - width + 1] if b - a >= width else joined(words[a:b], int(b - a)) if b > a else every[:0]
        yield np.unique(own.view(np.int64))


def word_hashes(column: pa.Array, lower: bool = True, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and the n + 1 bounds of each text's words."""
    data, offsets = raw(column)
    if lower:
        data = LOWER[data]
    starts, ends, bounds = split(data, offsets, gap)
    return hashes(data, starts, ends), bounds
