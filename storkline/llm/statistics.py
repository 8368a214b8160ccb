"""Counts over whole texts, computed for a chunk of texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from storkline.llm import text

SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123)) | (np.arange(256) >= 0xC0)
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), [ord(c) for c in "!?"])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:"])
_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set between each two bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _owners(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def _tagged(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return text.mix(hashes + text.mix(owners.astype(np.uint64) + np.uint64(1)))


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def repeat_words(words: np.ndarray, bounds: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text the words that stand in a window of `width` words found twice or more in it."""
    windows = text.joined(words, width)
    owners = _owners(bounds)
    inside = np.flatnonzero(owners[:len(windows)] == owners[width - 1:]) if len(windows) else np.zeros(0, np.int64)
    at = inside[_repeated(_tagged(windows[inside], owners[inside]))]
    marked = np.zeros(len(words), bool)
    for i in range(width):
        marked[at + i] = True
    return _per_text(marked, bounds)


def repeat_lines(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its lines that hold a word, and those of them that equal an earlier line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # lines are listed by text: a text of m breaks has m + 1 lines
    counts = _per_text(data == 10, offsets) + 1
    bounds = np.concatenate([[0], np.cumsum(counts)])
    filled = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    at = np.flatnonzero(filled)
    keys = _tagged(text.hashes(data, starts[at], ends[at]), _owners(bounds)[at])
    _, first = np.unique(keys, return_index=True)
    again = np.zeros(len(starts), bool)
    again[at] = True
    again[at[first]] = False
    return _per_text(filled, bounds), _per_text(again, bounds)


def basic(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the fixed quality rules, one entry per text."""
    data, offsets = text.raw(column)
    starts, ends, bounds = text.split(data, offsets, text.SPACE)
    words = text.hashes(data, starts, ends)
    _, again = repeat_lines(data, offsets, starts)
    return {
        "n_words": np.diff(bounds),
        "word_chars": _per_text(_CODE_POINT[data] & ~text.SPACE[data], offsets),
        "n_symbols": _per_text(SYMBOLS[data], offsets),
        "n_dup_lines": again,
        "n_repeat_words": repeat_words(words, bounds),
    }


#: what the quality rules look at; all are shares or logarithms, 0 for an empty text
FEATURES = [
    "log_words", "word_length", "upper", "symbols", "digits", "marks", "stops", "symbol_words", "short_words",
    "distinct_words", "repeat_words", "repeat_lines", "line_words",
]


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics in FEATURES, one entry per text."""
    data, offsets = text.raw(column)
    starts, ends, bounds = text.split(data, offsets, text.SPACE)
    words = text.hashes(text.LOWER[data], starts, ends)
    lines, again = repeat_lines(data, offsets, starts)
    n = np.diff(bounds)
    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(_per_text(_LETTER[data], offsets), 1)
    count = np.maximum(n, 1)
    _, first = np.unique(_tagged(words, _owners(bounds)), return_index=True)
    new = np.zeros(len(words), bool)
    new[first] = True
    points = _per_text(_CODE_POINT[data] & ~text.SPACE[data], offsets)
    return {
        "log_words": np.log1p(n),
        "word_length": points / count,
        "upper": _per_text(_UPPER[data], offsets) / letters,
        "symbols": _per_text(SYMBOLS[data], offsets) / size,
        "digits": _per_text(_DIGIT[data], offsets) / size,
        "marks": _per_text(_MARK[data], offsets) / size,
        "stops": _per_text(_STOP[data], offsets) / size,
        "symbol_words": _per_text(SYMBOLS[data[ends - 1]], bounds) / count,
        "short_words": _per_text(ends - starts <= 2, bounds) / count,
        "distinct_words": _per_text(new, bounds) / count,
        "repeat_words": repeat_words(words, bounds) / count,
        "repeat_lines": again / np.maximum(lines, 1),
        "line_words": n / np.maximum(lines, 1),
    }
