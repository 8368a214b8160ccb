"""Counts over whole texts against plain Python."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from storkline.llm import statistics, text

TEXTS = [
    None, "", " ", "one", "a b\n\na b\na b \n \n \r\na b", "x" * 5000, "é ü 😀 ## <b> | a é b　c", "a b c a b c d a b c", "\n\n\n",
    "The the THE the the the", "one two\x0bthree\x0cfour\rfive\tsix", "a a a", "a a a a", "x y z\nx y z\nx y",
]


def expected(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    marked = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), again, len(marked)


def test_basic_counts(documents):
    for texts in (TEXTS, [t for _, t in documents], []):
        found = statistics.basic(pa.array(texts, pa.string()))
        got = list(zip(*(found[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True))
        assert got == [expected(t) for t in texts]


def test_features_are_finite():
    found = statistics.features(pa.array(TEXTS, pa.string()))
    assert list(found) == statistics.FEATURES
    assert all(np.isfinite(v).all() and len(v) == len(TEXTS) for v in found.values())
    assert found["distinct_words"][TEXTS.index("The the THE the the the")] == 1 / 6


def test_sliced_batches_give_the_same_texts(documents):
    batch = pa.record_batch({"text": pa.array([t for _, t in documents] + TEXTS, pa.string())})
    parts = list(text.chunks([batch], limit=10_000))
    assert len(parts) > 20 and sum(p.num_rows for p in parts) == batch.num_rows
    whole, bounds = text.word_hashes(batch.column("text"))
    pieces = [text.word_hashes(p.column("text")) for p in parts]
    assert (np.concatenate([h for h, _ in pieces]) == whole).all()
    assert (np.concatenate([np.diff(b) for _, b in pieces]) == np.diff(bounds)).all()


def test_hashes_tell_words_apart(documents):
    words = {w for _, t in documents for w in re.findall(r"[^\x20\x09-\x0D]+", t)}
    hashed, _ = text.word_hashes(pa.array(sorted(words)), lower=False)
    assert len(set(hashed.tolist())) == len(words)


def test_hashes_of_long_texts_in_parts(monkeypatch):
    """Stretches have the same hash whatever part of a text they are hashed with, longer ones included."""
    import numpy as np

    from storkline.llm import text

    pick = np.random.default_rng(1)
    data = pick.integers(0, 256, 40_000, dtype=np.uint8)
    starts = np.sort(pick.integers(0, 39_000, 3000))
    ends = np.minimum(starts + pick.choice([0, 1, 7, 90, 900, 5000], 3000), len(data))
    whole = text.hashes(data, starts, ends)
    mixed = pick.permutation(3000)
    monkeypatch.setattr(text, "CHUNK_BYTES", 1000)
    assert (text.hashes(data, starts, ends) == whole).all()
    assert (text.hashes(data, starts[mixed], ends[mixed]) == whole[mixed]).all()
    assert (text.hashes(data, starts[:0], ends[:0]) == whole[:0]).all()


def test_tables_for_hashing_stay_small(monkeypatch):
    """A worker keeps them between tasks; words have the hashes that they have in one run over all bytes."""
    monkeypatch.setattr(text, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    column = pa.array([" ".join(f"w{i * j % 9973}" for i in range(20_000)) for j in range(1, 17)])
    hashed, bounds = text.word_hashes(column)
    assert bounds[-1] == 320_000 and sum(table.nbytes for table in text._powers) < 5 << 20
    data, offsets = text.raw(column)
    assert len(data) > 3 * text.HASHED_BYTES
    assert (hashed == text._hashes(data, *text.split(data, offsets, text.SPACE)[:2])).all()


def test_hashes_in_parts_of_any_size(monkeypatch):
    pick = np.random.default_rng(2)
    data = pick.integers(0, 256, 40_000, dtype=np.uint8)
    starts = np.sort(pick.integers(0, 39_000, 3000))
    ends = np.minimum(starts + pick.choice([0, 1, 7, 90, 900, 5000], 3000), len(data))
    whole = text.hashes(data, starts, ends)
    monkeypatch.setattr(text, "HASHED_BYTES", 1000)
    assert (text.hashes(data, starts, ends) == whole).all()


def test_what_a_worker_keeps_goes_with_another_stage(monkeypatch):
    monkeypatch.setattr(text, "_kept", {})
    batch = pa.record_batch({"text": ["a b"]})
    first = text.kept("words", dict)
    assert list(text.chunks([batch], keep="words")) == [batch] and text.kept("words", dict) is first
    assert list(text.chunks([batch])) == [batch] and not text._kept
