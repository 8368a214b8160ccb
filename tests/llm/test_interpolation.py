"""The interpolated model against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from storkline.llm import interpolation
from storkline.llm.interpolation import PER_OCTAVE, learn_weights, score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = None


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), END]


def fold(i):
    return zlib.crc32(str(i).encode()) % 7 if i is not None else 2


def counts(rows, folds):
    one, two = Counter(), Counter()
    for i, t in rows:
        if fold(i) in folds:
            w = tokens(t)
            one.update(w)
            two.update(zip([END, *w], w, strict=False))
    return one, two


def plainly(rows):
    """doc_id: (tokens, known, base score, score), with the weights learned as the model does."""
    one, two = counts(rows, {0, 1, 3, 4, 5})
    kept, kinds = sum(one.values()), len(one)
    cell = lambda p: 2.0 ** (-round(-math.log2(p) * PER_OCTAVE) / PER_OCTAVE) if p else 0.0
    bucket = lambda c: math.ceil(math.log2(c + 1))
    events = Counter()
    for i, t in rows:
        if fold(i) == 6:
            w = tokens(t)
            for v, x in zip([END, *w], w, strict=False):
                events[bucket(one[v]), cell(two[v, x] / max(one[v], 1)), cell(one[x] / kept if kept else 0)] += 1
    keys = list(events)
    weights = learn_weights(
        np.array([k[0] for k in keys], dtype=int), np.array([(k[1], k[2], 1 / (kinds + 1)) for k in keys]).reshape(-1, 3), np.array([events[k] for k in keys])
    )
    one, two = counts(rows, {0, 1, 3, 4, 5, 6})
    total, kinds = sum(one.values()), len(one)
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((one[x] + 1) / (total + kinds + 1)) for x in w)
        own = 0.0
        for v, x in zip([END, *w], w, strict=False):
            a, b, c = weights[bucket(one[v])]
            p = a * two[v, x] / max(one[v], 1) + b * one[x] / max(total, 1) + c / (kinds + 1)
            own += math.log10(p / (1 if one[v] else b + c))
        yield (i, len(w), sum(one[x] > 0 for x in w), pytest.approx(base, rel=1e-9), pytest.approx(own, rel=1e-6), total)


def found(docs):
    return [(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in docs.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("block_bytes", [interpolation.BLOCK_BYTES, 20_000])
def test_by_definition(spark, documents, monkeypatch, block_bytes):
    monkeypatch.setattr(interpolation, "BLOCK_BYTES", block_bytes)
    rows = documents[:300]
    out = score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert by_id(found(out)) == by_id(plainly(rows))
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in out.collect())


def test_better_than_the_base_on_held_out_texts(spark):
    out = score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_weights_raise_the_likelihood():
    pick = np.random.default_rng(3)
    p, n, b = pick.random((200, 3)) ** 3, pick.integers(1, 9, 200), pick.integers(0, 4, 200)
    value = lambda w: (np.log((p * w[b]).sum(1)) * n).sum()
    steps = [value(learn_weights(b, p, n, 65, r)) for r in (0, 1, 2, 5, 20, 60)]
    assert steps == sorted(steps) and np.allclose(learn_weights(b, p, n).sum(1), 1)


def test_pack():
    x = np.array([0, 1, 2**63, 77], np.uint64)
    assert (interpolation.unpack(interpolation.pack(x), np.uint64) == x).all()
    assert len(interpolation.unpack(interpolation.pack(x[:0]), np.uint64)) == 0


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert by_id(found(score(odd))) == by_id(plainly(rows))
    assert score(nothing).count() == 0
    alone = score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [r.base_score for r in alone] == [0.0, 0.0] and all(math.isfinite(r.score) for r in alone)
