"""Benchmark passages against a comparison of every window with every item."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storkline.llm import decontaminate
from storkline.llm.decontaminate import drop_leaks, find_leaks

NEW = random.Random(3)


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def weighted(w):
    total = Counter()
    for i in range(len(w) - 4):
        total[tuple(w[i:i + 5])] += sum(len(x.encode()) for x in w[i:i + 5])
    return total


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def by_all_windows(docs, items):
    found = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            own = words(x)
            if len(own) >= 5:
                target, n = weighted(own), len(own)
                every = [similarity(weighted(w[s:s + n]), target) for s in range(len(w) - n + 1)]
                if every and max(every) >= 0.8:
                    found[d, i] = (pytest.approx(max(every)), every.index(max(every)))
    return found


def test_edited_passages(spark):
    word = lambda: "".join(NEW.choices("abcdefghij", k=NEW.randrange(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate([6, 15, 40, 60, 60, 120])]
    items.append((9, "four words only here"))
    docs = [(i, " ".join(prose(NEW.randrange(0, 200)))) for i in range(30)]
    for k in range(40):
        own = items[k % 6][1].split()
        for _ in range(k % 4):
            own[NEW.randrange(len(own))] = word()
        docs.append((100 + k, " ".join([*prose(NEW.randrange(50)), *own, *prose(NEW.randrange(50))])))
    docs += [(300, items[2][1].upper().replace(" ", " - ")), (301, "four words only here"), (302, (items[1][1] + " ") * 40)]
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = by_all_windows(docs, items)
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in out} == expected
    assert len(expected) >= 20 and all(r.distance <= decontaminate.RADIUS for r in out)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "benchmark"))
    own = {r.item_id: " ".join(words(r.text)) for r in items.collect()}
    plain = {r.doc_id: " ".join(words(r.text)) for r in docs.select("doc_id", "text").collect()}
    whole = {(d, i) for d, t in plain.items() for i, x in own.items() if f" {x} " in f" {t} "}
    found = {(r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()}
    assert whole and whole <= found and len(found) <= len(whole) + 3
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(plain) - len({d for d, _ in found})


def test_index_holds_every_print_within_the_radius():
    pick = np.random.default_rng(1)
    for distance in range(decontaminate.RADIUS + 1):
        for _ in range(50):
            flips = sum(1 << int(b) for b in pick.choice(64, distance, replace=False))
            at, near = 0, False
            for width in decontaminate.BLOCKS:
                near |= ((flips >> at) & ((1 << width) - 1)) in set(decontaminate._near(width))
                at += width
            assert near and at == 64


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "two three four five six"), (None, "one two three four five six"), (4, "Word " * 30)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in find_leaks(odd, items).collect()}
    assert found == {(5, 3), (6, 3), (7, 4)}
    assert drop_leaks(odd, items).count() == odd.count() - 4 and drop_leaks(odd, items).columns == odd.columns
    assert find_leaks(nothing, items).count() == 0 and find_leaks(odd, items.limit(0)).count() == 0


def test_texts_shorter_than_the_item(spark):
    word = lambda: "".join(NEW.choices("abcdefghij", k=NEW.randrange(2, 14)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([6, 9, 15, 40, 40, 41, 60, 120])]
    docs = []
    for i, x in items:
        own = x.split()
        docs += [(100 * i + k, " ".join(own[a:len(own) - k + a])) for k in range(1, min(len(own), 30)) for a in [NEW.randrange(k + 1)]]
        docs += [(100 * i + 50 + k, " ".join(own[:3] + own[3 + k:-1])) for k in range(4)]
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = {}
    for d, t in docs:
        for i, x in items:
            w, own = words(t), words(x)
            if 5 <= len(w) < len(own) and similarity(weighted(w), weighted(own)) >= 0.8:
                expected[d, i] = (pytest.approx(similarity(weighted(w), weighted(own))), 0, len(w))
    short = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_words) for r in out}
    assert len(expected) >= 20 and short == expected
    assert drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == len(docs) - len({d for d, _ in expected})


@pytest.mark.parametrize("uneven", [False, True])
def test_recall_of_the_radius(uneven):
    """Pairs of equal length at a similarity of 0.8 and more, tried in pairs: how many lie beyond the radius. One word in
    seven is long in the uneven texts, and the five shingles it raises at once spread the distance."""
    pick = random.Random(4)

    def word():
        return "".join(pick.choice("abcdefghij") for _ in range(pick.randrange(20, 60) if uneven and pick.random() < 0.15 else pick.randrange(2, 10)))

    texts = []
    for _ in range(6000):
        own = [word() for _ in range(pick.randrange(12, 120))]
        other = list(own)
        for _ in range(pick.choice([1, 1, 1, 2, 2, 3, 4])):
            other[pick.randrange(len(own))] = word()
        texts += [" ".join(own), " ".join(other)]
    every, weights, bounds = decontaminate._shingled(pa.array(texts))
    starts, stops = bounds[:-1], bounds[1:] - decontaminate.WIDTH + 1
    prints = decontaminate._prints(every, weights, starts, stops)
    weighed = [decontaminate._weighed(every[a:b].tolist(), weights[a:b].tolist()) for a, b in zip(starts, stops, strict=True)]
    apart = [
        int(prints[i] ^ prints[i + 1]).bit_count() for i in range(0, len(texts), 2) if decontaminate.weighted_similarity(weighed[i], weighed[i + 1]) >= 0.8
    ]
    assert len(apart) > 2000 and sum(d > decontaminate.RADIUS for d in apart) <= 0.002 * len(apart)
