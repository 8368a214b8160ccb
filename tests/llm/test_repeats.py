"""Repeated strings: the result against a plain scan of all strings, and each step's part in it."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from storkline.llm import repeats
from storkline.llm.repeats import COVERS, period, remove_repeats


def by_scan(texts, width):
    """Every string of every text in order; the second and later ones cover bytes that go."""
    seen, rows = set(), []
    for i, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            own = b[k:k + width]
            if own in seen:
                gone[k:k + width] = b"\1" * width
            seen.add(own)
        spans, k = [], 0
        while k < len(b):
            e = k
            while e < len(b) and gone[e]:
                e += 1
            if e > k:
                spans.append((k, e))
            k = e + 1
        rows.append((i, len(b), sum(gone), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return Counter(rows)


def run(docs, width=100):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)), bytes(r.kept)) for r in remove_repeats(docs, width).collect())


def test_covers():
    for v, cover in COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
    assert [period(w) for w in (5, 12, 13, 25, 61, 100, 1000)] == [3, 3, 7, 13, 31, 31, 31]
    with pytest.raises(ValueError):
        period(4)


def test_whole_table(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = run(docs.repartition(5))
    assert found == by_scan(documents, 100)
    assert sum(r[2] for r in found) > 100_000 and sum(len(r[3]) for r in found) > 200


@pytest.mark.parametrize(("width", "letters", "n"), [(5, "ab", 60), (6, "abc", 150), (13, "ab", 200), (20, "ab", 200), (25, "ab", 300), (61, "a", 60)])
def test_dense_repeats(spark, width, letters, n):
    """Short alphabets: matches overlap each other and themselves, at all distances."""
    pick = random.Random(width)
    parts = ["".join(pick.choice(letters) for _ in range(pick.randrange(1, 3 * width))) for _ in range(12)]
    texts = []
    for i in range(n):
        t = "".join(pick.choice(parts)[pick.randrange(4):] for _ in range(pick.randrange(6)))
        texts.append((i, t if pick.random() < 0.5 else "".join(pick.choice(letters) for _ in range(pick.randrange(4 * width)))))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    assert run(docs, width) == by_scan(texts, width)


def test_edges_of_matches(spark):
    """Passages of 96 to 104 bytes, at the edges of texts and inside, with marks of several bytes."""
    pick = random.Random(5)
    word = lambda n: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz éß") for _ in range(n))
    texts = []
    for size in (96, 98, 99, 100, 101, 104, 160):
        passage = "".join(pick.choice("abcdefghij ") for _ in range(size))
        for head, tail in ((0, 0), (0, 40), (40, 0), (7, 8), (150, 150)):
            texts += [word(head) + passage + word(tail), word(head) + passage + word(3) + passage[:99] + "#" + passage[1:] + word(tail)]
    pick.shuffle(texts)
    texts = list(enumerate(texts))
    assert run(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)) == by_scan(texts, 100)


def test_near_copies_and_a_hot_passage(spark):
    pick = random.Random(6)
    text = "".join(pick.choice("abcdefgh ") for _ in range(1500))
    passage = "".join(pick.choice("ijklmn ") for _ in range(300))
    texts = []
    for i in range(400):
        own = list(text)
        for _ in range(pick.randrange(4)):
            own[pick.randrange(len(own))] = pick.choice("XYZ")
        texts.append((i * 7 % 400, "".join(own) if i % 3 else "".join(pick.choice("opqrst ") for _ in range(200)) + passage + str(i)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert run(docs) == by_scan(texts, 100)


def test_odd_rows(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(odd) == by_scan(texts, 100)
    assert run(nothing) == Counter()
    assert run(odd.filter("text is null")) == by_scan([r for r in texts if r[1] is None], 100)


def _stretches(texts, width=100):
    import pyarrow as pa

    out = []
    for k, own in enumerate(texts):
        data = [t.encode() for t in own]
        row = {"block": 0, "stretch": k, "doc_ids": list(range(len(own))), "ends": np.cumsum([len(b) for b in data], dtype=np.int64).tobytes(),
               "digests": b"".join(hashlib.sha256(b).digest()[:16] for b in data), "data": b"".join(data)}
        out.append(repeats._Stretch({c: pa.scalar(v) for c, v in row.items()}, width))
    return out


def test_few_strings_are_left_to_sort(spark, documents):
    """The first step passes what repeats and little else; a common passage is asked once a stretch."""
    own = _stretches([[t for _, t in documents]])[0]
    at, names = own.sampled(np.zeros(len(own.ids), bool))
    assert 0.18 < len(at) / len(own.data) < 6 / 31
    passage = "the same passage stands in every one of these texts, and it is longer than a hundred bytes, so that it goes"
    hot = _stretches([[passage + str(i) for i in range(3000)]])[0]
    at, names = hot.sampled(np.zeros(3000, bool))
    assert len(at) == 3000 * 8 and len(np.unique(names)) == 8 and len(hot.ask(np.unique(names), 64, 0)[0][4]) < 200


def test_blocks_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = remove_repeats(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    cogroup = plan[plan.index("FlatMapCoGroupsInArrow"):]
    left = cogroup[:cogroup.index("asker")]
    assert "Bucketed: true" in left and "Exchange" not in left.split("FileScan")[0]


def test_blocks_are_read_where_they_lie(spark):
    """As above, without the node's own line, which names the keys of both sides."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = remove_repeats(docs)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    below = plan[plan.index("FlatMapCoGroupsInArrow"):].split("\n", 1)[1]
    left = below[:below.index("asker")]
    assert "Bucketed: true" in left and "Exchange" not in left.split("FileScan")[0]
