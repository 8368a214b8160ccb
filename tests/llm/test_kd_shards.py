"""Shards: sizes, slots, copies, and medians against sorting."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from storkline.llm import kd_shards
from storkline.llm.kd_shards import shards


def check(rows, texts, leaves=16):
    """Every row once, slots without gaps; gives the bytes of each shard."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < leaves
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    return [size[i] for i in range(leaves)]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = shards(docs).collect()
    sizes = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert max(sizes) < 1.03 * sum(sizes) / 16 and min(sizes) > 0.97 * sum(sizes) / 16
    homes, weight = defaultdict(set), Counter()
    for r in rows:
        homes[r.size, r.text_crc32].add(r.shard)
        weight[r.size, r.text_crc32] += r.size
    assert all(len(own) == 1 for text, own in homes.items() if weight[text] <= kd_shards.WHOLE * sum(sizes) / 16)


def test_group_larger_than_a_shard_is_split(spark, documents):
    texts = [(i, t[:800]) for i, t in documents] + [(10_000 + i, "copy " * 150) for i in range(600)]
    sizes = check(shards(spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source")).collect(), texts)
    assert max(sizes) < 1.1 * sum(sizes) / 16 and min(sizes) > 0.9 * sum(sizes) / 16


def plain_tree(rows, leaves):
    """Shard by row number, by recursion over lists: widest dimension, weighted median, whole keys."""
    total, out = sum(r.weight for r in rows), {}

    def split(own, node, left):
        if not left:
            out.update(dict.fromkeys((r.row for r in own), node - leaves))
            return
        if sum(r.weight for r in own) * leaves <= total:
            split(own, node * 2, left - 1)
            return
        widths = [max(getattr(r, d) for r in own) - min(getattr(r, d) for r in own) for d in kd_shards.DIMENSIONS]
        d = kd_shards.DIMENSIONS[widths.index(max(widths))]
        key = lambda r: (getattr(r, d), r.tie)
        weights = Counter()
        for r in own:
            weights[key(r)] += r.weight
        half, before, last = sum(weights.values()) / 2, 0, None
        for k in sorted(weights):
            after = before + weights[k]
            if after >= half:
                last = k if abs(after - half) <= abs(before - half) else last
                break
            before, last = after, k
        split([r for r in own if last is not None and key(r) <= last], node * 2, left - 1)
        split([r for r in own if last is None or key(r) > last], node * 2 + 1, left - 1)

    split(rows, 1, leaves.bit_length() - 1)
    return out


def test_against_a_plain_tree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = kd_shards.points(docs, 16)
    assert {r.row: r.shard for r in kd_shards.assign(placed, 16).select("row", "shard").collect()} == plain_tree(placed.collect(), 16)


def test_equal_texts_stay_together_unless_larger_than_a_shard(spark, documents):
    """Groups of copies just below and far above what a shard is to hold."""
    rest = [(i, t) for i, t in documents if len(t) < 3000][:500]
    size = sum(len((t or "").encode()) + 1 for _, t in rest)
    copies = [(10_000 + i, "a text that fills most of a shard " * 20) for i in range(int(0.85 * size / 16 / 700))]
    many = [(20_000 + i, "a text that no shard holds " * 20) for i in range(int(3 * size / 16 / 541))]
    rows = shards(spark.createDataFrame(rest + copies + many, "doc_id long, text string").selectExpr("*", "'en' lang", "'a' source")).collect()
    check(rows, rest + copies + many)
    homes = defaultdict(set)
    for r in rows:
        homes[r.text_crc32, r.oversize].add(r.shard)
    assert all(len(own) == 1 for (_, oversize), own in homes.items() if not oversize)
    assert [len(own) > 1 for (_, oversize), own in homes.items() if oversize] == [True]


def test_medians(spark):
    pick = random.Random(8)
    rows = [(1 + i % 2, pick.randrange(1, 100), pick.choice([5, 9, pick.randrange(1 << 16)]), 0, 0, pick.randrange(1 << 24)) for i in range(500)]
    nodes = spark.createDataFrame(rows, "node int, weight long, lang long, source long, size long, tie long")
    halves = {n: sum(r[1] for r in rows if r[0] == n) / 2 for n in (1, 2)}
    found = kd_shards._medians(nodes, {1: "lang", 2: "source"}, halves)
    for n, at in ((1, 2), (2, 3)):
        keyed = [(r[at] * (1 << 24) + r[5], r[1]) for r in rows if r[0] == n]
        off = lambda k: abs(sum(w for x, w in keyed if x <= k) - halves[n])  # noqa: E731, B023
        assert off(found[n]) == min(off(k) for k, _ in keyed)


def test_odd_rows(spark, odd, nothing):
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    check(shards(odd).collect(), texts)
    check(shards(odd, 1).collect(), texts, 1)
    assert shards(nothing).count() == 0
    with pytest.raises(ValueError):
        shards(odd, 3)
