"""Benchmark passages in documents, found by SimHash of item-sized windows.

1. Benchmark items become weighted multisets of five-word shingles (weight: bytes of the words) and a
   64-bit SimHash each.
2. In every text, each window of as many words as an item has is weighed against the shingles of the
   items of that size: a window less than `PERCENT` of whose weight lies in such shingles cannot be
   that similar to any item. The shingles are looked up in bit tables of a fixed size, whose false
   hits only let more windows through. The other windows get a SimHash. A text shorter than an item
   is one window for the items of that size, if its weight is near enough to any of theirs.
3. A multi-index finds every item of the window's item size within `RADIUS` bits: the fingerprints are cut into
   blocks, so two within the radius differ by at most `ERRORS` bits in some block, and the index holds
   each item under all block values that near.
4. The exact weighted similarity of the shingles settles each pair found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storkline.llm import text
from storkline.session import cut

WIDTH, PERCENT = 5, 80
#: a pair at the threshold differs by 9.6 of 64 bits on average, with a deviation of 2.9
RADIUS = 19
BLOCKS = (13, 13, 13, 13, 12)
ERRORS = RADIUS // len(BLOCKS)
TABLE_BITS = 24
_SLICE = 4096

_ITEMS = "item_id long, n_words int, print long, shingles array<long>, weights array<int>"
_WINDOWS = "doc_id long, start int, n_words int, item_words int, print long, shingles array<long>, weights array<int>"


def _shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and weights at every word of all texts (whatever text a word belongs to), and
    the bounds of each text's words."""
    data, offsets = text.raw(column)
    starts, ends, bounds = text.split(data, offsets, text.PUNCTUATION)
    every = text.joined(text.hashes(data, starts, ends), WIDTH)
    sizes = np.concatenate([[0], np.cumsum(ends - starts)])
    return every, sizes[WIDTH:] - sizes[:len(every)], bounds


def _prints(shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHash of the shingles from each start up to its stop; starts ascend."""
    out = np.zeros(len(starts), np.uint64)
    bits = np.arange(64, dtype=np.uint64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + _SLICE))
        a, b = starts[at], stops[at:end].max()
        signs = (((shingles[a:b, None] >> bits) & np.uint64(1)).astype(np.int64) * 2 - 1) * weights[a:b, None]
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs, axis=0)])
        up = sums[stops[at:end] - a] >= sums[starts[at:end] - a]
        out[at:end] = (up.astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64)
        at = end
    return out


def _read_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text.chunks(batches):
        every, weights, bounds = _shingled(batch.column("text"))
        rows = [i for i in range(batch.num_rows) if bounds[i + 1] - bounds[i] >= WIDTH]
        spans = [(bounds[i], bounds[i + 1] - WIDTH + 1) for i in rows]
        a, b = (np.array([s[k] for s in spans], dtype=np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([
            batch.column("item_id").take(pa.array(rows, pa.int64())), pa.array(b - a + WIDTH - 1, pa.int32()),
            pa.array(_prints(every, weights, a, b).view(np.int64)),
            pa.array([every[x:y].view(np.int64) for x, y in spans], pa.list_(pa.int64())),
            pa.array([weights[x:y].astype(np.int32) for x, y in spans], pa.list_(pa.int32())),
        ], ["item_id", "n_words", "print", "shingles", "weights"])


def _slots(shingles: np.ndarray, size: int) -> np.ndarray:
    """Places in the bit table of shingles in items of `size` words; size 0 stands for any."""
    return text.mix(shingles + np.uint64(size)) >> np.uint64(64 - TABLE_BITS)


def _held(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of the places are set in a bit table."""
    return (table[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).view(bool)


def _item_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for size, own in zip(batch.column("n_words").to_pylist(), batch.column("shingles"), strict=True):
            shingles = own.values.to_numpy().view(np.uint64)
            places = np.unique(np.concatenate([_slots(shingles, 0), _slots(shingles, size)]))
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32))], ["slot"])


def _windows(known):
    """Windows of the texts that may reach the similarity, with their fingerprints."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes, lightest, heaviest = known.value
        least = lightest.min() if len(sizes) else 1
        for batch in text.chunks(batches):
            every, weights, bounds = _shingled(batch.column("text"))
            n = len(every)
            hit = _held(table, _slots(every, 0))
            mass = np.concatenate([[0], np.cumsum(np.where(hit, weights, 0))])
            # a text needs the smallest item's share of such shingles
            ends = np.clip(bounds[1:] - WIDTH + 1, np.minimum(bounds[:-1], n), n)
            begins = np.minimum(bounds[:-1], n)
            rich = np.flatnonzero(100 * (mass[ends] - mass[begins]) >= PERCENT * least)
            found = []
            for i in rich[ends[rich] > begins[rich]]:
                g, w = every[begins[i]:ends[i]], weights[begins[i]:ends[i]]
                total = np.concatenate([[0], np.cumsum(w)])
                for size in sizes[sizes <= len(g) + WIDTH - 1]:
                    m = size - WIDTH + 1
                    own = np.concatenate([[0], np.cumsum(np.where(_held(table, _slots(g, size)), w, 0))])
                    at = np.flatnonzero(100 * (own[m:] - own[:-m]) >= PERCENT * (total[m:] - total[:-m]))
                    if len(at):
                        found.append((i, size, size, at, _prints(g, w, at, at + m), g, w))
                # a shorter text as a whole: the similarity bounds the ratio of the weights
                whole, words = total[-1], len(g) + WIDTH - 1
                for size in sizes[(sizes > words) & (PERCENT * lightest <= 100 * whole) & (PERCENT * whole <= 100 * heaviest)]:
                    if 100 * w[_held(table, _slots(g, size))].sum() >= PERCENT * whole:
                        at = np.zeros(1, np.int64)
                        found.append((i, words, size, at, _prints(g, w, at, at + len(g)), g, w))
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, n, s, p, g[s:s + n - WIDTH + 1], w[s:s + n - WIDTH + 1], size) for i, n, size, at, prints, g, w in found for s, p in zip(at, prints, strict=True)]
            for k in range(0, len(rows), 2000):
                part = list(zip(*rows[k:k + 2000], strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[i] for i in part[0]], pa.int64()), pa.array(part[2], pa.int32()), pa.array(part[1], pa.int32()), pa.array(part[6], pa.int32()),
                    pa.array(np.array(part[3], np.uint64).view(np.int64)), pa.array([g.view(np.int64) for g in part[4]], pa.list_(pa.int64())),
                    pa.array([w.astype(np.int32) for w in part[5]], pa.list_(pa.int32())),
                ], ["doc_id", "start", "n_words", "item_words", "print", "shingles", "weights"])
    return run


def _weighed(shingles: list[int], weights: list[int]) -> dict[int, int]:
    total: dict[int, int] = {}
    for s, w in zip(shingles, weights, strict=True):
        total[s] = total.get(s, 0) + w
    return total


def weighted_similarity(a: dict[int, int], b: dict[int, int]) -> float:
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = batch.to_pydict()
        found = [
            weighted_similarity(_weighed(a, v), _weighed(b, w))
            for a, v, b, w in zip(columns["shingles"], columns["weights"], columns["item_shingles"], columns["item_weights"], strict=True)
        ]
        names = ["doc_id", "item_id", "start", "n_words", "distance"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(found, pa.float64())], [*names, "similarity"])


def _block(print_: str, i: int) -> F.Column:
    return F.shiftrightunsigned(print_, sum(BLOCKS[:i])).bitwiseAND((1 << BLOCKS[i]) - 1)


def _near(width: int) -> list[int]:
    """All masks of at most ERRORS bits."""
    return [sum(1 << b for b in bits) for n in range(ERRORS + 1) for bits in combinations(range(width), n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item found in it: `doc_id`, `item_id`, `similarity`,
    `distance` (bits of the fingerprints), `start` and `n_words` of the best window (the first of
    equals), words counted from 0.

    A window has as many words as the item, or is the whole text where that is shorter. Words are runs
    of letters and digits in lower case. An item or text of fewer than five words, or
    a null one, matches nothing. Rows without doc_id or item_id are not searched. Of rows that
    repeat a doc_id or item_id the best match counts; other columns are ignored.
    """
    spark = docs.sparkSession
    lower = F.lower(F.col("text").cast("string")).alias("text")
    items = cut(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), lower).filter("item_id is not null")
        .mapInArrow(_read_items, _ITEMS)
    )
    weight = F.aggregate("weights", F.lit(0), lambda a, w: a + w)
    shape = items.groupBy("n_words").agg(F.min(weight).alias("least"), F.max(weight).alias("most")).toPandas().sort_values("n_words")
    slots = items.select("n_words", "shingles").mapInArrow(_item_slots, "slot int").distinct().toPandas()["slot"].to_numpy()
    flags = np.zeros(1 << TABLE_BITS, np.uint8)
    flags[slots] = 1
    known = spark.sparkContext.broadcast((np.packbits(flags, bitorder="little"), *(shape[c].to_numpy() for c in ("n_words", "least", "most"))))

    windows = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower).filter("doc_id is not null")
        .mapInArrow(_windows(known), _WINDOWS).withColumn("window", F.monotonically_increasing_id())
    )
    blocks = range(len(BLOCKS))
    pieces = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _block("print", i).alias("v")) for i in blocks)))
    left = windows.select("window", "item_words", "print", pieces.alias("block"))
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(_near(BLOCKS[i])).alias("masks"), _block("print", i).alias("v")) for i in blocks)))
    right = items.select("item_id", F.col("n_words").alias("item_words"), F.col("print").alias("item_print"), near.alias("x"))
    right = right.select("item_id", "item_words", "item_print", "x.i", "x.v", F.explode("x.masks").alias("mask"))
    right = right.select("item_id", "item_words", "item_print", F.struct("i", F.col("v").bitwiseXOR(F.col("mask")).alias("v")).alias("block"))
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = left.join(right, ["item_words", "block"]).select("window", "item_id", distance.alias("distance")).filter(F.col("distance") <= RADIUS).distinct()
    own = items.select("item_id", F.col("n_words").alias("own_words"), F.col("shingles").alias("item_shingles"), F.col("weights").alias("item_weights"))
    both = pairs.join(windows, "window").join(own, "item_id").filter("own_words = item_words")
    settled = both.select("doc_id", "item_id", "start", "n_words", "distance", "shingles", "weights", "item_shingles", "item_weights").mapInArrow(
        _settle, "doc_id long, item_id long, start int, n_words int, distance int, similarity double"
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "distance")).alias("best")
    return settled.filter(F.col("similarity") >= PERCENT / 100).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.similarity", "best.distance", (-F.col("best.back")).alias("start"), "best.n_words"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found; rows without doc_id stay."""
    found = cut(find_leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
