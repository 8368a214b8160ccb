"""A modified Kneser-Ney model over word bigrams that grows with the corpus.

Texts fall into two folds by their bytes, so that copies stay together, and each is scored by the
model of the other fold: a text's own n-grams say nothing about it. Neither words nor bigrams fit
anywhere whole. Documents are gathered in blocks of one fold, each a row with its distinct words and
the places of its tokens. A block sends its sorted bigrams to buckets by hash; a bucket adds them up
and answers with the counts of the other fold, and names one block of each fold as the holder of a
bigram. Holders add up what the model needs of each word (how many bigrams it begins, by their count,
and how many it ends), buckets of words sum that, and the blocks are scored with it. A frequent word is
one entry a block, so no task is hot. Words and bigrams are known by 64-bit hashes.

The bigrams that all blocks send take more room than the texts. So the buckets are dealt with in rounds,
a range of hashes each, and the folds are scored one after the other: only the shuffle of one round
stands on the disk at a time. Blocks lie in a table bucketed by block, which no round shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from storkline.llm import text
from storkline.llm.interpolation import BUCKET_TOKENS, LEAST_BUCKETS, pack, unpack
from storkline.session import cut, cut_by, shuffles_let_go

_END = text.mix(np.array([0xE4E], np.uint64))
_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
#: of a word: bigrams it begins (as often as they occur; different ones of count 1, 2, 3 or more), different ones it ends
STATS = 5
#: rounds of the bigrams and of the words, as bits of their hashes
PAIR_ROUNDS, WORD_ROUNDS = 2, 1
#: text in a block, and in a bucket of blocks; the larger a block, the less often a word or bigram is sent
BLOCK_BYTES, SHELF_BYTES = 4 << 20, 8 << 20
_ZSTD = pa.Codec("zstd")


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts and the n + 1 bounds of each text's tokens. A token is a run of
    letters and digits in lower case (A to Z); a character of three bytes or more, as in scripts that
    put no space between words, is a token of its own."""
    data, offsets = text.raw(column)
    data = text.LOWER[data]
    starts, ends, bounds = text.split(data, offsets, text.PUNCTUATION)
    if len(data) and data.max() >= 0xE0:
        lead = data >= 0xE0
        head = (data & 0xC0) != 0x80
        wide = lead[np.maximum.accumulate(np.where(head, np.arange(len(data)), 0))]
        after = np.zeros(len(data), bool)
        after[1:] = wide[:-1] & ~wide[1:] & ~text.PUNCTUATION[data[1:]]
        starts = np.union1d(starts, np.flatnonzero(lead | after))
        ends = np.union1d(ends, np.concatenate([np.flatnonzero(lead[1:] & ~text.PUNCTUATION[data[:-1]]) + 1, np.flatnonzero(after)]))
        bounds = np.searchsorted(starts, offsets)
    return text.hashes(data, starts, ends), bounds


def _closed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts, each text closed by an end, and where each text ends."""
    words, bounds = tokens(column)
    n = len(bounds) - 1
    out = np.full(len(words) + n, _END[0])
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(bounds))] = words
    return out, bounds[1:] + np.arange(1, n + 1)


def _gather(carried: dict[str, str]):
    """Blocks of one fold each, with the carried columns of their documents."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {0: [], 1: []}
        size = {0: 0, 1: 0}
        number = TaskContext.get().partitionId() << 32

        def block(fold: int) -> pa.RecordBatch:
            nonlocal number
            hashed, ends, rows = zip(*waiting[fold], strict=True)
            shift = np.cumsum([0, *map(len, hashed)])[:-1]
            words, places, often = np.unique(np.concatenate(hashed), return_inverse=True, return_counts=True)
            ranks = np.empty(len(words), np.uint32)
            ranks[_by_rank(often)] = np.arange(len(words), dtype=np.uint32)
            ends = np.concatenate([e + s for e, s in zip(ends, shift, strict=True)]).astype(np.int32)
            columns = [pa.array([number], pa.int64()), pa.array([fold], pa.int32()), pa.array([len(places)], pa.int64()), pa.array([ends], pa.list_(pa.int32())),
                       pa.array([_sorted(words)], pa.binary()), pa.array([_packed(often.astype(np.uint32))], pa.binary()), pa.array([_packed(ranks[places])], pa.binary())]
            columns += [pa.array([[x for own in rows for x in own[c]]], pa.list_(_TYPES[kind])) for c, kind in carried.items()]
            number += 1
            waiting[fold], size[fold] = [], 0
            return pa.RecordBatch.from_arrays(columns, ["block", "fold", "n_tokens", "ends", "words", "often", "ranks", *carried])

        for batch in batches:
            for part in text.chunks([batch]):
                folds = part.column("fold").to_numpy()
                for fold in waiting:
                    at = np.flatnonzero(folds == fold)
                    if len(at):
                        own = part.take(pa.array(at))
                        waiting[fold].append((*_closed(own.column("text")), {c: own.column(c).to_pylist() for c in carried}))
                        size[fold] += own.column("text").nbytes
                        if size[fold] >= BLOCK_BYTES:
                            yield block(fold)
        yield from (block(fold) for fold, own in waiting.items() if own)
    return run


def _packed(values: np.ndarray) -> bytes:
    """Squeezed, with the size before; the codec of a shuffle makes less of it."""
    plain = pack(values)
    return len(plain).to_bytes(8, "little") + _ZSTD.compress(plain, asbytes=True)


def _unpacked(packed: bytes, kind: type) -> np.ndarray:
    return unpack(_ZSTD.decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), kind)


def _sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unsorted(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(packed, np.uint64), dtype=np.uint64)


def _by_rank(often: np.ndarray) -> np.ndarray:
    """The places of a block's words, frequent ones first: small ranks take less room than places."""
    return np.argsort(-often.astype(np.int64), kind="stable")


def _words(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block its sorted words, the place of each token, and the bigram that ends with each token
    (a text's first token stands after the end before it)."""
    words = _unsorted(block["words"])
    places = _by_rank(_unpacked(block["often"], np.uint32))[_unpacked(block["ranks"], np.uint32)]
    return words, places, text.joined(np.concatenate([_END, words[places]]), 2)


def _before(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The place of the token before each token."""
    return np.concatenate([[np.searchsorted(words, _END[0])], places[:-1]])


def _spans(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """The buckets that sorted keys fall into, with their bounds."""
    edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(int(b), int(edges[b]), int(edges[b + 1])) for b in np.flatnonzero(np.diff(edges))]


_ASKED = "bucket int, block long, fold int, keys binary, values binary"


def _ask_table(block: dict, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """The keys of a block with their values (one row of `values` a number), cut to buckets."""
    spans = _spans(keys, bits)
    return pa.RecordBatch.from_arrays([
        pa.array([s[0] for s in spans], pa.int32()), pa.array([block["block"]] * len(spans), pa.int64()), pa.array([block["fold"]] * len(spans), pa.int32()),
        pa.array([_sorted(keys[a:b]) for _, a, b in spans], pa.binary()),
        pa.array([_packed(values[:, a:b].astype(np.uint64).ravel()) for _, a, b in spans], pa.binary()),
    ], ["bucket", "block", "fold", "keys", "values"])


def _ask_bigrams(bits: int, part: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text.rows_of(batch):
                every = _words(block)[2]
                pairs, counts = np.unique(every[every >> np.uint64(64 - PAIR_ROUNDS) == part], return_counts=True)
                yield _ask_table(block, pairs, counts[None], bits)
    return run


def _summed(asked: list[dict], n_values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums (fold, value, key) over the keys of a bucket, and where each row's keys stand."""
    keys = [_unsorted(r["keys"]) for r in asked]
    different, places = np.unique(np.concatenate(keys), return_inverse=True)
    there = np.split(places, np.cumsum([len(k) for k in keys])[:-1])
    sums = np.zeros((2, n_values, len(different)), np.int64)
    for r, at in zip(asked, there, strict=True):
        sums[r["fold"]][:, at] += _unpacked(r["values"], np.uint64).reshape(n_values, -1).astype(np.int64)
    return sums, there


_ANSWERS = "level int, bucket int, block long, fold int, found binary, held binary, ones array<long>"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _answer_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [p.split()[0] for p in _ANSWERS.split(", ")])


def _few(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many are above 0, and their sum."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts > 0).sum()), int(counts.sum())]


def _answer_bigrams(table: pa.Table) -> pa.Table:
    """For each row that asked the counts of the other fold, and the own fold's count (4 for more)
    where the row's block is the holder; a row without a block with the counts of low counts."""
    asked = table.to_pylist()
    sums, there = _summed(asked, 1)
    sums, held, out = sums[:, 0], np.zeros((2, sums.shape[2]), bool), []
    for r, at in zip(asked, there, strict=True):
        fold = r["fold"]
        first = np.where(held[fold][at], 0, np.minimum(sums[fold][at], 4)).astype(np.uint8)
        held[fold][at] = True
        out.append((1, r["bucket"], r["block"], fold, _packed(sums[1 - fold][at].astype(np.uint64)), _packed(first), None))
    out.append((1, asked[0]["bucket"], None, None, None, None, _few(sums[0]) + _few(sums[1])))
    return _answer_table(out)


def _put(answers: list[dict], level: int, which: str, kind: type, n: int = 1) -> np.ndarray:
    """The answers to a block's sorted keys, put together from its buckets."""
    own = sorted((r for r in answers if r["level"] == level), key=lambda r: r["bucket"])
    return np.concatenate([_unpacked(r[which], kind).reshape(n, -1) for r in own], axis=1).astype(np.int64)


def _ask_words(bits: int, part: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        replies, out = answers.to_pylist(), []
        for block in text.rows_of(blocks):
            words, places, every = _words(block)
            before = _before(words, places)
            held = _put(replies, 1, "held", np.uint8)[0]
            first = np.unique(every, return_index=True)[1]  # a token of each bigram
            stats = np.stack([
                np.bincount(before, minlength=len(words)),
                *(np.bincount(before[first[mark]], minlength=len(words)) for mark in (held == 1, held == 2, held >= 3)),
                np.bincount(places[first[held > 0]], minlength=len(words)),
            ])
            own = words >> np.uint64(64 - WORD_ROUNDS) == part
            out.append(_ask_table(block, words[own], stats[:, own], bits))
        return pa.Table.from_batches(out)
    return run


def _answer_words(table: pa.Table) -> pa.Table:
    """As `_answer_bigrams`; of how often a word begins bigrams only what their low counts leave open."""
    asked = table.to_pylist()
    sums, there = _summed(asked, STATS)
    sums[:, 0] -= sums[:, 1] + 2 * sums[:, 2] + 3 * sums[:, 3]
    out = [(0, r["bucket"], r["block"], r["fold"], _packed(sums[1 - r["fold"]][:, at].astype(np.uint64).ravel()), None, None) for r, at in zip(asked, there, strict=True)]
    out.append((0, asked[0]["bucket"], None, None, None, None, _few(sums[0, STATS - 1]) + _few(sums[1, STATS - 1])))
    return _answer_table(out)


def _ones(answers: DataFrame) -> np.ndarray:
    """(fold, number): the sums of `_few` over all buckets."""
    row = answers.filter("block is null").agg(*(F.coalesce(F.sum(F.col("ones")[i]), F.lit(0)) for i in range(12))).first()
    return np.array(row, np.int64).reshape(2, 6)


def _score(carried: dict[str, str], pair_cuts: list[np.ndarray], word_cuts: list[np.ndarray], word_ones: np.ndarray):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, replies = [], answers.to_pylist()
        for block in text.rows_of(blocks):
            words, places, every = _words(block)
            before, own = _before(words, places), np.unique(every, return_inverse=True)[1]
            fold = 1 - block["fold"]
            more, *kinds, ended = _put(replies, 0, "found", np.uint64, STATS)
            begun = more + kinds[0] + 2 * kinds[1] + 3 * kinds[2]
            pair = _put(replies, 1, "found", np.uint64)[0][own]
            d1, d2 = word_cuts[fold], pair_cuts[fold]
            ones, types, total = word_ones[fold][:3], word_ones[fold][4], word_ones[fold][5]
            freed = (d1[1:3] * ones[:2]).sum() + d1[3] * (types - ones[:2].sum())
            single = ((ended - d1[np.minimum(ended, 3)]) / total + freed / total / (types + 1)) if total else np.ones(len(ended))
            weight = np.where(begun > 0, (d2[1:] @ np.stack(kinds)) / np.maximum(begun, 1), 1.0)
            lower = weight[before] * single[places]
            p = (pair - d2[np.minimum(pair, 3)]) / np.maximum(begun[before], 1) + lower
            ends = np.array(block["ends"])
            begins = np.concatenate([[0], ends[:-1]])
            sums = [np.add.reduceat(x, begins) / (ends - begins) for x in (-np.log10(p), np.log10(p / lower))]
            out.append(pa.table(
                [*(pa.array(block[c], _TYPES[kind]) for c, kind in carried.items()), pa.array(ends - begins - 1, pa.int64()), *map(pa.array, sums)],
                [*carried, "n_tokens", "word_log_perplexity", "order_gain"],
            ))
        return pa.concat_tables(out)
    return run


def _rounds(bits: int, one: Callable[[int], DataFrame]) -> DataFrame:
    """The answers to all ranges of hashes, each asked for and written before the next."""
    return reduce(DataFrame.unionByName, [cut(one(part)) for part in range(1 << bits)])


def score(rows: DataFrame, carried: dict[str, str], discounts: Callable[[list[int]], np.ndarray], size: int | None = None) -> DataFrame:
    """One row per row of `rows` (`text`, `fold` and the carried columns, given with their types): the
    carried columns, `n_tokens`, `word_log_perplexity` (per token and end, log10) and `order_gain`: by how
    much log10 of a token's chance grows on average by the bigrams seen, over that of its back-off; 0 if
    no bigram of the text stands in the other fold. `size`, if known, is the bytes of all texts."""
    if size is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    lists = ", ".join(f"{c} array<{kind}>" for c, kind in carried.items())
    kinds = f"block long, fold int, n_tokens long, ends array<int>, words binary, often binary, ranks binary, {lists}"
    with shuffles_let_go(rows.sparkSession):
        blocks = cut_by(rows.mapInArrow(_gather(carried), kinds), "block", max(1, math.ceil(size / SHELF_BYTES)))
        n = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
        bits = max(LEAST_BUCKETS - 1, n // BUCKET_TOKENS).bit_length()
        narrow = blocks.select("block", "fold", "words", "often", "ranks")

        def answer_bigrams(part: int) -> DataFrame:
            return narrow.mapInArrow(_ask_bigrams(bits, part), _ASKED).groupBy("bucket").applyInArrow(_answer_bigrams, _ANSWERS)

        pairs = _rounds(PAIR_ROUNDS, answer_bigrams)
        told = pairs.filter("block is not null")
        held = told.select("level", "bucket", "block", "held")

        def answer_words(part: int) -> DataFrame:
            asked = narrow.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(_ask_words(bits, part), _ASKED)
            return asked.groupBy("bucket").applyInArrow(_answer_words, _ANSWERS)

        words = _rounds(WORD_ROUNDS, answer_words)
        pair_ones, word_ones = _ones(pairs), _ones(words)
        cuts = [[discounts(own[:4].tolist()) for own in ones] for ones in (pair_ones, word_ones)]
        replies = told.unionByName(words.filter("block is not null")).select("level", "bucket", "block", "fold", "found")
        schema = ", ".join(f"{c} {kind}" for c, kind in carried.items())

        def scores(fold: int) -> DataFrame:
            asked, own = blocks.filter(F.col("fold") == fold), replies.filter(F.col("fold") == fold).drop("fold")
            scored = asked.groupBy("block").cogroup(own.groupBy("block"))
            return scored.applyInArrow(_score(carried, *cuts, word_ones), f"{schema}, n_tokens long, word_log_perplexity double, order_gain double")

        return cut(scores(0)).unionByName(cut(scores(1)))
