"""Deleted interpolation: a word bigram model mixed from maximum-likelihood estimates.

P(w | v) = a * c(v w) / c(v) + b * c(w) / N + (1 - a - b) / (V + 1), where a and b depend on how often
the context v was seen, in buckets of powers of two. The weights are learned by expectation-maximisation
on a deleted fold of the training documents, with the counts of the other folds; then all training
documents count.

Neither the vocabulary nor the bigrams fit anywhere whole. Documents are gathered in blocks, each a row
with its distinct words and the places of its tokens. A block sends its distinct words and bigrams,
sorted, to buckets by hash; a bucket adds them up and sends the counts back to the blocks that asked,
where the texts are scored. A frequent word is one entry a block, so no task is hot. Words and bigrams
are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from storkline.llm import text
from storkline.session import cut

FOLDS, HELD_OUT, TUNING = 7, 2, 6
#: bytes of text in a block, and about as many tokens in a bucket
BLOCK_BYTES, BUCKET_TOKENS = 2 << 20, 1 << 19
LEAST_BUCKETS = 64
ROUNDS = 60
#: cells of the held-out counts: four to an octave of the probabilities
PER_OCTAVE = 4

KEPT, TUNED, OTHER = 0, 1, 2  # kinds of blocks: counted, counted after tuning, only scored
_END = text.mix(np.array([0xE4D], np.uint64))

_BLOCKS = "block long, kind int, n_tokens long, doc_ids array<long>, held_out array<boolean>, ends array<int>, words binary, tokens binary"


def pack(values: np.ndarray) -> bytes:
    """The bytes of an array by significance, which compresses well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpack(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    return pack(counts.astype(np.uint64))


def _token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text closed by an end, and where each text ends."""
    words, bounds = text.word_hashes(column)
    n = len(bounds) - 1
    out = np.full(len(words) + n, _END[0])
    out[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(bounds))] = words
    return out, bounds[1:] + np.arange(1, n + 1)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one kind each."""
    waiting: dict[int, list] = {KEPT: [], TUNED: [], OTHER: []}
    size = dict.fromkeys(waiting, 0)
    number = TaskContext.get().partitionId() << 32

    def block(kind: int) -> pa.RecordBatch:
        nonlocal number
        ids, held, hashed, ends = zip(*waiting[kind], strict=True)
        shift = np.cumsum([0, *map(len, hashed)])[:-1]
        words, tokens = np.unique(np.concatenate(hashed), return_inverse=True)
        row = [
            number, kind, len(tokens), [i for own in ids for i in own], [h for own in held for h in own],
            np.concatenate([e + s for e, s in zip(ends, shift, strict=True)]).astype(np.int32), pack(words), pack(tokens.astype(np.uint32)),
        ]
        number += 1
        waiting[kind], size[kind] = [], 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = [part.split()[0] for part in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in text.chunks(batches):
        folds = np.array(batch.column("fold").to_pylist(), dtype=np.float64)  # null is nan
        kinds = np.select([np.isnan(folds) | (folds == HELD_OUT), folds == TUNING], [OTHER, TUNED], KEPT)
        for kind in waiting:
            at = np.flatnonzero(kinds == kind)
            if len(at):
                own = batch.take(pa.array(at))
                waiting[kind].append((own.column("doc_id").to_pylist(), (folds[at] == HELD_OUT).tolist(), *_token_hashes(own.column("text"))))
                size[kind] += own.column("text").nbytes
                if size[kind] >= BLOCK_BYTES:
                    yield block(kind)
    yield from (block(kind) for kind, own in waiting.items() if own)


def _keys(words: np.ndarray, tokens: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Per level (words, bigrams) the sorted distinct hashes of a block, where each token's stands in
    them, and how often each occurs. The context of a text's first token is the end before it."""
    line = np.concatenate([_END, words[tokens]])
    pairs, places, counts = np.unique(text.joined(line, 2), return_inverse=True, return_counts=True)
    return [words, pairs], [tokens, places], [np.bincount(tokens, minlength=len(words)), counts]


def _ask(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in text.rows_of(batch):
                keys, _, counts = _keys(unpack(row["words"], np.uint64), unpack(row["tokens"], np.uint32))
                for level in (0, 1):
                    edges = np.searchsorted(keys[level] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    full = np.flatnonzero(np.diff(edges))
                    spans = [(edges[b], edges[b + 1]) for b in full]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(full.astype(np.int32)), pa.array([row["block"]] * len(full), pa.int64()), pa.array([row["kind"]] * len(full), pa.int32()),
                        pa.array([level] * len(full), pa.int32()),
                        pa.array([pack(np.diff(keys[level][a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                        pa.array([_pack_counts(counts[level][a:b]) for a, b in spans], pa.binary()),
                    ], ["bucket", "block", "kind", "level", "keys", "counts"])
    return run


_ANSWERS = "block long, kind int, level int, bucket int, total binary, kept binary, types long, tokens long, kept_types long, kept_tokens long"


def _add_up(asked: pa.Table) -> pa.Table:
    """The counts of a bucket's words and bigrams over all blocks, for each block that asked; and a row
    without a block with the bucket's numbers of different words and of words."""
    rows, out = asked.to_pylist(), []
    for level in (0, 1):
        own = [r for r in rows if r["level"] == level]
        if not own:
            continue
        keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in own]
        counts = np.concatenate([unpack(r["counts"], np.uint64) for r in own])
        kinds = np.repeat([r["kind"] for r in own], [len(k) for k in keys])
        different, places = np.unique(np.concatenate(keys), return_inverse=True)
        kept = np.bincount(places, np.where(kinds == KEPT, counts, 0), len(different)).astype(np.int64)
        total = np.bincount(places, np.where(kinds != OTHER, counts, 0), len(different)).astype(np.int64)
        at = 0
        for r, k in zip(own, keys, strict=True):
            there = places[at:at + len(k)]
            at += len(k)
            out.append((r["block"], r["kind"], level, r["bucket"], _pack_counts(total[there]), _pack_counts(kept[there]) if r["kind"] == TUNED else None, None, None, None, None))
        if level == 0:
            out.append((None, None, None, own[0]["bucket"], None, None, int((total > 0).sum()), int(total.sum()), int((kept > 0).sum()), int(kept.sum())))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    names = [part.split()[0] for part in _ANSWERS.split(", ")]
    return pa.table([pa.array(column, kind) for column, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _answered(answers: list[dict], which: str) -> list[np.ndarray]:
    """The counts of a block's sorted words and bigrams, put together from its buckets."""
    return [
        np.concatenate([unpack(r[which], np.uint64) for r in sorted((r for r in answers if r["level"] == level), key=lambda r: r["bucket"])])
        for level in (0, 1)
    ]


def _estimates(block: dict, answers: list[dict], which: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a block the counts of its context, itself and its bigram."""
    tokens = unpack(block["tokens"], np.uint32)
    words, places = unpack(block["words"], np.uint64), _keys(unpack(block["words"], np.uint64), tokens)[1]
    single, pair = _answered(answers, which)
    own = single[places[0]]
    end = single[np.searchsorted(words, _END[0])]
    return np.concatenate([[end], own[:-1]]), own, pair[places[1]]


def bucket_of(contexts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one for each power of two."""
    return np.ceil(np.log2(contexts.astype(np.float64) + 1)).astype(np.int64)


def _shares(context: np.ndarray, own: np.ndarray, pair: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates of order 2 and 1."""
    return pair / np.maximum(context, 1), own / max(tokens, 1)


def _cell(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1)) * PER_OCTAVE), -1).astype(np.int64)


def _cell_value(cell: np.ndarray) -> np.ndarray:
    return np.where(cell >= 0, 2.0 ** (-cell / PER_OCTAVE), 0.0)


def _tuning_counts(tokens: int):
    """How many held-out tokens fall into each cell of context bucket and both estimates."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        found: dict[tuple, int] = {}
        replies = answers.to_pylist()
        for block in text.rows_of(blocks):
            context, own, pair = _estimates(block, replies, "kept")
            two, one = _shares(context, own, pair, tokens)
            cells, counts = np.unique(np.stack([bucket_of(context), _cell(two), _cell(one)]), axis=1, return_counts=True)
            for cell, n in zip(cells.T.tolist(), counts.tolist(), strict=True):
                found[tuple(cell)] = found.get(tuple(cell), 0) + n
        columns = list(zip(*((*cell, n) for cell, n in found.items()), strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["bucket", "two", "one", "n"])
    return run


def learn_weights(buckets: np.ndarray, estimates: np.ndarray, counts: np.ndarray, size: int = 65, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (size, orders) by expectation-maximisation: `estimates` (n, orders) of events
    seen `counts` times in a context bucket. A bucket without events gets the weights of all."""
    def solve(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        weights = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(rounds):
            parts = p * weights
            share = parts / parts.sum(axis=1, keepdims=True)
            weights = (share * n[:, None]).sum(axis=0) / n.sum()
        return weights

    orders = estimates.shape[1]
    whole = solve(estimates, counts) if len(counts) else np.eye(orders)[-1]
    out = np.tile(whole, (size, 1))
    for b in np.unique(buckets):
        own = buckets == b
        out[b] = solve(estimates[own], counts[own])
    return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(weights: np.ndarray, tokens: int, types: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out, replies = [], answers.to_pylist()
        for block in text.rows_of(blocks):
            context, own, pair = _estimates(block, replies, "total")
            two, one = _shares(context, own, pair, tokens)
            mix = weights[bucket_of(context)]
            # an unseen context has no estimate of order 2; its share goes to the others
            known = np.where(context > 0, 1.0, mix[:, 1] + mix[:, 2])
            p = (mix[:, 0] * two + mix[:, 1] * one + mix[:, 2] / (types + 1)) / np.where(known > 0, known, 1)
            base = np.log10((own.astype(np.float64) + 1) / (tokens + types + 1))
            ends = np.array(block["ends"])
            begins = np.concatenate([[0], ends[:-1]])
            sums = [np.add.reduceat(x, begins) for x in (own > 0, base, np.log10(p))]
            out.append(pa.table([
                pa.array(block["doc_ids"], pa.int64()), pa.array(block["held_out"], pa.bool_()), pa.array(ends - begins, pa.int64()),
                pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]),
            ], [part.split()[0] for part in _SCORES.split(", ")]))
        return pa.concat_tables(out)
    return run


def score(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id`; `held_out` (crc32 of the id's text leaves HELD_OUT of
    FOLDS); `n_tokens`, `n_known` (tokens seen in training); `train_tokens`; `base_score` (add-one
    unigrams); `score`, the model's log10 probability of the text.

    Training documents are those with an id that are not held out. A null or empty text is one end
    token. Rows without doc_id are scored but not learned from and not held out; rows that repeat each
    other count as often as they stand there. Other columns are ignored.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS).cast("int").alias("fold"),
    )
    blocks = cut(plain.mapInArrow(_gather, _BLOCKS))
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bits = max(LEAST_BUCKETS - 1, tokens // BUCKET_TOKENS).bit_length()
    asked = blocks.select("block", "kind", "words", "tokens").mapInArrow(
        _ask(bits), "bucket int, block long, kind int, level int, keys binary, counts binary"
    )
    answers = cut(asked.groupBy("bucket").applyInArrow(_add_up, _ANSWERS))
    sums = [F.coalesce(F.sum(name), F.lit(0)) for name in ("types", "tokens", "kept_types", "kept_tokens")]
    types, total, kept_types, kept = answers.filter("block is null").agg(*sums).first()
    replies = answers.filter("block is not null").select("block", "kind", "level", "bucket", "total", "kept")

    tuned = blocks.filter(F.col("kind") == TUNED).groupBy("block").cogroup(replies.filter(F.col("kind") == TUNED).drop("total").groupBy("block"))
    cells = tuned.applyInArrow(_tuning_counts(kept), "bucket long, two long, one long, n long").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))
    cells = cells.toPandas()  # bounded by the number of cells
    estimates = np.stack([_cell_value(cells["two"].to_numpy()), _cell_value(cells["one"].to_numpy()), np.full(len(cells), 1 / (kept_types + 1))], axis=1)
    weights = learn_weights(cells["bucket"].to_numpy(), estimates, cells["n"].to_numpy())

    scored = blocks.groupBy("block").cogroup(replies.drop("kept").groupBy("block")).applyInArrow(_score(weights, total, types), _SCORES)
    return scored.withColumn("train_tokens", F.lit(total).cast("long"))
