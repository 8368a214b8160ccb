"""Byte strings that stand twice in a corpus, found by a distributed difference-cover suffix sort of bounded depth.

A byte is removed if a string of `width` bytes that covers it also starts earlier. Sorting all suffixes would
bring equal strings together; this does it for few of them and in the order of hashes, as any order keeps equal
strings next to each other:

1. **Sampled tuples.** A position is sampled if its place in the document, modulo V, is in a difference cover. Any
   two positions have a common distance below V behind which both are sampled, so two equal strings hold equal
   tuples of `width` - V + 1 bytes at sampled places. The tuples are sorted and named; a name that is met once
   proves that no string around it repeats, and its suffixes are not sorted any further.
2. **Recursion on names.** For the sampled places left over, the triples of names at distance V are sorted and named.
   A triple spans every string that reaches its middle, so all strings at a place whose triple is met earlier are
   repeats, and places of a tuple whose triples are all alike are settled.
3. **Remaining suffixes.** Strings near the edges of matches, where one tuple has several triples and none decides,
   are sorted themselves and merged, and neighbours are compared over all `width` bytes (96 bits of two hashes).

Texts lie in blocks, a table that is written once and bucketed by block, so it is never shuffled. Each of the
steps asks about the distinct names of a stretch of a block; hash buckets sort them and answer which are met
elsewhere or earlier. A passage that stands everywhere is one entry a stretch, so no task is hot. Copies of whole
texts are settled by digests before anything is sampled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from storkline.llm import text
from storkline.llm.interpolation import pack, unpack
from storkline.session import cut, cut_by

#: perfect difference covers: every distance modulo V is the difference of just one pair
COVERS = {3: (1, 2), 7: (1, 2, 4), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}
#: bytes of text in a stretch, which is worked on at once, and in a block
STRETCH_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
#: about as many names in a bucket
BUCKET_NAMES = 1 << 20
#: bits of a name beyond those that count the sampled places; fewer only let more places pass the first step
SPARE_BITS = 10
STEPS = 4  # whole texts, tuples, triples, strings
_HASHED = 1 << 20  # bytes hashed at once
_ODD = text.mix(np.arange(7001, 7006, dtype=np.uint64)) | np.uint64(1)
_LAST = np.iinfo(np.int64).max

_BLOCKS = "block long, stretch int, doc_ids array<long>, ends binary, digests binary, data binary"
_ASKED = "block long, stretch int, bucket long, n int, names binary, more binary, docs binary, note binary, marks binary, runs binary"
_ANSWERS = "block long, stretch int, bucket long, n int, again binary, mixed binary, note binary, marks binary, runs binary"
_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
_ZSTD = pa.Codec("zstd", 1)


def period(width: int) -> int:
    """The longest period whose names, V apart, leave no gap and lie within `width` bytes."""
    fitting = [v for v in COVERS if 2 * v - 1 <= width]
    if not fitting:
        raise ValueError(f"width is at least {2 * min(COVERS) - 1}")
    return max(fitting)


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [part.split() for part in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _squeeze(values: np.ndarray) -> bytes:
    return _ZSTD.compress(pack(values.astype(np.uint64)), asbytes=True) if len(values) else b""


def _expand(squeezed: bytes, n: int) -> np.ndarray:
    return unpack(_ZSTD.decompress(squeezed, 8 * n, asbytes=True), np.uint64) if n else np.zeros(0, np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return _ZSTD.compress(np.packbits(flags).tobytes(), asbytes=True) if len(flags) else b""


def _flags(squeezed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, bool)
    return np.unpackbits(np.frombuffer(_ZSTD.decompress(squeezed, (n + 7) // 8, asbytes=True), np.uint8), count=n).astype(bool)


def _gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches with their texts in the order of doc_id, rows without one last."""
    block, stretch, in_block = TaskContext.get().partitionId() << 32, 0, 0
    ids: list = []
    texts: list[bytes] = []
    size = 0

    def put() -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        own = [texts[i] for i in order]
        row = (
            block, stretch, [ids[i] for i in order], np.cumsum([len(t) for t in own], dtype=np.int64).tobytes(),
            b"".join(hashlib.sha256(t).digest()[:16] for t in own), b"".join(own),
        )
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [part.split()[0] for part in _BLOCKS.split(", ")])

    for batch in text.chunks(batches, limit=STRETCH_BYTES):
        data, offsets = text.raw(batch.column("text"))
        bounds = offsets.tolist()
        ids += batch.column("doc_id").to_pylist()
        texts += [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        size += len(data)
        if size >= STRETCH_BYTES:
            yield put()
            stretch, in_block = stretch + 1, in_block + size
            ids, texts, size = [], [], 0
            if in_block >= BLOCK_BYTES:
                block, stretch, in_block = block + 1, 0, 0
    if ids:
        yield put()


class _Stretch:
    """The texts of a stretch, and what is known of them so far."""

    def __init__(self, row: dict, width: int) -> None:
        self.block, self.stretch, self.width, self.v = row["block"].as_py(), row["stretch"].as_py(), width, period(width)
        self.ids = row["doc_ids"].as_py()
        self.order = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        self.ends = np.frombuffer(row["ends"].as_buffer(), np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]])
        self.digests = np.frombuffer(row["digests"].as_buffer(), ">u8").astype(np.uint64).reshape(-1, 2)
        self.data = np.frombuffer(row["data"].as_buffer(), np.uint8)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def hashes(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of strings of at most `width` bytes, by ascending starts."""
        out = np.zeros(len(starts), np.uint64)
        for begin in range(0, len(self.data), _HASHED):
            a, b = np.searchsorted(starts, (begin, begin + _HASHED))
            if a < b:
                own = starts[a:b] - begin
                out[a:b] = text.hashes(self.data[begin:begin + _HASHED + self.width], own, own + sizes[a:b])
        return out

    def whole_texts(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of texts by digest, and which differ from the one before."""
        order = np.lexsort((np.arange(len(self.ids)), self.digests[:, 1], self.digests[:, 0]))
        own = self.digests[order]
        return order, np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])

    def copies(self, again: np.ndarray) -> np.ndarray:
        """Which texts stand earlier as a whole, given which of the distinct digests do."""
        order, new = self.whole_texts()
        out = np.zeros(len(self.ids), bool)
        out[order] = ~new | again[np.cumsum(new) - 1]
        return out

    def sampled(self, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sampled places outside the texts to skip, and the names of their tuples."""
        size = self.width - self.v + 1
        room = np.where(skip, -1, self.ends - self.begins - size)
        places = []
        for d in COVERS[self.v]:
            n = np.where(room >= d, (room - d) // self.v + 1, 0)
            ends = np.cumsum(n)
            places.append(np.repeat(self.begins + d, n) + self.v * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)))
        at = np.sort(np.concatenate(places))
        return at, self.hashes(at, np.full(len(at), size))

    def triples(self, at: np.ndarray, names: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Names of the triples around some sampled places. Where a neighbour's tuple would leave the text, the bytes
        up to the text's edge stand for it."""
        own, size = at[which], self.width - self.v + 1
        document = self.document(own)
        begin, end = self.begins[document], self.ends[document]
        left, right = (names[np.minimum(np.searchsorted(at, own + step), len(at) - 1)] for step in (-self.v, self.v))
        short = own - begin < self.v
        left[short] = text.mix(self.hashes(begin[short], (own - begin)[short]) + _ODD[3])
        short = own + self.v + size > end
        right[short] = text.mix(self.hashes((own + self.v)[short], (end - own - self.v)[short]) + _ODD[4])
        return text.mix(left * _ODD[0] + names[which] * _ODD[1] + right * _ODD[2])

    def strings(self, places: np.ndarray) -> np.ndarray:
        """For each byte, whether a string that begins there reaches one of the sampled places and fits its text."""
        document = self.document(places)
        first = np.maximum(places - self.v + 1, self.begins[document])
        last = np.minimum(places, self.ends[document] - self.width)
        held = first <= last
        steps = np.bincount(first[held], minlength=len(self.data) + 1) - np.bincount(last[held] + 1, minlength=len(self.data) + 1)
        return np.cumsum(steps)[:-1] > 0

    def ask(self, names: np.ndarray, bits: int, spread: int, more: np.ndarray | None = None, docs: np.ndarray | None = None) -> list[tuple]:
        """Rows that ask the buckets about sorted distinct names of so many bits; a bucket is the first `spread`."""
        edges = np.searchsorted(names >> np.uint64(bits - spread), np.arange((1 << spread) + 1, dtype=np.uint64))
        return [
            (self.block, self.stretch, int(k), int(b - a), _squeeze(np.diff(names[a:b], prepend=np.uint64(0))), None if more is None else _squeeze(more[a:b]),
             None if docs is None else _squeeze(docs[a:b].astype(np.uint64)), None, None, None)
            for k in np.flatnonzero(np.diff(edges)) for a, b in [(edges[k], edges[k + 1])]
        ]

    def note(self, places: np.ndarray, new: np.ndarray, runs: np.ndarray | None = None) -> tuple:
        """A row that the stretch gets back as it is: places in the order of names, and where a new name begins."""
        return (
            self.block, self.stretch, -1 - (self.block + self.stretch), len(places), None, None, None, _squeeze(places), _bits(new),
            None if runs is None else runs.astype(np.int64).tobytes(),
        )


def _settle(asked: pa.Table) -> pa.Table:
    """Answers of a bucket. `again`: another stretch has the name (and `more`) in an earlier document, or, among
    rows that ask without documents, anywhere. `mixed`: the name has several `more`."""
    rows = asked.to_pylist()
    out = [(r["block"], r["stretch"], r["bucket"], r["n"], None, None, r["note"], r["marks"], r["runs"]) for r in rows if r["names"] is None]
    own = sorted((r for r in rows if r["names"] is not None), key=lambda r: (r["block"], r["stretch"]))
    if own:
        sizes = [r["n"] for r in own]
        names = np.concatenate([np.cumsum(_expand(r["names"], r["n"]), dtype=np.uint64) for r in own])
        again, mixed = np.zeros(len(names), bool), np.zeros(len(names), bool)
        if own[0]["docs"] is None:
            order = np.argsort(names)
            same = names[order][1:] == names[order][:-1]
            again[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        else:
            docs = np.concatenate([_expand(r["docs"], r["n"]) for r in own])
            more = np.concatenate([_expand(r["more"], r["n"]) for r in own])
            order = np.lexsort((docs, more, names))  # stable: the earlier stretch first
            new = np.concatenate([[True], names[order][1:] != names[order][:-1]])
            other = new | np.concatenate([[True], more[order][1:] != more[order][:-1]])
            again[order] = ~other
            of_name = np.cumsum(new) - 1
            mixed[order] = (np.bincount(of_name, other) > 1)[of_name]
        ends = np.cumsum([0, *sizes])
        out += [
            (r["block"], r["stretch"], r["bucket"], r["n"], _bits(again[a:b]), _bits(mixed[a:b]), None, None, None)
            for r, a, b in zip(own, ends[:-1], ends[1:], strict=True)
        ]
    return _table(_ANSWERS, out)


class _Replies:
    """What the buckets answered to a stretch in one step."""

    def __init__(self, rows: list[dict]) -> None:
        own = sorted((r for r in rows if r["again"] is not None), key=lambda r: r["bucket"])
        self.again, self.mixed = (np.concatenate([*(_flags(r[c], r["n"]) for r in own), np.zeros(0, bool)]) for c in ("again", "mixed"))
        self.places, self.new, self.runs = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros((0, 2), np.int64)
        for r in rows:
            if r["note"] is not None:
                self.places, self.new = _expand(r["note"], r["n"]).astype(np.int64), _flags(r["marks"], r["n"])
                if r["runs"] is not None:
                    self.runs = np.frombuffer(r["runs"], np.int64).reshape(-1, 2)
        self.name = np.cumsum(self.new) - 1  # of each place
        #: places whose name is met earlier, in this stretch or another
        self.repeated = self.places[~self.new | self.again[self.name]] if len(self.places) else self.places


def _per_stretch(width: int, step: Callable[[_Stretch, dict[int, _Replies]], list[tuple] | pa.Table], schema: pa.Schema | None = None):
    """Run a step on each stretch of a block with the answers it got, by the number of the step that asked."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        replies: dict[tuple, list] = {}
        for r in answers.to_pylist():
            replies.setdefault((r["stretch"], r["step"]), []).append(r)
        out = []
        for i in range(block.num_rows):
            own = _Stretch({c: block.column(c)[i] for c in block.column_names}, width)
            out.append(step(own, {s: _Replies(replies.get((own.stretch, s), [])) for s in range(STEPS)}))
        return pa.concat_tables(out) if schema else _table(_ASKED, [row for rows in out for row in rows])
    return run


def _ask_texts(width: int, spread: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = _Stretch({c: batch.column(c)[i] for c in batch.schema.names}, width)
                order, new = own.whole_texts()
                first = order[new]
                rows = own.ask(own.digests[first, 0], 64, spread, own.digests[first, 1], own.order[first])
                yield from _table(_ASKED, rows).to_batches()
    return run


def _ask_tuples(bits: int, spread: int):
    def step(own: _Stretch, replies: dict[int, _Replies]) -> list[tuple]:
        _, names = own.sampled(own.copies(replies[0].again))
        return own.ask(np.unique(names >> np.uint64(64 - bits)), bits, spread)
    return step


def _ask_triples(bits: int, spread: int):
    def step(own: _Stretch, replies: dict[int, _Replies]) -> list[tuple]:
        at, names = own.sampled(own.copies(replies[0].again))
        _, inverse, counts = np.unique(names >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        which = np.flatnonzero((replies[1].again | (counts > 1))[inverse])
        triples = own.triples(at, names, which)
        places, tuples = at[which], names[which] >> np.uint64(64 - bits)
        order = np.lexsort((places, triples, tuples))
        places, triples, tuples = places[order], triples[order], tuples[order]
        new = np.ones(len(order), bool)
        new[1:] = (tuples[1:] != tuples[:-1]) | (triples[1:] != triples[:-1])
        asked = own.ask(tuples[new], bits, spread, triples[new], own.order[own.document(places[new])])
        return [*asked, own.note(places, new)]
    return step


def _ask_strings(spread: int):
    def step(own: _Stretch, replies: dict[int, _Replies]) -> list[tuple]:
        last = replies[2]
        settled = own.strings(last.repeated)
        open_ = own.strings(last.places[last.mixed[last.name]] if len(last.places) else last.places) & ~settled
        at, half = np.flatnonzero(open_), own.width // 2
        whole, low, high = (own.hashes(at + a, np.full(len(at), b - a)) for a, b in ((0, own.width), (0, half), (half, own.width)))
        more = text.mix(low * _ODD[0] + high) >> np.uint64(32)
        order = np.lexsort((at, more, whole))
        at, whole, more = at[order], whole[order], more[order]
        new = np.ones(len(order), bool)
        new[1:] = (whole[1:] != whole[:-1]) | (more[1:] != more[:-1])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], settled, [False]]).astype(np.int8)))
        asked = own.ask(whole[new], 64, spread, more[new], own.order[own.document(at[new])])
        return [*asked, own.note(at, new, edges)]
    return step


def _remove(own: _Stretch, replies: dict[int, _Replies]) -> pa.Table:
    n, width = len(own.data), own.width
    steps = np.zeros(n + 1, np.int32)
    runs = replies[3].runs
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, runs[:, 1] - 1 + width, -1)
    np.add.at(steps, replies[3].repeated, 1)
    np.add.at(steps, replies[3].repeated + width, -1)
    whole = own.copies(replies[0].again) & (own.ends - own.begins >= width)
    np.add.at(steps, own.begins[whole], 1)
    np.add.at(steps, own.ends[whole], -1)
    gone = np.cumsum(steps)[:-1] > 0
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1]
    last[:-1] &= ~gone[1:]
    full = own.begins < own.ends
    heads, tails = own.begins[full], own.ends[full] - 1
    first[heads], last[tails] = gone[heads], gone[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, np.concatenate([own.begins, [n]]))
    owner = own.document(starts)
    spans = pa.StructArray.from_arrays([pa.array(starts - own.begins[owner], pa.int64()), pa.array(ends - own.begins[owner], pa.int64())], ["start", "end"])
    before = np.concatenate([[0], np.cumsum(gone)])
    removed = before[own.ends] - before[own.begins]
    offsets = np.concatenate([[0], own.ends - before[own.ends]])
    kept = own.data[~gone]
    return pa.table([
        pa.array(own.ids, pa.int64()), pa.array(own.ends - own.begins, pa.int64()), pa.array(removed, pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
        pa.Array.from_buffers(pa.binary(), len(own.ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)]),
    ], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """One row per row of `docs`: `doc_id`; `n_bytes` of the UTF-8 text; `n_removed`, the bytes covered by a string of
    `width` bytes that also starts earlier (in a smaller doc_id, or earlier in the same text); `spans`, the maximal
    runs of them in bytes, end exclusive; `kept`, the other bytes.

    Strings do not cross documents and are judged on the texts as they are. A null text is empty. Rows without doc_id
    come after all others; of rows that share an id, or have none, either may count as the earlier one. Other columns
    are ignored. Memory is needed in proportion to the longest text, not to how often anything repeats.
    """
    v = period(width)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = cut_by(plain.mapInArrow(_gather, _BLOCKS), "block", max(1, math.ceil(size / BLOCK_BYTES)))
    sampled = size * len(COVERS[v]) // v + 2
    spread = max(0, math.ceil(sampled / BUCKET_NAMES) - 1).bit_length()
    bits = min(64, max(24, spread, sampled.bit_length() + SPARE_BITS))

    def settled(asked: DataFrame, step: int) -> DataFrame:
        return cut(asked.groupBy("bucket").applyInArrow(_settle, _ANSWERS)).withColumn("step", F.lit(step))

    def met(answers: DataFrame, step, schema: str = _ASKED, kind: pa.Schema | None = None) -> DataFrame:
        own = answers.withColumnRenamed("block", "asker")
        return blocks.groupBy("block").cogroup(own.groupBy("asker")).applyInArrow(_per_stretch(width, step, kind), schema)

    texts = settled(blocks.drop("data").withColumn("data", F.lit(b"")).mapInArrow(_ask_texts(width, min(spread, 6)), _ASKED), 0)
    tuples = settled(met(texts, _ask_tuples(bits, spread)), 1)
    triples = settled(met(texts.unionByName(tuples), _ask_triples(bits, max(0, spread - 1))), 2)
    strings = settled(met(triples, _ask_strings(max(0, spread - 1))), 3)
    return met(texts.unionByName(strings), _remove, _OUT, True)
