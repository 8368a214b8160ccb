"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by A (byte-level BPE) and by B (SentencePiece); where tokens of both end at the same byte,
a group ends. An A and a B token are linked where their bytes overlap, and a pair of ids counts as often as it
is linked in all texts.

An array made once from both vocabularies gives for an A id the B id of the same bytes. Groups of one A and one
B token that it pairs are added to a vector as long as A's vocabulary, one per task; only the pairs of other
groups are sent by pair. Texts are worked on in blocks. A block holds every pair once, so a frequent pair is an
entry a block and no task is hot; the totals come back to the block, where the texts' sums are formed.

No token of either side crosses certain bounds between words, so texts are cut there into segments, and each
segment of a block is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from storkline.llm import text
from storkline.session import cut, small_batches

MARK = "▁"
BLOCK_BYTES = 4 << 20
#: segments a worker remembers, from block to block, and characters of them and of their groups; beyond that it starts anew
REMEMBERED = 100_000
REMEMBERED_CHARACTERS = 8_000_000
#: segments of texts that stand in memory one by one, to be numbered
IN_TURN = 50_000
#: new segments encoded in one call
AT_ONCE = 4_000
_BYTE = 6  # the type of a piece that stands for one byte

#: a segment begins at a space or line feed behind a character that is no white space
_SEGMENT = re.compile(r"\s*+\S++(?:[^\S \n]\s*+\S++)*+(?:[^\S \n]\s*+\Z)?|\s++\Z")

_BLOCKS = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "ends array<long>, places binary, exact binary, exact_ends binary, others binary, other_ends binary, pairs array<long>, counts array<long>, "
    "vector array<long>"
)
_KINDS = {
    "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "binary": pa.binary(),
}
#: a row of a block takes megabytes; a writer looks at their size after 100 rows at first, and a row group is held as a whole, by
#: its reader too
_ROW_GROUPS = {"parquet.block.row.count.limit": "2"}
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _record(schema: str, columns: list[list]) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write a byte that prints as itself, and the others, in order, as the characters from
    256 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """The files of both tokenizers and the bytes of their tokens by id."""

    a_file: str
    b_file: bytes
    a_tokens: list[bytes]
    b_tokens: list[bytes]
    #: whether some piece holds a line feed, or a space after another character
    crossing: bool

    def digest(self) -> str:
        return hashlib.sha256(self.a_file.encode() + self.b_file).hexdigest()

    def same_bytes(self) -> np.ndarray:
        """For each A id the B id of the same bytes, or -1. A piece goes before the byte it stands for."""
        known: dict[bytes, int] = {}
        for i, token in enumerate(self.b_tokens):
            known[token] = i  # pieces follow the bytes
        return np.array([known.get(token, -1) if token else -1 for token in self.a_tokens], np.int64)


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """A byte-level BPE tokenizer file and a SentencePiece model that leaves characters as they are; others raise a
    ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(a_path, encoding="utf-8") as file:
        a_file = file.read()
    described = json.loads(a_file)
    before = described.get("pre_tokenizer") or {}
    if described.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        raise ValueError(f"{a_path} is not a plain byte-level vocabulary")
    names = described["model"]["vocab"]
    of_character = _byte_characters()
    a_tokens = [b""] * (max(names.values()) + 1)
    for name, i in names.items():
        a_tokens[i] = bytes(of_character[c] for c in name) if all(c in of_character for c in name) else b""

    with open(b_path, "rb") as file:
        b_file = file.read()
    model = schema.ModelProto.FromString(b_file)
    rules = model.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError(f"{b_path} rewrites characters or spaces")
    b_tokens = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
    crossing = any(p.type != _BYTE and ("\n" in p.piece or MARK in p.piece.lstrip(MARK)) for p in model.pieces)
    return Vocabularies(a_file, b_file, a_tokens, b_tokens, crossing)


def _grow(flat: np.ndarray, bounds: np.ndarray, added: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists in one array and their bounds, with further entries and sizes of lists."""
    sizes = np.concatenate([np.diff(bounds), *(own for _, own in added)])
    return np.concatenate([flat, *(own for own, _ in added)]), np.concatenate([[0], np.cumsum(sizes)])


def _take(flat: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some lists, and their bounds."""
    sizes = bounds[which + 1] - bounds[which]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(bounds[which] - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Aligner:
    """Segments by number: their tokens, groups and links. `pair` codes are A id * width + B id."""

    def __init__(self, vocabularies: Vocabularies) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.vocabularies = vocabularies
        self.a = Tokenizer.from_str(vocabularies.a_file)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b_file)
        self.same = vocabularies.same_bytes()
        self.width = len(vocabularies.b_tokens)
        self.a_sizes = np.array([len(t) for t in vocabularies.a_tokens], np.int64)
        self.b_sizes = np.array([len(t) for t in vocabularies.b_tokens], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_sizes), self.width))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.characters = 0
        self.words: list[str] = []  # the groups, written out
        self.fit = np.zeros(0, bool)
        self.n_a, self.n_b, self.n_groups = (np.zeros(0, np.int64) for _ in range(3))
        self.exact_flat, self.exact_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.other_flat, self.other_bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.fits, self.counts, self.exact, self.others = [], [], [], []  # added since

    def segments(self, t: str) -> list[str]:
        return [" " + t] if self.vocabularies.crossing else _SEGMENT.findall(" " + t)

    def _parts(self, t: str) -> Iterator[list[str]]:
        """The segments of a text, those of a long one in parts."""
        if len(t) <= IN_TURN or self.vocabularies.crossing:
            yield self.segments(t)
            return
        found = (m[0] for m in _SEGMENT.finditer(" " + t))
        while part := list(islice(found, IN_TURN)):
            yield part

    def _side(self, ids: list[int], head: int, tokens: list[bytes], sizes: np.ndarray, whole: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of segments that lie one after the other, and their bounds; None if the tokens do not give the
        bytes back or do not end where segments end."""
        own = ids[head:]
        if b"".join([tokens[i] for i in own]) != whole:
            return None
        flat = np.array(own, np.int64)
        at = np.concatenate([[0], np.cumsum(sizes[flat])])
        bounds = np.searchsorted(at, ends)
        return (flat, bounds) if len(at) and (at[np.minimum(bounds, len(at) - 1)] == ends).all() else None

    def tokens(self, segments: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None:
        """The ids of both sides of segments that may lie one after the other in a text. B puts a mark in front, and
        nothing joins a line feed to what follows, so behind a line feed stand the ids that the segments have inside
        a text, after some that go."""
        glued = "".join(segments)
        whole, ends = glued.encode(), np.cumsum([0, *(len(s.encode()) for s in segments)])
        a, of_a = self.a.encode(glued, add_special_tokens=False).ids, self.vocabularies.a_tokens
        if self.vocabularies.crossing:
            head, b = 0, self.b.encode(glued[1:])
        else:
            head, b = len(self.b.encode("\n")), self.b.encode("\n" + glued)
        sides = self._side(a, 0, of_a, self.a_sizes, whole, ends), self._side(b, head, self.vocabularies.b_tokens, self.b_sizes, whole, ends)
        return sides if None not in sides else None

    def learn(self, new: list[str]) -> None:
        """Add segments that are not known yet. A segment that ends in white space is the last of its text and is
        encoded by itself; segments that do not come back byte for byte are found by halving."""
        glued, alone = [], []
        for s in new:
            (alone if s[-1].isspace() or self.vocabularies.crossing else glued).append(s)
        waiting = [[s] for s in alone] + [glued[at:at + AT_ONCE] for at in range(0, len(glued), AT_ONCE)]
        while waiting:
            part = waiting.pop()
            both = self.tokens(part)
            if both is None and len(part) > 1:
                waiting += [part[:len(part) // 2], part[len(part) // 2:]]
            else:
                self._add(part, *(both or ((np.zeros(0, np.int64), np.zeros(2, np.int64)),) * 2), fits=both is not None)

    def _add(self, new: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], fits: bool = True) -> None:
        (a_ids, a_bounds), (b_ids, b_bounds) = a, b
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        # between two neighbouring ends of either side lies one link, between two common ends one group
        every, common = np.union1d(a_ends, b_ends), np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_at, b_at, group = (np.searchsorted(ends, every) for ends in (a_ends, b_ends, common))
        a_link, b_link = a_ids[a_at], b_ids[b_at]
        exact = (np.bincount(group, minlength=len(common)) == 1)[group] & (self.same[a_link] == b_link)
        full = np.concatenate([[0], a_ends])[a_bounds]  # the byte where each segment ends
        link_bounds, group_bounds = np.searchsorted(every, full, "right"), np.searchsorted(common, full, "right")
        exact_before = np.concatenate([[0], np.cumsum(exact)])[link_bounds]
        self.fits.append(np.full(len(new), fits))
        self.counts.append(np.stack([np.diff(a_bounds), np.diff(b_bounds), np.diff(group_bounds)]))
        self.exact.append((a_link[exact], np.diff(exact_before)))
        self.others.append(((a_link * self.width + b_link)[~exact], np.diff(link_bounds - exact_before)))
        a_cuts, b_cuts = (np.searchsorted(ends, common, "right").tolist() for ends in (a_ends, b_ends))
        a_names, b_names = [self.names[i] for i in a_ids.tolist()], [self.names[i] for i in b_ids.tolist()]
        parts, i, j = [], 0, 0
        for i_end, j_end in zip(a_cuts, b_cuts, strict=True):
            left = a_names[i] if i_end - i == 1 else ",".join(a_names[i:i_end])
            right = b_names[j] if j_end - j == 1 else ",".join(b_names[j:j_end])
            parts.append(f"{left}|{right}")
            i, j = i_end, j_end
        bounds = group_bounds.tolist()
        words = [";".join(parts[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        self.words += words
        self.characters += sum(map(len, words)) + sum(map(len, new))
        for s in new:
            self.known[s] = len(self.known)

    def settle(self) -> None:
        """Put what was added into the arrays by segment."""
        if self.fits:
            self.fit = np.concatenate([self.fit, *self.fits])
            self.n_a, self.n_b, self.n_groups = np.concatenate([np.stack([self.n_a, self.n_b, self.n_groups]), *self.counts], axis=1)
            self.exact_flat, self.exact_bounds = _grow(self.exact_flat, self.exact_bounds, self.exact)
            self.other_flat, self.other_bounds = _grow(self.other_flat, self.other_bounds, self.others)
            self.fits, self.counts, self.exact, self.others = [], [], [], []

    def _number(self, parts: list[list[str]]) -> list[np.ndarray]:
        known = self.known
        self.learn([s for s in dict.fromkeys(s for own in parts for s in own) if s not in known])
        return [np.fromiter(map(known.__getitem__, own), np.int32, len(own)) for own in parts]

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The segments of each text by number; a text whose bytes one side does not give back has none."""
        if len(self.known) > REMEMBERED or self.characters > REMEMBERED_CHARACTERS:
            self.forget()
        found: list[list[np.ndarray]] = [[] for _ in texts]
        owners, parts, size = [], [], 0
        for i, t in enumerate(texts):
            for part in self._parts(t) if t else ():
                owners.append(i)
                parts.append(part)
                size += len(part)
                if size >= IN_TURN:
                    for k, own in zip(owners, self._number(parts), strict=True):
                        found[k].append(own)
                    owners, parts, size = [], [], 0
        for k, own in zip(owners, self._number(parts), strict=True):
            found[k].append(own)
        self.settle()
        whole = [np.concatenate(own) if own else np.zeros(0, np.int32) for own in found]
        return [own if self.fit[own].all() else own[:0] for own in whole]


_aligners: dict[str, Aligner] = {}


def _aligner(vocabularies, digest: str) -> Aligner:
    """The aligner of two vocabularies in this worker, kept for the worker's next task."""
    if digest not in _aligners:
        _aligners.clear()
        _aligners[digest] = Aligner(vocabularies.value)
    return _aligners[digest]


def _small(values: np.ndarray) -> bytes:
    return values.astype(np.uint32).tobytes()


def _large(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.uint32).astype(np.int64)


def _block(aligner: Aligner, number: int, ids: list, texts: list[str], vector: np.ndarray) -> pa.RecordBatch:
    """A row for a block: its texts, its segments' links, and its pairs once each; exact groups go to `vector`."""
    found = aligner.numbers(texts)
    ends = np.cumsum([0, *map(len, found)])
    every = np.concatenate(found)
    often = np.bincount(every, minlength=len(aligner.fit))
    own = np.flatnonzero(often)
    places, often = (np.cumsum(often > 0) - 1)[every], often[own]
    exact, exact_ends = _take(aligner.exact_flat, aligner.exact_bounds, own)
    others, other_ends = _take(aligner.other_flat, aligner.other_bounds, own)
    vector += np.bincount(exact, np.repeat(often, np.diff(exact_ends)), len(vector)).astype(np.int64)
    pairs, pair_at = np.unique(others, return_inverse=True)
    counts = np.bincount(pair_at, np.repeat(often, np.diff(other_ends)), len(pairs)).astype(np.int64)

    def sums(of_segment: np.ndarray) -> list[int]:
        before = np.concatenate([[0], np.cumsum(of_segment[own][places])])
        return np.diff(before[ends]).tolist()

    n_links = np.diff(aligner.exact_bounds) + np.diff(aligner.other_bounds)
    words = aligner.words
    digests = [hashlib.sha256(";".join([words[i] for i in x.tolist()]).encode()).hexdigest() if len(x) else "" for x in found]
    return _record(_BLOCKS, [[x] for x in (
        number, ids, sums(aligner.n_a), sums(aligner.n_b), sums(aligner.n_groups), sums(n_links), digests, ends[1:].tolist(),
        _small(places), _small(exact), _small(exact_ends), _small(pair_at), _small(other_ends), pairs, counts, None,
    )])


def _gather(vocabularies, digest: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabularies, digest)
        number = TaskContext.get().partitionId() << 32
        vector = np.zeros(len(aligner.same), np.int64)
        ids, texts, size = [], [], 0
        for batch in text.chunks(batches, limit=BLOCK_BYTES // 8):
            ids += batch.column("doc_id").to_pylist()
            texts += [t or "" for t in batch.column("text").to_pylist()]
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                yield _block(aligner, number, ids, texts, vector)
                number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield _block(aligner, number, ids, texts, vector)
        yield _record(_BLOCKS, [[None] for _ in range(15)] + [[vector]])
        text.let_go()
    return run


def _sum_up(exact_totals, exact_best):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        _aligners.clear()  # what the worker remembers from numbering segments is not needed any more
        totals, best = exact_totals.value, exact_best.value
        out = []
        order = np.argsort(answers.column("place").to_numpy())
        pair_totals, pair_best = (answers.column(c).to_numpy()[order].astype(np.int64) for c in ("total", "best"))
        for i in range(blocks.num_rows):
            block = {c: blocks.column(c)[i] for c in blocks.column_names}
            places, exact, exact_ends, others, other_ends = (
                _large(block[c].as_buffer()) for c in ("places", "exact", "exact_ends", "others", "other_ends")
            )
            ends = np.concatenate([[0], block["ends"].values.to_numpy()])
            sums = []
            for of_exact, of_pair in ((best, pair_best), (totals, pair_totals)):
                own = np.diff(np.concatenate([[0], np.cumsum(of_exact[exact])])[exact_ends])
                own += np.diff(np.concatenate([[0], np.cumsum(of_pair[others])])[other_ends])
                sums.append(np.diff(np.concatenate([[0], np.cumsum(own[places])])[ends]))
            out.append(pa.table(
                [block[c].values for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")] + [pa.array(s, pa.int64()) for s in sums] + [block["digests"].values],
                [part.split()[0] for part in _OUT.split(", ")],
            ))
        return pa.concat_tables(out)
    return run


def align(docs: DataFrame, vocabularies: Vocabularies) -> tuple[DataFrame, DataFrame]:
    """Two frames. Per row of `docs`: `doc_id`; `n_a`, `n_b`, the tokens of each side; `n_groups`; `n_links`; `n_best`,
    its links whose pair counts as often as any pair of the same B id, ties included; `count_sum`, the counts of its
    links' pairs; `groups_sha256` of the groups written as `a1,a2|b1;a3|b2,b3`. And per pair of ids that is linked
    anywhere: `a`, `b`, `total` (its count), `best`.

    A text that is null or empty, or that one side does not give back byte for byte (with a space in front), has no
    tokens: zeros and an empty string. Rows without doc_id and rows that repeat each other count like any other; other
    columns are ignored. A stretch of text without a space or line feed is encoded as a whole, in memory in
    proportion to it.
    """
    spark, width = docs.sparkSession, len(vocabularies.b_tokens)
    shared = spark.sparkContext.broadcast(vocabularies)  # vocabularies have a fixed size
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with small_batches(spark):
        blocks = cut(plain.mapInArrow(_gather(shared, vocabularies.digest()), _BLOCKS), **_ROW_GROUPS)
    asked = blocks.filter("block is not null").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "own"))
    irregular = asked.groupBy(F.col("own.pairs").alias("pair")).agg(F.sum("own.counts").alias("n"))
    same = vocabularies.same_bytes()
    vectors = blocks.filter("block is null").select(F.posexplode("vector").alias("a", "n")).filter("n > 0")
    # as many rows as A has tokens at most
    exact = [(a * width + int(same[a]), n) for a, n in vectors.groupBy("a").agg(F.sum("n").alias("n")).collect()]
    pairs = irregular.unionByName(spark.createDataFrame(exact, "pair long, n long")).groupBy("pair").agg(F.sum("n").alias("total"))
    pairs = pairs.select("pair", "total", (F.col("pair") % width).alias("b"))
    pairs = pairs.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))  # a B id has as many pairs as A has tokens at most
    totals = cut(pairs.select("pair", F.expr(f"pair div {width}").alias("a"), "b", "total", "best"))

    of_exact, best_of_exact = (np.zeros(len(same), np.int64) for _ in range(2))
    regular = totals.join(spark.createDataFrame([(p,) for p, _ in exact], "pair long"), "pair", "left_semi")
    for r in regular.collect():  # as many rows as A has tokens at most
        of_exact[r.a], best_of_exact[r.a] = r.total, r.best
    answers = asked.select(F.col("block").alias("asker"), "place", F.col("own.pairs").alias("pair")).join(totals.select("pair", "total", "best"), "pair").drop("pair")
    sent = spark.sparkContext.broadcast(of_exact), spark.sparkContext.broadcast(best_of_exact)
    kept = blocks.filter("block is not null").drop("pairs", "counts", "vector")
    rows = kept.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(_sum_up(*sent), _OUT)
    return rows, totals.select("a", "b", "total", "best")
