"""SentencePiece encoding and decoding of whole texts with a given vocabulary.

A text is marked (a space becomes the word mark, one stands in front) and cut into marked words, which
no piece crosses. The distinct words of a batch are sorted, which lays them out as a trie in depth-first
order: of each word only the forward states behind the prefix that it shares with the word before are
computed. A forward state is the best way to cut the prefix up to a character: its score and last piece.

For a unigram vocabulary the score is the sum of the pieces' scores. A merge (BPE) vocabulary allows a
piece only after one that merging would leave next to it: a cut is the result of merging exactly if
this holds for each two neighbours, so every prefix has one cut of score 0 and all others are excluded.
Both give the ids of the SentencePiece library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from storkline.llm import text

MARK = "▁"
#: words whose ids a worker remembers, from task to task; beyond that it starts anew
REMEMBERED = 300_000
#: pairs of pieces known to fit or not that outlive the words
FITS = 500_000
#: bytes of text whose new words are encoded in one walk
BATCH_BYTES = 2 << 20
_NORMAL, _UNKNOWN, _BYTE, _UNIGRAM, _MERGES = 1, 2, 6, 1, 2


_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


def _words(names: Iterable[str]) -> re.Pattern:
    """What no piece crosses: marks with the characters up to the next mark or line end, and of these
    the runs of letters and of such punctuation as no piece holds next to a letter."""
    letter = re.compile(f"[{_LETTERS}]")
    pairs = {frozenset(pair) for name in names for pair in zip(name, name[1:])}
    held = {c for pair in pairs if any(map(letter.match, pair)) for c in pair}
    apart = "".join(re.escape(c) for c in ".,;:!?|*%&$#\"'" if c not in held)
    line = "" if any("\n" in name and len(name) > 1 for name in names) else "\n"
    runs = rf"{MARK}*[{_LETTERS}]+(?=[{apart}{MARK}{line}]|$)|{MARK}*[{apart}]+(?=[{_LETTERS}{MARK}{line}]|$)|" if apart else ""
    return re.compile(rf"{runs}{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|{line}" if line else ""))


@dataclass
class Pieces:
    """A vocabulary. `merges` tells whether words are merged or cut by the best sum of scores."""

    names: list[str]
    scores: list[float]
    ids: dict[str, int]
    byte_ids: list[int]
    unknown: int
    merges: bool
    crossing: bool = False
    _fits: dict[int, bool] = field(default_factory=dict)
    #: endings of pieces and the ids of those that are pieces themselves, else -1
    _ending: dict[str, int] = field(default_factory=dict)
    _bytes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __post_init__(self) -> None:
        for name in self.ids:
            for a in range(len(name)):
                self._ending[name[a:]] = self.ids.get(name[a:], -1)
        self.crossing = any(MARK in name.lstrip(MARK) for name in self.ids)
        self.words = _words(self.ids)
        self.floor = min(self.scores, default=0.0) - 10

    def digest(self) -> str:
        return hashlib.sha256(repr((self.names, self.scores, self.merges)).encode()).hexdigest()

    def marked(self, t: str) -> list[str]:
        """The marked words of a text."""
        if not t:
            return []
        whole = MARK + t.replace(" ", MARK)
        return [whole] if self.crossing else self.words.findall(whole)

    def merged(self, s: str) -> list[str]:
        """The result of merging: of all neighbours that make up a piece, those of the best score, the
        first of equals, are joined until none is left."""
        parts = list(s)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.ids.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or self.scores[score] > best):
                    best, at = self.scores[score], i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves these two pieces next to each other; -1 for no piece before."""
        own = [self.names[piece]] if before < 0 else [self.names[before], self.names[piece]]
        return self.merged("".join(own)) == own

    def cuts(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each of the sorted words. States are kept by prefix length: score, last piece
        (-1 at the start and after an unknown character) and where it begins."""
        extend = self._extend_merged if self.merges else self._extend_best
        score, last, begin = [0.0], [-1], [0]
        before, size = "", 0
        for word in words:
            same, most = 0, min(size, len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del score[same + 1:], last[same + 1:], begin[same + 1:]
            extend(word, score, last, begin)
            before, size = word, len(word)
            out, i = [], size
            while i:
                if last[i] >= 0:
                    out.append(last[i])
                else:
                    out += self._unknown(word[begin[i]:i])[::-1]
                i = begin[i]
            out.reverse()
            yield out

    def _extend_best(self, word: str, score: list[float], last: list[int], begin: list[int]) -> None:
        """States behind the prefixes without one, by the best sum of scores."""
        ending, scores = self._ending.get, self.scores
        for i in range(len(score), len(word) + 1):
            best, piece, at, j = None, -1, i - 1, i - 1
            while j >= 0 and (own := ending(word[j:i])) is not None:
                if own >= 0 and (best is None or score[j] + scores[own] > best):
                    best, piece, at = score[j] + scores[own], own, j
                j -= 1
            if word[i - 1] not in self.ids and (best is None or score[i - 1] + self.floor > best):
                best, piece, at = score[i - 1] + self.floor, -1, i - 1
            score.append(best)
            last.append(piece)
            begin.append(at)

    def _extend_merged(self, word: str, score: list[float], last: list[int], begin: list[int]) -> None:
        """States behind the prefixes without one, by the only piece that merging leaves there."""
        ending, known, width = self._ending.get, self._fits, len(self.names) + 1
        for i in range(len(last), len(word) + 1):
            there, j = [], i - 1
            own = ending(word[j:i])
            while own is not None:
                if own >= 0:
                    there.append((j, own))
                if not j:
                    break
                j -= 1
                own = ending(word[j:i])
            piece, at = -1, i - 1  # an unknown character stands alone
            while there:
                j, own = there.pop()
                key = (last[j] + 1) * width + own
                fit = known.get(key)
                if fit is None:
                    fit = known[key] = self.fits(last[j], own)
                if fit:
                    piece, at = own, j
                    break
            last.append(piece)
            begin.append(at)
        score.extend([0.0] * (len(last) - len(score)))

    def _unknown(self, c: str) -> list[int]:
        """An unknown character as its bytes, or as the unknown piece where there are none for bytes."""
        return [self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes are gathered into characters, marks become spaces, and the one in
        front goes."""
        return self.texts(np.fromiter(ids, np.int64), np.array([0, -1]))[0].as_py()

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of lists of ids, all at once; bounds as of lists, -1 for the end."""
        flat, begins, sizes = self._table()
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(sizes):
            raise ValueError("there is no piece of such an id")
        ends = np.concatenate([[0], np.cumsum(sizes[ids])])
        data = flat[np.repeat(begins[ids] - ends[:-1], sizes[ids]) + np.arange(ends[-1])]
        bounds = ends[bounds]
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        heads = heads[data[heads] == 0x20]
        keep = np.ones(len(data), bool)
        keep[heads] = False
        data = data[keep]
        bounds = bounds - np.searchsorted(heads, bounds)
        whole = data.tobytes()
        parts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        return pa.array(parts, pa.string())

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, and where each begins and how many it has."""
        if self._bytes is None:
            own = [n.replace(MARK, " ").encode() for n in self.names]
            for b, i in enumerate(self.byte_ids):
                own[i] = bytes([b])
            own[self.unknown] = " ⁇ ".encode()
            sizes = np.array([len(x) for x in own], np.int64)
            self._bytes = np.frombuffer(b"".join(own), np.uint8), np.cumsum(sizes) - sizes, sizes
        return self._bytes


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a SentencePiece model file. Only models that leave characters as they are can
    be read; others raise a ValueError."""
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as file:
        model = schema.ModelProto.FromString(file.read())
    rules, kind = model.normalizer_spec, model.trainer_spec.model_type
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError(f"{path} rewrites characters or spaces")
    if kind not in (_UNIGRAM, _MERGES) or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in model.pieces):
        raise ValueError(f"{path} is not a plain unigram or merge vocabulary")
    by_byte = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _BYTE}
    return Pieces(
        [p.piece for p in model.pieces], [p.score for p in model.pieces],
        {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL},
        [by_byte[f"<0x{b:02X}>"] for b in range(256)] if by_byte else [],
        next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN), kind == _MERGES,
    )


class _Numbers(dict):
    """Numbers of marked words in the order in which they were first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class _Encoder:
    """Ids of marked words in one growing array."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        if len(self.pieces._fits) > FITS:
            self.pieces._fits.clear()
        self.known = _Numbers()
        self.flat, self.begins, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Encode the words that came up since the last time, all in one walk."""
        new, self.known.new = self.known.new, []
        order = sorted(range(len(new)), key=new.__getitem__)
        found: list[int] = []
        sizes, begins = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        for k, own in zip(order, self.pieces.cuts([new[k] for k in order]), strict=True):
            begins[k] = len(found)
            found += own
            sizes[k] = len(own)
        self.begins = np.concatenate([self.begins, begins + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, np.array(found, np.int32)])

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n + 1 bounds of each."""
        if len(self.known) > REMEMBERED:
            self.forget()
        known, marked = self.known, self.pieces.marked
        words = [np.array([known[w] for w in marked(t or "")], np.int64) for t in texts]
        self._learn()
        at = np.concatenate([*words, np.zeros(0, np.int64)])
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        spread = np.repeat(self.begins[at] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[spread], ends[np.cumsum([0, *map(len, words)])]


def _encode(pieces, digest: str, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text.kept(digest, lambda: _Encoder(pieces.value))
        for batch in text.chunks(batches, limit=BATCH_BYTES, keep=digest):
            ids, bounds = encoder.ids(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists], [*names, "token_ids"])
    return run


def _decode(pieces, names: list[str], ids: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                lists = part.column(ids)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                found = pieces.value.texts(lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
                found = pc.if_else(lists.is_valid(), found, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), found], [*names, "decoded"])
    return run


def encode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """`docs` with the column `token_ids` (replaced if there). A null or empty text has no ids; rows
    are encoded one by one, whatever their other columns hold."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary has a fixed size
    rest = docs.drop("token_ids")
    schema = StructType([*rest.schema.fields, StructField("token_ids", ArrayType(IntegerType(), False), False)])
    return rest.mapInArrow(_encode(shared, pieces.digest(), rest.columns), schema)


def decode(encoded: DataFrame, pieces: Pieces, ids: str = "token_ids") -> DataFrame:
    """`encoded` with the column `decoded` (replaced if there), the text of `ids`; null for null. A word
    mark that stood in the text itself comes back as a space."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    rest = encoded.drop("decoded")
    schema = StructType([*rest.schema.fields, StructField("decoded", StringType(), True)])
    return rest.mapInArrow(_decode(shared, rest.columns, ids), schema)

