"""SentencePiece encoding against the library, and a unigram vocabulary against all cuts."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from storkline.llm import pieces
from storkline.llm.pieces import MARK, Pieces, decode, encode, read_pieces
from storkline.llm.queries import VOCABULARY, op6_sentencepiece_shared_prefix

ODD = [
    "", " ", "  ", "\n", "a ", " a", "Hello  world", "  a\n b\tc", "▁x é 😀 <s> </s>", "日本語テキスト ok", "a" * 3000, "\x00 x", "ééé﷽",
    "m². km²! x².y", "1,234.56 (7) don't \"q\"", "a\r\nb", "naïve…», «x»", "." * 500, "x" * 50 + "." + "y" * 50, "１２３ ² ³",
]


@pytest.fixture(scope="module")
def vocabulary():
    return read_pieces(VOCABULARY)


def test_ids_of_the_library(vocabulary, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pick = random.Random(4)
    texts = ODD + [t for _, t in documents] + ["".join(pick.choices("ab.,²é▁ \n<s>1", k=40)) for _ in range(500)]
    ids, bounds = pieces._Encoder(vocabulary).ids(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(t), t[:80]
        assert vocabulary.decode(ids[a:b].tolist()) == library.decode(library.encode(t))


def test_unigram_cuts_have_the_best_score():
    pick = random.Random(6)
    names = ["<unk>", MARK, "a", "b", "c", *{"".join(pick.choices(MARK + "abc", k=1)) + "".join(pick.choices("abc", k=pick.randrange(1, 4))) for _ in range(30)}]
    scores = [0.0, *(-pick.random() * 5 - 1 for _ in names[1:])]
    own = Pieces(names, scores, {n: i for i, n in enumerate(names) if i}, [], 0, merges=False)
    words = sorted({MARK + "".join(pick.choices("abcz", k=pick.randrange(1, 8))) for _ in range(200)})

    def best(w):
        """Best score over all cuts of w; an unknown character costs the floor."""
        if not w:
            return 0.0
        found = [scores[own.ids[w[:n]]] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in own.ids]
        return max([*found, own.floor + best(w[1:])] if w[0] not in own.ids else found)

    for w, ids in zip(words, own.cuts(words), strict=True):
        assert sum(scores[i] if i else own.floor for i in ids) == pytest.approx(best(w))


def test_states_of_common_prefixes_are_kept(vocabulary):
    words = sorted(MARK + w for w in ("pre", "prefix", "prefixes", "present", "presently", "z"))
    assert list(vocabulary.cuts(words)) == [next(vocabulary.cuts([w])) for w in words]


def test_remembered_words_are_bounded(vocabulary, documents, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    texts = [t for _, t in documents[:60]]
    small, whole = pieces._Encoder(vocabulary), pieces._Encoder(vocabulary)
    together = whole.ids(texts)[0].tolist()
    assert [i for t in texts for i in small.ids([t])[0].tolist()] == together


def test_decoding_any_ids(vocabulary):
    library = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pick = random.Random(7)
    for _ in range(300):
        ids = [pick.randrange(3, 32000) if pick.random() < 0.6 else pick.randrange(3, 259) for _ in range(pick.randrange(0, 12))]
        if not any(i in vocabulary.byte_ids for i in ids):
            assert vocabulary.decode(ids) == library.decode(ids)
        vocabulary.decode(ids)  # broken characters are replaced
    with pytest.raises(ValueError):
        vocabulary.decode([32000])


def test_query_and_odd_rows(spark, odd, nothing, vocabulary):
    out = op6_sentencepiece_shared_prefix(spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert out.filter("not round_trip or n_tokens <> size(token_ids)").count() == 0
    encoded = encode(odd, vocabulary)
    assert encoded.columns == [*odd.columns, "token_ids"]
    back = decode(encoded, vocabulary).collect()
    assert all(r.decoded == (r.text or "") and bool(r.token_ids) == bool(r.text) for r in back)
    assert encode(encoded, vocabulary).columns == encoded.columns
    assert decode(encode(nothing, vocabulary), vocabulary).count() == 0


def test_words_are_remembered_for_the_next_task_of_the_stage_only(monkeypatch):
    class Shared:
        value = read_pieces(VOCABULARY)

    monkeypatch.setattr(pieces.text, "_kept", {})
    batch = pa.record_batch({"text": ["the quick brown fox", None]})
    run = pieces._encode(Shared, "digest", ["text"])
    once = [b.to_pylist() for b in run([batch])]
    known = pieces.text._kept["digest"].known
    assert [b.to_pylist() for b in run([batch])] == once and pieces.text._kept["digest"].known is known and known
    list(pieces.text.chunks([batch]))  # as a task of another stage does
    assert not pieces.text._kept and [b.to_pylist() for b in run([batch])] == once


def test_pairs_that_fit_are_forgotten_too(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    monkeypatch.setattr(pieces, "FITS", 200)
    pick, vocabulary, sizes = random.Random(5), read_pieces(VOCABULARY), []
    encoder, library = pieces._Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    for _ in range(20):
        t = " ".join("".join(pick.choices("abcdefgh", k=6)) for _ in range(120))
        assert encoder.ids([t])[0].tolist() == library.encode(t)
        sizes.append(len(vocabulary._fits))
    assert any(b < a for a, b in zip(sizes, sizes[1:]))
