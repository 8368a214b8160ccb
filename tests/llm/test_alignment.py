"""Token alignment: ids against the libraries on whole texts, links and counts against plain loops."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import pyarrow.parquet as pq
import pytest

from storkline.llm import alignment
from storkline.llm.alignment import Aligner, align, read_vocabularies
from storkline.llm.queries import TOKENIZER, VOCABULARY


@pytest.fixture(scope="module")
def vocabularies():
    return read_vocabularies(TOKENIZER, VOCABULARY)


@pytest.fixture(scope="module")
def aligner(vocabularies):
    return Aligner(vocabularies)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    written = {chr(c): c for c in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    free = [c for c in range(256) if c not in written.values()]
    written |= {chr(256 + i): c for i, c in enumerate(free)}

    def piece(i):
        name = b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode()

    def both(t):
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        return x, y, [bytes(written[c] for c in a.id_to_token(i)) for i in x], [piece(i) for i in y]
    return both


def by_loops(both, texts):
    """The contract over whole texts, token by token."""
    rows, counts, links_of = [], Counter(), []
    for i, t in texts:
        x, y, xs, ys = both(t) if t else ([], [], [], [])
        whole = (" " + (t or "")).encode()
        if not t or b"".join(xs) != whole or b"".join(ys) != whole:
            rows.append((i, 0, 0, 0, 0, ""))
            links_of.append([])
            continue
        a = b = at_a = at_b = 0
        groups, links, first = [], [], (0, 0)
        while a < len(x):
            links.append((x[a], y[b]))
            end_a, end_b = at_a + len(xs[a]), at_b + len(ys[b])
            if end_a <= end_b:
                a, at_a = a + 1, end_a
            if end_b <= end_a:
                b, at_b = b + 1, end_b
            if end_a == end_b:
                groups.append(f"{','.join(map(str, x[first[0]:a]))}|{','.join(map(str, y[first[1]:b]))}")
                first = a, b
        counts.update(links)
        links_of.append(links)
        rows.append((i, len(x), len(y), len(groups), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = Counter(
        (*r[:5], sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), r[5]) for r, own in zip(rows, links_of, strict=True)
    )
    return out, {(a, b, n, n == most[b]) for (a, b), n in counts.items()}


def check(spark, vocabularies, libraries, docs):
    rows, pairs = align(docs, vocabularies)
    want, want_pairs = by_loops(libraries, [(r.doc_id, r.text) for r in docs.collect()])
    assert Counter(map(tuple, rows.collect())) == want
    found = list(map(tuple, pairs.collect()))
    assert len(found) == len(set(found)) and set(found) == want_pairs


def test_whole_table(spark, vocabularies, libraries):
    check(spark, vocabularies, libraries, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5))


def test_odd_rows(spark, vocabularies, libraries, odd, nothing):
    check(spark, vocabularies, libraries, odd)
    rows, pairs = align(nothing, vocabularies)
    assert rows.count() == pairs.count() == 0


STRANGE = [
    " ", "\n", "\t", "\n\n", " \n ", "a\n", "\na", " a", "a ", "  a  b  ", "a\tb", "a\t\tb ", "a \n b", "a b", "a　 b", "▁", "a▁b", "a\r\nb",
    "x = {\r\n", "<|endoftext|>", "a<|endoftext|> b", "<s>", "</s> <unk>", "<0x41>", "\x1c a\x1cb \x1c", "a\x85b", "\x00", "a\x00b", "😀 é́", "ﬁ ①", "don't 'll",
    "日本語の文 です", "a" * 500, " " * 300, "\n" * 70 + "x", "1234567 89", "...!!! ???", "﻿a", "a​b c", " a  b",
]


def test_strange_texts(spark, vocabularies, libraries):
    pick = random.Random(3)
    texts = STRANGE + ["".join(pick.choice(STRANGE + ["word", " of", "ing ", " "]) for _ in range(pick.randrange(1, 9))) for _ in range(3000)]
    check(spark, vocabularies, libraries, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_segments_join_to_the_text(aligner):
    for t in STRANGE:
        assert "".join(aligner.segments(t)) == " " + t
    assert len(aligner.segments("one two\nthree\tfour  five ")) == 5


def test_a_short_memory(documents, monkeypatch, aligner):
    """What a worker remembers does not show in the result."""
    texts = [t for _, t in documents[:60]]
    whole = [aligner.numbers([t])[0] for t in texts]
    words = [[aligner.words[i] for i in own] for own in whole]
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    again = []
    for t in texts:
        own = aligner.numbers([t])[0]
        again.append([aligner.words[i] for i in own])
    assert words == again


def test_identity_map(vocabularies):
    same = vocabularies.same_bytes()
    assert (same >= 0).sum() > 10_000
    assert all(vocabularies.a_tokens[a] == vocabularies.b_tokens[b] for a, b in enumerate(same) if b >= 0)


def test_a_common_pair_is_one_entry_a_block(spark, vocabularies, aligner):
    import numpy as np

    vector = np.zeros(len(aligner.same), np.int64)
    block = alignment._block(aligner, 0, list(range(500)), ["strangeness unfathomably"] * 500, vector)
    assert len(block.column("pairs")[0]) < 30 and sum(block.column("counts")[0].as_py()) % 500 == 0 and not (vector % 500).any()


def test_segments_are_numbered_a_part_at_a_time(vocabularies):
    """What stands in memory one by one does not grow with the texts of a block, nor with one long text."""
    own = Aligner(vocabularies)
    one = " ".join(["ab", "cd", "of"] * 130_000)
    for texts in ([one], [one[:29_999]] * 40):
        tracemalloc.start()
        found = own.numbers(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 15 << 20
        assert [len(x) for x in found] == [len(t.split()) for t in texts]


def test_parts_of_a_long_text(aligner, monkeypatch):
    texts = [*STRANGE, "".join(STRANGE), " ".join(STRANGE * 20), "", None]
    whole = [[aligner.words[i] for i in own] for own in aligner.numbers(texts)]
    monkeypatch.setattr(alignment, "IN_TURN", 3)
    assert [[aligner.words[i] for i in own] for own in aligner.numbers(texts)] == whole
    for t in texts[:-2]:
        assert [s for part in aligner._parts(t) for s in part] == aligner.segments(t)


def test_memory_is_bounded_in_characters(vocabularies, monkeypatch):
    own = Aligner(vocabularies)
    monkeypatch.setattr(alignment, "REMEMBERED_CHARACTERS", 2000)
    for k in range(20):
        own.numbers([f"{chr(0x4E00 + k)}" * 300])
    assert len(own.known) < 5


def test_blocks_are_written_in_small_row_groups(spark, vocabularies, monkeypatch):
    """Row groups are held as a whole by writers and readers, so they are a few blocks at most, however many a task makes."""
    stages, write = [], alignment.cut
    monkeypatch.setattr(alignment, "cut", lambda df, **options: stages.append(write(df, **options)) or stages[-1])
    docs = spark.range(0, 60, 1, 1).selectExpr("id AS doc_id", "repeat('ab cd of ', 30000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    assert align(docs, vocabularies)[0].count() == 60
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before
    (file,) = (f for f in stages[0].inputFiles() if f.endswith(".parquet"))
    meta = pq.ParquetFile(file.removeprefix("file:")).metadata
    rows = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
    assert sum(rows) > 4 and max(rows) <= 2
