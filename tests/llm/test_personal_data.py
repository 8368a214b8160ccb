"""Personal data: patterns against plain regular expressions, the tagger against numeric gradients,
held-out windows and whole tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from storkline.llm import char_tagger, personal_data
from storkline.llm.personal_data import KINDS, by_patterns, find, fit, luhn, mask, masked, report

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(t):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            found.append((m.start(), m.end(), KINDS.index(kind)))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_patterns(documents):
    texts = [t for _, t in documents]
    pick = random.Random(2)
    texts += ["".join(pick.choices("a1.@+-() 25é", k=60)) for _ in range(4000)]
    texts += ["1.2.3.4.5.6.7.8.9", "a@b@c.d@e.f.g", "..@a.b", "@a.b", "x@a.b.", "256.1.1.1 1.1.1.256", "+1 (988) 555-2485", "0000.0.0.0255"]
    for t in texts:
        assert by_patterns(t)[0] == plainly(t)
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_runs_are_read_in_their_length():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + " " * 200_000, "@" * 50_000, "0" * 6000 + ".0.0.0"):
        by_patterns(t)


def test_gradients():
    pick = np.random.default_rng(0)
    codes, tags = pick.integers(0, 128, (3, 7)), pick.integers(0, 3, (3, 7))
    p = {k: v.astype(np.float64) for k, v in char_tagger.start(3).items()}
    _, grads = char_tagger._gradients(p, codes, tags)
    for name, x in p.items():
        spots = [tuple(pick.integers(0, n) for n in x.shape) for _ in range(4)]
        if name == "embed":
            spots = [(codes[0, 0], 1), (codes[1, 3], 2)]
        for at in spots:
            old, step = x[at], 1e-3
            x[at] = old + step
            up = char_tagger._gradients(p, codes, tags)[0]
            x[at] = old - step
            down = char_tagger._gradients(p, codes, tags)[0]
            x[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


def test_viterbi_finds_the_best_sequence():
    from itertools import product

    pick = np.random.default_rng(1)
    p = {"first": pick.standard_normal(3), "move": pick.standard_normal((3, 3))}
    scores = [pick.standard_normal((n, 3)).astype(np.float32) for n in (1, 3, 5)]
    for s, got in zip(scores, char_tagger._viterbi(p, scores), strict=True):
        value = lambda y: p["first"][y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(p["move"][a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert tuple(got) == max(product(range(3), repeat=len(s)), key=value)


def test_a_long_stretch_beside_short_ones():
    """Stretches are decided in parts of a bounded size, whatever their lengths."""
    p = char_tagger.start(3)
    pick = np.random.default_rng(2)
    stretches = [pick.integers(0, 128, n) for n in (5, 150_000, 70, 64, 1)]
    found = char_tagger.tag(p, stretches)
    assert [len(y) for y in found] == [len(s) for s in stretches]
    assert all((y == char_tagger.tag(p, [s])[0]).all() for s, y in zip(stretches[2:], found[2:], strict=True))


def test_windows_cover_every_character():
    for n in (1, 63, 64, 65, 100, 1000):
        covered = {c for a in char_tagger.window_starts(n) for c in range(a, min(a + char_tagger.WINDOW, n))}
        assert covered == set(range(n))


@pytest.fixture(scope="module")
def model(spark):
    return personal_data.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_spans(model, documents):
    """The tagger alone finds spans of texts that it was not trained on, and little else."""
    texts = [t for i, t in documents if re.search("[0-9@]", t)]
    places = [(t, a, b) for t in texts for a, b in personal_data.stretches(t)]
    tagged = char_tagger.tag(model, [char_tagger.encode(t[a:b]) for t, a, b in places])
    found = {(t, *s) for (t, a, _), y in zip(places, tagged, strict=True) for s in personal_data._spans(y, a)}
    truth = {(t, *s) for t in texts for s in by_patterns(t)[0]}
    assert len(found & truth) > 0.9 * len(truth) and len(found & truth) > 0.9 * len(found)


@pytest.fixture(scope="module")
def small_model(spark):
    return personal_data.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def unseen():
    """Documents of which no tagger here learns: none of those in the small table, the last of the large one."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()
    return [t for t in texts[-4000:] if t and len(t) < 20_000]


#: forms that the taggers never see
HELD_OUT = {
    0: lambda s: s.replace("@", " @"), 1: lambda s: s.replace(".", " ."),
    2: lambda s: "_".join(re.sub("[^0-9]", "", s)[i:i + 4] for i in range(0, 20, 4)).strip("_"),
}


def added(model, texts, rewrite):
    """Per kind how many rewritten spans are added, and how many the patterns miss."""
    hits, tried = [0] * len(KINDS), [0] * len(KINDS)
    for t in texts:
        for a, b, kind in by_patterns(t)[0]:
            new = rewrite(t[a:b], kind)
            if new is None:
                continue
            base, extra = find([t[:a] + new + t[b:]], model)[0]
            if not any(x < a + len(new) and a < y for x, y, _ in base):
                tried[kind] += 1
                hits[kind] += any(x < a + len(new) and a < y and k == kind for x, y, k in extra)
    return hits, tried


@pytest.mark.parametrize("size", ["small", "large"])
def test_adds_what_the_patterns_miss(model, small_model, unseen, size):
    pick, own = random.Random(9), model if size == "large" else small_model
    hits, tried = added(own, unseen, lambda s, kind: personal_data._rewritten(s, kind, pick))
    assert min(tried) > 20 and all(h > 0.5 * n for h, n in zip(hits, tried, strict=True))
    clean = [x for x in unseen if not by_patterns(x)[0]]
    assert sum(bool(extra) for _, extra in find(clean, own)) <= 0.002 * len(clean)


def test_adds_forms_it_never_saw(model, unseen):
    hits, tried = added(model, unseen, lambda s, kind: HELD_OUT[kind](s) if kind in HELD_OUT else None)
    assert min(tried[:3]) > 20 and all(h > 0.5 * n for h, n in zip(hits[:3], tried[:3], strict=True))


def test_a_failed_number_stays_out_and_parts_of_another_do_not():
    t = "pay 4111 1111 1111 1112 or 4111/1111/1111/1111 now"
    good, failed = by_patterns(t)
    assert not good and personal_data._covers(t, *next(f for f in failed if f[1] - f[0] == 19)[:2], (4, 23, 2))
    assert not any(personal_data._covers(t, a, b, (27, 46, 2)) for a, b, _ in failed)
    assert personal_data._has_parts("4111/1111/1111/1111", 2) and not personal_data._has_parts("4111/1111/1111/1112", 2)
    assert all(personal_data._has_parts(s, 0) for s in ("a@b.c", "a @ b.c", "a@ b.c")) and not personal_data._has_parts("a @ b @ c.d", 0)


def test_stretches_end_with_words():
    name, domain = "n" * 90, "d" * 50 + ".example"
    t = f"before {name} @ {domain} and after"
    (span,) = personal_data.stretches(t)
    assert span[0] <= t.index(name) and span[1] >= t.index(domain) + len(domain)
    assert personal_data.stretches("x" * 500 + "1" + "y" * 500) == [(0, 1001)]


def test_report_and_mask_of_a_table(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in report(docs, 60).collect()}
    assert len(rows) == len(documents)
    for i, t in documents:
        base = [f"{KINDS[k]}:{a}:{b}" for a, b, k in plainly(t)]
        spans = rows[i].spans.split(",") if rows[i].spans else []
        assert rows[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(spans) and len(spans) == len(base) + rows[i].n_added
        assert [rows[i][f"n_{k}"] for k in KINDS] == [sum(s.startswith(k) for s in spans) for k in KINDS]
    new = {r.doc_id: r for r in mask(docs, 60).collect()}
    for i, t in documents:
        if not rows[i].spans:
            assert new[i].text == t
        assert not plainly(new[i].text) and new[i].n_chars == len(new[i].text)


def test_masked():
    assert masked("a b@c.d e 1.2.3.4", by_patterns("a b@c.d e 1.2.3.4")[0]) == "a <EMAIL> e <IP>"
    assert masked("abcdef", [(1, 3, 0), (2, 5, 1)]) == "a<EMAIL>f"


def test_odd_rows(spark, odd, nothing):
    out = report(odd).collect()
    assert len(out) == odd.count() and {r.spans for r in out} == {""}
    assert report(nothing).count() == 0 and mask(nothing).count() == 0
    assert sorted(map(str, mask(odd).collect())) == sorted(map(str, odd.collect()))
    assert fit([]).keys() == fit(["a 1.2.3.4 b"]).keys()


def test_learning_leaves_no_freed_memory_with_the_driver(spark, monkeypatch):
    called = []
    monkeypatch.setattr(personal_data, "fit", lambda texts: called.append(len(texts)) or {})
    monkeypatch.setattr(personal_data.text, "let_go", lambda: called.append("let go"))
    personal_data.learn(spark.createDataFrame([("call +49 30 1234567",), ("room 5",)], "text string"))
    assert called == [2, "let go"]
