"""The Kneser-Ney model against a plain recursion, and the rules on whole tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from storkline.llm import perplexity
from storkline.llm.perplexity import ORDER, SYMBOLS, count, fit, rate


def symbols(t):
    return [0] * (ORDER - 1) + [perplexity._symbol(b) for b in (t or "").encode()] + [0]


def plain_model(texts):
    """p(symbol | context) by modified Kneser-Ney, straight from its definition."""
    counts = {ORDER: Counter(tuple(s[i:i + ORDER]) for s in map(symbols, texts) for i in range(len(s) - ORDER + 1))}
    for n in range(ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, follow = {}, {n: defaultdict(list) for n in counts}
    for n, c in counts.items():
        k = Counter(c.values())
        if all(k[i] for i in range(1, 5)):
            y = k[1] / (k[1] + 2 * k[2])
            discount[n] = [0] + [min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.01), i - 0.01) for i in (1, 2, 3)]
        else:
            discount[n] = [0, 0.5, 0.75, 0.9]
        for g, x in c.items():
            follow[n][g[:-1]].append(x)

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / SYMBOLS
        seen = follow[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        cut = lambda x: discount[n][min(x, 3)]
        x = counts[n][gram]
        return (max(x - cut(x), 0) + sum(map(cut, seen)) * p(gram[1:])) / sum(seen)

    return lambda t: [math.log10(p(tuple(s[i:i + ORDER]))) for s in [symbols(t)] for i in range(len(s) - ORDER + 1)]


def test_perplexity_by_definition(spark, documents):
    rows = [(i, t, "en") for i, t in documents[:60]] + [(1000, None, None), (1001, "", "en"), (1002, "ß§ zzqq 99", "xx")]
    log_p = plain_model([t for _, t, _ in rows])
    out = {r.doc_id: r.perplexity for r in rate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        own = log_p(t)
        assert out[i] == pytest.approx(10 ** (-sum(own) / len(own)), rel=1e-4)


def test_probabilities_sum_to_one(spark, documents):
    found = count(spark.createDataFrame(documents[:80], "doc_id long, text string")).toPandas()
    table = fit(found["gram"].to_numpy(), found["n"].to_numpy()).table()
    assert np.allclose((10.0 ** table.astype(float)).reshape(-1, SYMBOLS).sum(axis=1), 1, atol=1e-4)
    assert np.allclose(10.0 ** fit(np.zeros(0, int), np.zeros(0, int)).table(), 1 / SYMBOLS)


def test_whole_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    out = rate(docs).collect()
    assert len(out) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    passing = [r for r in out if not r.base_failed]
    assert not any(r.kept for r in out if r.base_failed)
    assert sum(r.kept for r in passing if r.doc_id in good) > 0.99 * sum(r.doc_id in good for r in passing)
    assert any(not r.kept for r in passing)


def test_odd_rows(odd, nothing):
    out = rate(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r.perplexity) for r in out)
    assert {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert rate(nothing).count() == 0
