"""The word model against a plain recursion, its tokens, and junk planted among prose."""

import math
import os
import random
import re
import threading
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
import pytest

from storkline.llm import perplexity, word_order

SCRIPTS = {"la": ("abcdefghijklmnop", " "), "cy": ("абвгдежзиклмнопр", " "), "zh": ([chr(0x4E00 + i) for i in range(3000)], "")}


def own_tokens(t):
    return re.findall(r"[ࠀ-\U0010ffff]|[A-Za-z0-9\x80-߿]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_tokens():
    texts = ["", None, "One two-THREE", "中文 字ab中", "Привет, мир 😀x", "中", "a", "é中é", "  ,. "]
    hashes, bounds = word_order.tokens(pa.array(texts))
    single = {w: word_order.tokens(pa.array([w]))[0] for t in texts for w in own_tokens(t)}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert hashes[a:b].tolist() == [single[w][0] for w in own_tokens(t)]
    assert len({int(h[0]) for h in single.values()}) == len(single)


def plain_scores(texts):
    """Mean -log10 p and gain of each text by the model of the other fold, straight from the definition."""
    out = []
    fold = [zlib.crc32((t or "").encode()) % 2 for t in texts]
    models = []
    for f in (0, 1):
        pairs = Counter(p for t, k in zip(texts, fold, strict=True) if k == f for w in [[None, *own_tokens(t), None]] for p in zip(w, w[1:], strict=False))
        ended = Counter(w for _, w in pairs)
        after = defaultdict(list)
        for (v, _), n in pairs.items():
            after[v].append(n)
        low = [perplexity._discounts([sum(n == k for n in c.values()) for k in (1, 2, 3, 4)]) for c in (pairs, ended)]
        models.append((pairs, ended, after, *low))
    for t, f in zip(texts, fold, strict=True):
        pairs, ended, after, d2, d1 = models[1 - f]
        w, total, p, gain = [None, *own_tokens(t), None], sum(ended.values()), 0.0, 0.0
        for v, x in zip(w, w[1:], strict=False):
            single = (ended[x] - d1[min(ended[x], 3)] + sum(d1[min(n, 3)] for n in ended.values()) / (len(ended) + 1)) / total
            n = sum(after[v])
            lower = single * (sum(d2[min(k, 3)] for k in after[v]) / n if n else 1)
            own = (pairs[v, x] - d2[min(pairs[v, x], 3)]) / max(n, 1) + lower
            p, gain = p - math.log10(own), gain + math.log10(own / lower)
        out.append((p / (len(w) - 1), gain / (len(w) - 1)))
    return out


def test_scores_by_definition(spark, documents):
    texts = [t for _, t in sorted(documents, key=lambda d: len(d[1] or ""))[:150]] + [None, "中文 中文"]
    rows = spark.createDataFrame([(i, t, zlib.crc32((t or "").encode()) % 2) for i, t in enumerate(texts)], "id long, text string, fold int")
    out = {r.id: r for r in word_order.score(rows, {"id": "long"}, perplexity._discounts).collect()}
    for i, (p, gain) in enumerate(plain_scores(texts)):
        assert (out[i].word_log_perplexity, out[i].order_gain) == (pytest.approx(p), pytest.approx(gain, abs=1e-9))


def found_files(places):
    """Size of each file; of those that go meanwhile nothing."""
    out = {}
    for place in places:
        for folder, _, names in os.walk(place):
            for name in names:
                try:
                    out[f"{folder}/{name}"] = os.lstat(f"{folder}/{name}").st_size
                except FileNotFoundError:
                    continue
    return out


def test_one_round_stands_on_the_disk(spark):
    """Stages and shuffles together stay below 1.5 times the table, with room for the fixed part of a small one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = sum(p.stat().st_size for p in Path("/root/testdata/sf0.01").glob("documents.parquet*") for p in ([p] if p.is_file() else p.rglob("*.parquet")))
    places = [spark.conf.get("spark.checkpoint.dir"), *(str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    rows = docs.select("doc_id", "text", (F.crc32("text") % 2).cast("int").alias("fold"))
    there, seen, over = found_files(places), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            seen.append(sum(n for name, n in found_files(places).items() if name not in there))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        scored = word_order.score(rows, {"doc_id": "long"}, perplexity._discounts)
        assert scored.count() == docs.count()
    finally:
        over.set()
        watcher.join()
    assert max(seen) < 2 * size


def test_blocks_give_back_their_tokens():
    words = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 500).astype(np.uint64))
    places = np.concatenate([np.random.default_rng(4).zipf(1.4, 4000) % 500, np.arange(500)])
    often = np.bincount(places).astype(np.uint32)
    ranks = np.empty(500, np.uint32)
    ranks[word_order._by_rank(often)] = np.arange(500)
    row = {"words": word_order._sorted(words), "often": word_order._packed(often), "ranks": word_order._packed(ranks[places])}
    own, there, _ = word_order._words(row)
    assert (own == words).all() and (there == places).all()


def test_junk_in_any_script_is_rejected(spark):
    """Real words in another order, and words of the same letters: most pass the symbols' band."""
    pick, rows, kinds = random.Random(5), [], []
    for lang, (letters, gap) in SCRIPTS.items():
        word = lambda: "".join(pick.choices(letters, k=pick.randint(2, 7) if gap else 1))  # noqa: B023, E731
        known = [word() for _ in range(400)]
        after = {w: pick.sample(known, 6) for w in known}
        for i in range(280):
            w = [pick.choice(known)]
            while len(w) < 240:
                w.append(pick.choice(after[w[-1]] if pick.random() < 0.85 else known))
            kinds.append("prose" if i < 240 else "shuffled" if i < 260 else "gibberish")
            if kinds[-1] == "shuffled":
                pick.shuffle(w)
            if kinds[-1] == "gibberish":
                w = [word() for _ in w]
            rows.append((len(rows), gap.join(w if gap else [x + " " * (j % 3 == 0) for j, x in enumerate(w)]), lang))
    out = perplexity.rate(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    kept = Counter(kinds[r.doc_id] for r in out if r.kept)
    assert not any(r.base_failed for r in out)
    assert kept["prose"] >= 0.99 * 720 and kept["shuffled"] == kept["gibberish"] == 0
    by_symbols = Counter(kinds[r.doc_id] for r in out if r.low <= r.perplexity <= r.high)
    assert by_symbols["shuffled"] >= 40 and by_symbols["gibberish"] >= 40
