"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model over symbols of texts: `ORDER` symbols of `BITS` bits each, so that it
never has more than 2 ** (ORDER * BITS) n-grams and can be sent to every task, whatever the corpus.
Spark counts the n-grams of all texts. The model is kept as sorted arrays of n-gram hashes (the bits
of the symbols) with log probabilities and back-off weights; a task spreads them once into a table.
A document is rejected if its perplexity lies outside the band of its language, which is set from the
quartiles of all documents of that language that pass the fixed rules.

Symbols say little about words and nothing about most scripts. So a second model over word bigrams
(`word_order`), which grows with the corpus, scores every text as well: a document is also rejected if
its word perplexity lies above the band of its language, or if its bigrams gain far less over single
words than those of its language do, as shuffled words and gibberish of any script.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storkline.llm import statistics, text, word_order
from storkline.session import cut

ORDER, BITS = 4, 5
SYMBOLS = 1 << BITS
#: width of the bands: quartile distances beyond the quartiles
FENCE = 3.0
#: words at which the distance allowed beyond the quartiles has grown by the square root of 2
SHORT = 100
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATED = {"doc_id": "long", "lang": "string", **dict.fromkeys(COUNTS, "long"), "log_perplexity": "double"}
#: a text has word order if its bigrams gain this share of what the lowest quarter of its language gains at most
ORDER_SHARE = 0.25


def _symbol(byte: int) -> int:
    """0 is the edge of a text; letters fold to lower case, other bytes to kinds."""
    c = chr(byte)
    if byte < 128 and c.isalpha():
        return 1 + ord(c.lower()) - ord("a")
    if byte >= 128:
        return 27
    if c in " \t\n\v\f\r":
        return 28
    return 29 if c.isdigit() else 30 if c in ".,;:'\"()-" else 31


_SYMBOL = np.array([_symbol(b) for b in range(256)], dtype=np.int32)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each symbol and at the end of each text, text after text, and where
    each text's n-grams begin and end."""
    data, offsets = text.raw(column)
    n, pad = len(offsets) - 1, ORDER - 1
    line = np.zeros(len(data) + pad * (n + 1), np.int32)
    line[np.arange(len(data)) + pad * (np.repeat(np.arange(n), np.diff(offsets)) + 1)] = _SYMBOL[data]
    codes = np.zeros(len(line) - pad, np.int32)
    for i in range(ORDER):
        codes |= line[i:len(line) - pad + i] << (BITS * (pad - i))
    begins = offsets[:-1] + pad * np.arange(n)  # codes[i] ends at line[i + pad]
    return codes, begins, begins + np.diff(offsets) + 1


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in text.chunks(batches):
        codes, begins, ends = grams(batch.column("text"))
        # between texts stand n-grams that end at the second and later edge symbols
        edge = np.zeros(len(codes) + 1, np.int32)
        np.add.at(edge, begins, 1)
        np.add.at(edge, ends, -1)
        total += np.bincount(codes[np.cumsum(edge[:-1]) > 0], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["gram", "n"])


def count(docs: DataFrame) -> DataFrame:
    """`gram`, `n` over all texts."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """Per order the sorted n-grams seen, their log10 probabilities and the back-off weights of the
    sorted contexts."""

    seen: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]

    def table(self) -> np.ndarray:
        """log10 probability of every possible n-gram of the highest order."""
        lower = np.full(SYMBOLS, -np.log10(SYMBOLS))
        for n in range(ORDER):
            weight = np.zeros(SYMBOLS**n)
            weight[self.contexts[n]] = self.backoff[n]
            whole = (weight.reshape(-1, 1) + (np.tile(lower.reshape(-1, SYMBOLS), (SYMBOLS, 1)) if n else lower)).ravel()
            whole[self.seen[n]] = self.log_p[n]
            lower = whole
        return lower.astype(np.float32)


def _discounts(n: list[int]) -> np.ndarray:
    """Discounts of the counts 0, 1, 2, and 3 or more, by how many counts are 1, 2, 3 and 4; fixed ones
    where too few counts are that low."""
    if not all(n):
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0, *(np.clip(k - (k + 1) * y * n[k] / n[k - 1], 0.01, k - 0.01) for k in (1, 2, 3))])


def fit(seen: np.ndarray, counts: np.ndarray) -> Model:
    """The model from the n-grams of the highest order and their counts. Lower orders count the
    different symbols seen before an n-gram. Without counts every symbol is equally likely."""
    order = np.argsort(seen)
    level = {ORDER: (seen[order].astype(np.int64), counts[order].astype(np.float64))}
    for n in range(ORDER - 1, 0, -1):
        level[n] = np.unique(level[n + 1][0] & (SYMBOLS**n - 1), return_counts=True)
    model = Model([], [], [], [])
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        keys, c = level[n]
        cut_off = _discounts([np.count_nonzero(c == k) for k in range(1, 5)])[np.minimum(c, 3).astype(int)]
        contexts = keys >> BITS
        size = SYMBOLS ** (n - 1)
        total, freed = np.bincount(contexts, c, size), np.bincount(contexts, cut_off, size)
        weight = np.divide(freed, total, out=np.ones(size), where=total > 0)
        tail = keys & (SYMBOLS ** max(n - 1, 1) - 1)
        p = (c - cut_off) / np.maximum(total[contexts], 1) + weight[contexts] * lower[tail]
        known = np.flatnonzero(total)
        model.seen.append(keys)
        model.log_p.append(np.log10(p))
        model.contexts.append(known)
        model.backoff.append(np.log10(weight[known]))
        whole = (weight.reshape(-1, 1) * (np.tile(lower.reshape(-1, SYMBOLS), (SYMBOLS, 1)) if n > 1 else lower)).ravel()
        whole[keys] = p
        lower = whole
    return model


def _rate(model):
    """Counts and log10 probability of each text."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value.table()
        for batch in text.chunks(batches):
            column = batch.column("text")
            found = statistics.basic(column)
            codes, begins, ends = grams(column)
            sums = np.zeros(len(codes) + 1)
            np.cumsum(table[codes], dtype=np.float64, out=sums[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), batch.column("fold"), batch.column("doc_id"), batch.column("lang"), *(pa.array(found[name], pa.int64()) for name in COUNTS),
                 pa.array(-(sums[ends] - sums[begins]) / (ends - begins), pa.float64())],
                ["text", "fold", *RATED],
            )
    return run


def rate(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """One row per row of `docs`: `doc_id`, the counts in COUNTS, `base_failed`, `perplexity` (per
    symbol), the band `low` to `high` of its language (for long texts; wider for short ones),
    `word_perplexity` (per word) with its bound `word_high`, `order_gain` with its bound `order_low`, and `kept`.

    A null text counts as empty: no words, so it fails the base rules. Rows without a language are
    one language. In a language where no document passes the base rules no band is set, and none is
    needed. Rows without doc_id are rated like all others; other columns are ignored.
    """
    spark = docs.sparkSession
    found = count(docs).toPandas()  # at most SYMBOLS ** ORDER rows
    model = spark.sparkContext.broadcast(fit(found["gram"].to_numpy(), found["n"].to_numpy()))
    own = F.col("text").cast("string")
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), own.alias("text"), F.col("lang").cast("string").alias("lang"),
        (F.crc32(F.coalesce(own, F.lit(""))) % 2).cast("int").alias("fold"),
    )
    measured = plain.mapInArrow(_rate(model), "text string, fold int, " + ", ".join(f"{c} {kind}" for c, kind in RATED.items()))
    rated = (
        word_order.score(measured, RATED, _discounts, int(found["n"].sum()))  # a byte or an end each
        .withColumn("lang", F.coalesce("lang", F.lit("")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    )
    passing = rated.filter("not base_failed").groupBy("lang")
    quartiles = passing.agg(
        F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000).alias("q"), F.percentile_approx("word_log_perplexity", [0.25, 0.75], 10_000).alias("w"),
        F.percentile_approx("order_gain", 0.25, 10_000).alias("g"),
    )
    reach, word_reach = fence * (F.col("q")[1] - F.col("q")[0]), fence * (F.col("w")[1] - F.col("w")[0])
    bands = cut(quartiles.select(
        "lang", reach.alias("reach"), (F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high"),
        word_reach.alias("word_reach"), (F.col("w")[1] + word_reach).alias("word_high"), (ORDER_SHARE * F.col("g")).alias("order_low"),
    ))
    # the mean over a short text scatters more
    wider = F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    slack, word_slack = F.col("reach") * (wider - 1), F.col("word_reach") * (wider - 1)
    inside = F.col("log_perplexity").between(F.col("low") - slack, F.col("high") + slack)
    inside &= (F.col("word_log_perplexity") <= F.col("word_high") + word_slack) & (F.col("order_gain") >= F.col("order_low") / wider)
    return rated.join(bands, "lang", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.pow(F.lit(10.0), "log_perplexity").alias("perplexity"), F.pow(F.lit(10.0), "low").alias("low"), F.pow(F.lit(10.0), "high").alias("high"),
        F.pow(F.lit(10.0), "word_log_perplexity").alias("word_perplexity"), F.pow(F.lit(10.0), "word_high").alias("word_high"), "order_gain", "order_low",
    )
