"""Quality of whole texts by a sparse ensemble of rules.

Trees grown on text statistics are taken apart into rules, each the conjunction of the comparisons on
a path. A logistic model with a lasso penalty weighs the rules, most of them with zero, and the rest
become one Spark column expression over the statistics.

The model learns from at most `SAMPLE` labelled rows, the first in an order by a hash of the id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from storkline.llm import statistics, text
from storkline.llm.statistics import FEATURES
from storkline.session import cut

SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.001, 7
THRESHOLD = 0.3

#: comparisons of a path: (statistic, "<=" or ">", bound)
Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The chance of label 1 as an expression over the statistics."""
        total = reduce(lambda x, rule: x + F.when(holds(rule[0]), rule[1]).otherwise(0.0), self.rules, F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule) -> Column:
    tests = [F.col(name) <= bound if sign == "<=" else F.col(name) > bound for name, sign, bound in rule]
    return reduce(lambda a, b: a & b, tests)


def paths(tree: str) -> list[Rule]:
    """The rules of a printed tree: one for every path from its root to an inner or end node."""
    found, stack = [], []
    for line in tree.splitlines():
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            depth = len(m[1])
            stack = [(d, t) for d, t in stack if d < depth]
            stack.append((depth, (FEATURES[int(m[2])], m[3], float(m[4]))))
            found.append(_tight([t for _, t in stack]))
    return found


def _tight(tests: list[tuple[str, str, float]]) -> Rule:
    """The comparisons with only the closest bound of each statistic and side."""
    bounds: dict[tuple[str, str], float] = {}
    for name, sign, bound in tests:
        closer = min if sign == "<=" else max
        bounds[name, sign] = closer(bound, bounds.get((name, sign), bound))
    return tuple((name, sign, bound) for (name, sign), bound in sorted(bounds.items()))


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text.chunks(batches):
        found = statistics.features(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(found[name], pa.float64()) for name in FEATURES)], ["doc_id", *FEATURES]
        )


def measured(docs: DataFrame) -> DataFrame:
    """`doc_id` and the statistics of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_measure, ", ".join(["doc_id long", *(f"{name} double" for name in FEATURES)]))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """Learn from the labelled rows that are not held out. Without labels, or with one kind only,
    the score is the smoothed share of label 1."""
    known = labels.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality")).filter("quality is not null and doc_id is not null")
    known = known.filter(~held_out())
    rows = cut(stats.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(sample))
    good, total = rows.agg(F.sum("quality"), F.count("*")).first()
    if not total or good in (0, total):
        share = ((good or 0) + 1) / (total + 2)
        return Ensemble([], _logit(share))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("features", "quality")
    forest = RandomForestClassifier(labelCol="quality", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString)})
    if not rules:
        return Ensemble([], _logit((good + 1) / (total + 2)))
    flags = rows.select("quality", *(holds(rule).cast("double").alias(f"r{i}") for i, rule in enumerate(rules)))
    flags = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(flags).select("features", "quality")
    lasso = LogisticRegression(labelCol="quality", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(flags)
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble([(rule, w) for rule, w in zip(rules, weights, strict=True) if w], lasso.intercept)


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `held_out`, `score`, `predicted` and the statistics.

    A null or empty text has all statistics at 0 and gets the score of such texts. A row without
    doc_id is scored and not held out. Other columns of `docs` are ignored; repeated labels count
    once, with the larger value.
    """
    stats = cut(measured(docs))
    scored = stats.withColumn("score", fit(stats, labels, sample).score())
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), *FEATURES,
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose text the model does not reject. Rows without doc_id stay."""
    scored = score(docs, labels)
    bad = cut(scored.filter("predicted = 0 and doc_id is not null").select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
