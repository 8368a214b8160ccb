"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A document's shingles are hashed; its sketch is the k smallest hash values. Documents with equal
   shingle sets are one class from here on, known by its smallest doc_id.
2. Inverted lists of retained values bring classes together. Two sets as similar as asked share at
   least `overlap_bound` retained values, so a class enters only the lists of its rarest retained
   values, as many as still make a common list certain. A frequent passage thus opens a list only
   for classes that consist mostly of such passages.
3. In each list all members are compared with one pivot, the member of the most frequent values,
   then those still outside the list's largest component with a second pivot. That is linear for
   groups of copies, however large. Classes that lists leave in different components are compared by
   inverted lists of their full sets, which hold few of them: a copy with many changes has enough
   values of its own to enter none. No link between components is left out.
4. A pair is dropped if the sketch of its union, made from both sketches, shows too small an overlap;
   every other pair is settled by the exact similarity of the full sets.

Sets are compared by 64-bit hashes of all their shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from storkline.llm import text
from storkline.llm.components import components
from storkline.session import cut

SKETCH = 32
#: chance that a pair exactly at the threshold falls below the overlap asked of its sketches
MISS = 1e-7

_MARKS = "doc_id long, n_shingles long, digest binary, sketch array<long>"
_SETS = "doc_id long, shingles array<long>"


def overlap_bound(k: int, percent: int, miss: float = MISS) -> int:
    """The overlap of two sketches that a pair of this similarity reaches but with chance `miss`:
    each of the k smallest values of the union is in both sets with that similarity as its chance."""
    share, below = percent / 100, 0.0
    for x in range(k + 1):
        below += math.comb(k, x) * share**x * (1 - share) ** (k - x)
        if below > miss:
            return max(x, 1)
    return k


def _mark(width: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.chunks(batches):
            counts, digests, sketches = [], [], []
            ids = batch.column("doc_id")
            for known, own in zip(ids.is_valid().to_pylist(), text.shingle_sets(*text.word_hashes(batch.column("text")), width), strict=True):
                counts.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if known and len(own) else None)
                sketches.append(own[:k])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "sketch"],
            )
    return run


def _full_sets(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.chunks(batches):
            sets = list(text.shingle_sets(*text.word_hashes(batch.column("text")), width))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])
    return run


def _lists(sets: DataFrame, must: Column) -> DataFrame:
    """Inverted lists `value`, `rep`, `weight`, `behind` from the sets `rep`, `size`, `members`: two
    sets with `must` members in common meet in a list, as each enters those of its rarest members, as
    many as `must` cannot do without. Members of one set alone come first in that order and open no
    list. `weight` is larger for a set of frequent members; `behind` counts the set's members from
    this one on in the order by rarity."""
    kept = sets.select("rep", "size", F.explode("members").alias("value"))
    often = kept.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = kept.join(often, "value").groupBy("rep", "size").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"), F.sum("df").alias("weight")
    )
    places = F.slice("shared", F.lit(1), F.greatest(F.size("shared") - must + 1, F.lit(0)).cast("int"))
    rows = shared.select("rep", "weight", F.size("shared").alias("n"), F.posexplode(places).alias("i", "x"))
    return rows.select(F.col("x.value").alias("value"), "rep", "weight", (F.col("n") - F.col("i")).alias("behind"))


def _apart(lists: DataFrame, found: DataFrame) -> DataFrame:
    """Members of lists that more than one component of the links found meets in, each with its
    component `part` and the list's largest one, `main`."""
    label = components(found).withColumnRenamed("id", "rep")
    own = lists.join(label, "rep", "left").withColumn("part", F.coalesce("label", "rep")).drop("label")
    parts = own.groupBy("value", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("value").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("n")).filter("n > 1")
    # written, so that the join stands alone and a long list can be split among tasks
    return cut(own.join(cut(main.select("value", F.col("most.part").alias("main"))), "value"))


def _similar(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (`a`, `b`) whose sets are as similar as asked."""
    def side(name: str) -> DataFrame:
        return classes.select(F.col("rep").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    def full(name: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"f_{name}"))

    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(F.col("union"), F.array_intersect("s_a", "s_b")))
    likely = (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        .withColumn("union", union)
        .filter(both >= F.least(F.lit(overlap_bound(k, percent)), F.ceil(F.size("union") * percent / 100)))
        .select("a", "b", "n_a", "n_b")
    )
    common = F.size(F.array_intersect("f_a", "f_b"))
    exact = likely.join(full("a"), "a").join(full("b"), "b").withColumn("common", common)
    return exact.filter(100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int, k: int = SKETCH) -> DataFrame:
    """Links (`a`, `b`) between classes that give the same components as all pairs of the similarity."""
    bound = F.lit(overlap_bound(k, percent))
    sketches = classes.select("rep", F.least("n_shingles", F.lit(k)).alias("size"), F.col("sketch").alias("members"))
    lists = _lists(sketches, F.least(bound, F.ceil(F.col("size") * percent / 100)))
    pivot = F.max(F.struct("weight", (-F.col("rep")).alias("back")))
    lists = cut(lists)
    pivots = cut(lists.groupBy("value").agg(F.count("*").alias("n"), pivot.alias("p")).filter("n > 1").select("value", (-F.col("p.back")).alias("pivot")))
    lists = cut(lists.join(pivots, "value").select("value", "rep", "weight", "pivot"))
    members = lists.select(F.col("rep").alias("doc_id")).distinct()
    asked = docs.select("doc_id", "text").join(members.hint("shuffle_hash"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(asked.mapInArrow(_full_sets(width), _SETS))

    tried, found = None, None

    def settle(pairs: DataFrame) -> None:
        """Compare pairs that were not compared before."""
        nonlocal tried, found
        ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
        new = cut(ends.join(tried, ["a", "b"], "left_anti") if tried else ends)
        similar = _similar(new, classes, sets, k, percent)
        tried, found = tried.union(new) if tried else new, cut(found.union(similar) if found else similar)

    settle(lists.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
    mixed = _apart(lists.drop("pivot"), found)
    second = cut(mixed.filter("part <> main").groupBy("value").agg(F.max(F.struct("weight", (-F.col("rep")).alias("back"), "part")).alias("p")))
    settle(mixed.join(second, "value").filter("part <> p.part").select((-F.col("p.back")).alias("a"), F.col("rep").alias("b")))

    left = _apart(lists.drop("pivot"), found).select(F.col("rep").alias("doc_id")).distinct()
    whole = sets.join(left, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.size("shingles").alias("size"), F.col("shingles").alias("members"))
    wide = _lists(whole, F.ceil(F.col("size") * percent / 100)).join(whole.select("rep", "size"), "rep")
    mixed = _apart(cut(wide), found)
    one = mixed.filter("part <> main").select("value", F.col("rep").alias("a"), F.col("part").alias("part_a"), F.col("behind").alias("behind_a"), F.col("size").alias("size_a"))
    other = mixed.select("value", F.col("rep").alias("b"), F.col("part").alias("part_b"), F.col("behind").alias("behind_b"), F.col("size").alias("size_b"))
    # the first list that a pair meets in has all their common members from there on
    common = F.ceil((F.col("size_a") + F.col("size_b")) * percent / (100 + percent))
    enough = (F.col("part_a") != F.col("part_b")) & (F.least("behind_a", "behind_b") >= common)
    settle(one.join(other, "value").filter(enough).select("a", "b"))
    return found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `n_shingles`, `component_id` (the smallest doc_id
    reachable over links of at least `percent` similarity), `kept` (it is that doc_id itself).

    A null or empty text, or one of white space, has no shingles and links to nothing. A row without
    doc_id links to nothing, has a null component and is kept. Rows that repeat a doc_id with the
    same text get the same answer each; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = cut(plain.mapInArrow(_mark(width, k), _MARKS))
    classes = cut(
        marks.filter("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    label = components(links(plain, classes, width, percent, k)).withColumnRenamed("id", "rep")
    known = classes.join(label, "rep", "left").select("digest", F.coalesce("label", "rep").alias("root"))
    root = F.coalesce("root", "doc_id")
    return marks.join(known, "digest", "left").select(
        "doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` but those of near copies with a larger doc_id; of rows that repeat a doc_id
    one stays. Columns and rows without doc_id stay as they are."""
    gone = cut(near_duplicates(docs, width, percent).filter("not kept").select("doc_id").distinct())
    often = cut(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"))
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = kept.join(often, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(often, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
