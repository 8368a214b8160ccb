"""Shards by a k-d tree over the metadata of documents.

A node is split along the dimension in which it is widest (language, source, size), at the weighted
median of its bytes, until the leaves hold the bytes asked for. Medians are exact: rows are ordered by
the dimension's coordinate and a hash of the text, and each round of a histogram over all rows narrows
the place of every node's median by STEP bits. The driver sees one histogram of bounded size a round.

Copies of a text share all coordinates and stay together, unless they do not fit into a shard: a group of
more bytes than a leaf is to hold is ordered row by row and may be split anywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from storkline.session import cut

DIMENSIONS = ("lang", "source", "size")
COORDINATE_BITS, TIE_BITS, STEP = 16, 24, 10
#: a group of copies is kept whole up to so much of a leaf
WHOLE = 1.0
#: rows numbered by one task at a time
NUMBERED = 2000


def points(docs: DataFrame, leaves: int) -> DataFrame:
    """`doc_id`, `size`, `text_crc32`, the coordinates in DIMENSIONS (0 to 2 ** COORDINATE_BITS - 1)
    and the `tie` of every row, with a number `row` of its own; `oversize` marks copies that no leaf holds."""
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("bytes"),
        F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"), F.md5(F.encode(content, "UTF-8")).alias("copy"),
        F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.monotonically_increasing_id().alias("row"),
    ))
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    # written, so that the join stands alone and a large group of copies can be split among tasks
    groups = cut(rows.groupBy("copy").agg(F.sum("bytes").alias("all"), F.min("lang").alias("lang"), F.min("source").alias("source")))
    names = 1 << COORDINATE_BITS
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(names))
    large = F.col("all") > WHOLE * total / leaves
    tie = F.pmod(F.when(large, F.xxhash64("copy", "row")).otherwise(F.xxhash64("copy")), F.lit(1 << TIE_BITS))
    return cut(rows.drop("lang", "source").join(groups, "copy").select(
        "doc_id", F.col("bytes").alias("weight"), "text_crc32", "row", place("lang").alias("lang"), place("source").alias("source"),
        F.least(F.log2("bytes") / 40 * names, F.lit(names - 1)).cast("long").alias("size"), tie.alias("tie"), large.alias("oversize"),
    ))


def _key(dimension: str) -> Column:
    return F.col(dimension) * (1 << TIE_BITS) + F.col("tie")


def _by_node(values: dict[int, Column], otherwise: Column) -> Column:
    return reduce(lambda c, item: F.when(F.col("node") == item[0], item[1]).otherwise(c), values.items(), otherwise)


def _medians(nodes: DataFrame, widest: dict[int, str], halves: dict[int, float]) -> dict[int, int]:
    """For each node the largest key of its first half, so that both halves are as equal as whole keys
    allow."""
    key = _by_node({n: _key(d) for n, d in widest.items()}, F.lit(-1))
    keyed = nodes.filter(F.col("node").isin(*widest)).select("node", "weight", key.alias("key"))
    low = dict.fromkeys(widest, 0)
    before = dict.fromkeys(widest, 0)
    bits = COORDINATE_BITS + TIE_BITS
    last: dict[int, int] = {}
    for left in range(bits - STEP, -1, -STEP):
        base = _by_node({n: F.lit(v) for n, v in low.items()}, F.lit(0))
        cell = F.shiftright(F.col("key") - base, left)
        near = keyed.filter(cell.between(0, (1 << STEP) - 1))
        counted = near.groupBy("node", cell.cast("int").alias("cell")).agg(F.sum("weight").alias("weight")).toPandas()
        for n, own in counted.groupby("node"):
            own = own.sort_values("cell")
            sums = before[n] + own["weight"].cumsum().to_numpy()
            at = min(int((sums < halves[n]).sum()), len(own) - 1)
            start = before[n] if at == 0 else int(sums[at - 1])
            found = low[n] + (int(own["cell"].iloc[at]) << left)
            if left == 0:  # the cell is one key: it goes to the side that it makes more equal
                last[n] = found if abs(sums[at] - halves[n]) <= abs(start - halves[n]) else found - 1
            low[n], before[n] = found, start
    return last


def assign(placed: DataFrame, leaves: int) -> DataFrame:
    """The points with their `shard`, 0 to leaves - 1; leaves is a power of two."""
    levels = leaves.bit_length() - 1
    if leaves != 1 << levels:
        raise ValueError("the number of leaves must be a power of two")
    total = placed.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    nodes = placed.withColumn("node", F.lit(1))
    for _ in range(levels):
        spans = [(F.max(d) - F.min(d)).alias(f"w_{d}") for d in DIMENSIONS]
        shape = nodes.groupBy("node").agg(F.sum("weight").alias("weight"), *spans).toPandas()
        shape = shape[shape["weight"] * leaves > total]  # the others hold no more than a leaf
        widest = {int(r.node): max(DIMENSIONS, key=lambda d, r=r: getattr(r, f"w_{d}")) for r in shape.itertuples()}
        if not widest:
            nodes = nodes.withColumn("node", F.col("node") * 2)
            continue
        middle = _medians(nodes, widest, {int(r.node): r.weight / 2 for r in shape.itertuples()})
        right = _by_node({n: (_key(widest[n]) > k).cast("int") for n, k in middle.items()}, F.lit(0))
        nodes = cut(nodes.withColumn("node", F.col("node") * 2 + right))
    return nodes.withColumn("shard", (F.col("node") - leaves).cast("int")).drop("node")


def number(sharded: DataFrame) -> DataFrame:
    """The rows with their `slot` in the shard, from 0 without gaps. Rows are numbered in parts of a
    bounded size; the parts' counts place the parts."""
    parts = max(1, sharded.count() // NUMBERED)
    dealt = sharded.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset")))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return dealt.withColumn("inside", inside).join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("inside") - 1).drop("part", "inside", "offset")


def shards(docs: DataFrame, leaves: int = 16) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `size` (bytes of the text plus 1), `text_crc32`, `law`
    (`bytes`: the shards are of near equal size), `shard`, `slot`, `grown_shard` (null).

    A null text counts as empty. Rows that repeat each other are copies of one text. Rows with null
    lang or source share a coordinate; other columns are ignored. With fewer rows than shards, or rows
    larger than a shard, some shards stay empty.
    """
    numbered = number(cut(assign(points(docs, leaves), leaves)))
    return numbered.select(
        "doc_id", F.col("weight").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "oversize",
    )
