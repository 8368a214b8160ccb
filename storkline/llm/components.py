"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from storkline.session import cut


def components(edges: DataFrame) -> DataFrame:
    """`id`, `label` for every end of the links (`a`, `b`): the smallest id reachable.

    Each round hangs every id under its smallest neighbour if that is smaller, follows the parents
    to the roots, and goes on with the links between different roots. The links shrink with every
    round; an id with very many links is only ever grouped by a partial aggregate or joined.
    Loops, repeated links and links with a null end are ignored; without links the result is empty.
    """
    links = cut(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct()
    )
    labels = None
    while not links.isEmpty():
        parents = links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("label"))
        roots = links.select(F.col("a").alias("id")).distinct().join(parents, "id", "left_anti")
        tree = cut(parents.unionByName(roots.withColumn("label", F.col("id"))))
        while True:
            up = tree.select(F.col("id").alias("label"), F.col("label").alias("above"))
            step = cut(tree.join(up, "label").select("id", F.col("above").alias("label"), (F.col("above") < F.col("label")).alias("moved")))
            tree = step.select("id", "label")
            if step.filter("moved").isEmpty():
                break
        if labels is None:
            labels = tree
        else:
            up = tree.select(F.col("id").alias("label"), F.col("label").alias("above"))
            labels = cut(labels.join(up, "label", "left").select("id", F.coalesce("above", "label").alias("label")))
        end = lambda side: tree.select(F.col("id").alias(side), F.col("label").alias(f"root_{side}"))
        links = cut(
            links.join(end("a"), "a").join(end("b"), "b").filter("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        )
    return links.select(F.col("a").alias("id"), F.col("b").alias("label")) if labels is None else labels
