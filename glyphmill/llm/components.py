"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import discard, files_for, materialize


def components(edges: DataFrame, files: int | None = None, rounds: int = 64) -> DataFrame:
    """(``id``, ``component``) for each end of the edges (``a``, ``b``): the smallest id that links reach.

    Each round hooks every label to its smallest neighbour, follows two pointers and replaces the
    edges by those that still join different labels, so the edge list shrinks at least by half as
    long as any is left. Nothing but one count a round reaches the driver. Aggregates are partial
    before the shuffle and joins are plain equi-joins, which adaptive execution splits at hot labels.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), files or files_for(spark))
    files = files_for(spark, rows=2 * edges.count())
    labels = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id")), files)
    for _ in range(rounds):
        if edges.isEmpty():
            return labels
        both = edges.select("a", "b").union(edges.select("b", "a"))
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        first = hook = materialize(hook, files)
        for _ in range(2):
            next_ = hook.select(F.col("a").alias("to"), F.col("to").alias("root"))
            hook = hook.join(next_, "to", "left").select("a", F.coalesce("root", "to").alias("to"))
        hook = materialize(hook, files)
        at = lambda c: hook.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(at("a"), "a").join(at("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        new_edges = materialize(moved.where("a <> b").distinct(), files)
        new_labels = materialize(labels.join(at("component"), "component", "left").select("id", F.coalesce("component_to", "component").alias("component")), files)
        for done in (edges, labels, first, hook):
            discard(done)
        edges, labels = new_edges, new_labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
