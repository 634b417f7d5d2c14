"""Connected components as joins: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiltmeter.session import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) in any direction, repeats and loops allowed -> (node, component), smallest node as component.

    A node without an edge to another node is not in the result; nulls are ignored. Every step is a grouped minimum
    and a join, written to the shared folder, so neither a component nor a node's neighbours meet in one task.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stage(pairs, "edges")
    before = _mark(pairs)
    while before[0]:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").unionAll(low.select("a", "m")).toDF("a", "b").distinct()
        pairs = stage(small, "edges")
        after = _mark(pairs)
        if after == before:
            break
        before = after
    return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
