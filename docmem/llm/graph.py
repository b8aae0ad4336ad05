"""Connected components by large and small stars, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it is connected with.

    Each round hangs all larger neighbours of a node on its smallest one, then all
    smaller ones; minima combine on the map side, and a node with very many
    neighbours is split by the skew handling of joins. Rounds end when nothing
    changes. Loops and repeated edges are allowed; NULL ends are dropped.
    """
    now = tables.written(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if before == mark or not mark[0]:
            break
        before = mark
        # large star: both directions, larger neighbours go to the smallest of the neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = tables.written(
            both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        joined = large.join(low, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after = tables.written(
            small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        )
        tables.discard(now, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        tables.again(now).select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
