"""Order, positions and slices of lists that are kept as rows.

One list may hold a third of all elements and need not fit a task, so nothing here
is keyed by the list alone: elements are dealt out by ranges of their order,
numbered within their range, and moved on by the elements of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmem.session import cut_lineage


def ranked(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Add `rank`, the place of each element in its list from 0, and `size`, the elements of its list.

    `keys` name the list; rows without them give none. `order` decides every place:
    its last column, such as the position, is unique in the list. What is gathered per
    list is one count for each range that holds a part of it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        rows.dropna(subset=keys)
        .repartitionByRange(parts, *keys, *order)
        .withColumn("_range", F.spark_partition_id())
    )
    counts = placed.groupBy("_range", *keys).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*keys)
    starts = counts.select(
        "_range",
        *keys,
        F.sum("_n").over(whole).alias("size"),
        (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_start"),
    )
    here = Window.partitionBy("_range", *keys).orderBy(*order)
    return (
        placed.withColumn("_n", F.row_number().over(here))
        .join(starts, ["_range", *keys])
        .withColumn("rank", F.col("_start") + F.col("_n") - 1)
        .drop("_range", "_n", "_start")
    )


def at(placed: DataFrame, *indexes: int) -> DataFrame:
    """Elements of `ranked` rows at the given indexes; negative ones count from the end."""
    wanted = F.array(*[F.lit(i) + (F.col("size") if i < 0 else F.lit(0)) for i in indexes])
    return placed.where(F.array_contains(wanted.cast("array<bigint>"), F.col("rank")))


def sliced(placed: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Elements of a slice of each list, with `ord`, their place in it.

    Bounds are open if None and count from the end if negative; a negative step goes
    backwards. Bounds beyond the list end at it.
    """
    if step == 0:
        raise ValueError("the step of a slice is not 0")
    size, rank = F.col("size"), F.col("rank")
    lowest, highest = (F.lit(0), size) if step > 0 else (F.lit(-1), size - 1)

    def bound(b: int) -> Column:
        return F.least(F.greatest(F.lit(b) + (size if b < 0 else F.lit(0)), lowest), highest)

    first = (lowest if step > 0 else highest) if start is None else bound(start)
    end = (highest if step > 0 else lowest) if stop is None else bound(stop)
    gone = rank - first if step > 0 else first - rank
    inside = (gone >= 0) & ((rank < end) if step > 0 else (rank > end)) & (gone % abs(step) == 0)
    return placed.where(inside).withColumn("ord", (gone / abs(step)).cast("bigint"))
