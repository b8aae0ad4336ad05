"""Shards along a Hilbert curve over document metadata.

Source, language and size are quantised to equally full levels, the levels are
put in the order of a Hilbert curve, and the curve is cut into runs of equal
length. Documents of one shard are then close in all three dimensions at once,
so file statistics on any of them can skip shards.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hilbert, tables

BITS = 5


def text_bounds(df: DataFrame, c: str, steps: int) -> list[str | None]:
    """At most `steps` values of a text column that cut its rows, in the order of the values, into equal parts.

    One row per value is put in order by ranges; rows before a value are counted
    within its range and by the sizes of the ranges before. Values are compared whole.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = tables.written(
        df.groupBy(F.col(c).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .repartitionByRange(parts, F.col("value").asc_nulls_first())
        .withColumn("part", F.spark_partition_id())
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = values.groupBy("part").agg(F.sum("n").alias("size"))
    # one row per range
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("part").orderBy(F.col("value").asc_nulls_first())
    upto = F.col("start") + F.sum("n").over(within)
    cuts = (
        tables.again(values)
        .join(F.broadcast(starts), "part")
        .withColumn("upto", upto)
        .where(F.expr(f"upto * {steps}L div total > (upto - n) * {steps}L div total"))
        .orderBy(F.col("value").asc_nulls_first())
        .select("value")
    )
    return [x.value for x in cuts.collect()]  # at most `steps` rows


def _above(c: str, bound: str | float | None) -> Column:
    """Does the row lie above the bound? NULL lies below all values."""
    if bound is None:
        return F.col(c).isNotNull()
    return F.coalesce(F.col(c) > F.lit(bound), F.lit(False))


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Add `curve`, the Hilbert index over equally full levels of the columns.

    The level bounds are at most 2^bits values per dimension: exact for texts, which
    are compared whole, and approximate quantiles for numbers, a sketch of fixed size
    taken over all rows. A column `curve` of the input is replaced.
    """
    kinds = dict(df.dtypes)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [c for c in dims if kinds[c] != "string"]
    seen = df.agg(F.count(F.lit(1)), *[F.percentile_approx(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))), shares, 2000) for c in numbers]).first()
    bounds = {c: [None if b == float("-inf") else b for b in sorted(set(found or []))] for c, found in zip(numbers, seen[1:])}
    levels = []
    for c in dims:
        steps = bounds[c] if c in bounds else text_bounds(df, c, 1 << bits)
        level = sum((_above(c, b).cast("int") for b in steps), F.lit(0))
        levels.append(F.least(level, F.lit((1 << bits) - 1)))
    return df.withColumn("curve", hilbert.index_column(levels, bits))


def shards(df: DataFrame, dims: list[str], n_shards: int = 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add `curve`, `shard` and `slot`: runs of the curve, their sizes at most one row apart.

    Rows at the same place of the curve follow `ties`; equal rows may take each
    other's place, which gives the same result. With fewer rows than shards some
    shards stay empty. NULL in a dimension sorts below all values. Columns of these three
    names in the input are replaced; all others stay.
    """
    rank = tables.fresh(df, "_rank")
    placed = tables.ranked(curve(df, dims), "curve", *ties, name=rank)
    total = df.count()
    # integer arithmetic: the first row of shard s is ceil(s * total / n_shards)
    shard = F.expr(f"int({rank} * {n_shards}L div {max(1, total)}L)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.withColumn("shard", shard).withColumn("slot", F.col(rank) - first).drop(rank)


def write_shards(df: DataFrame, path: str, dims: list[str], n_shards: int = 16) -> None:
    """One folder per shard, rows inside in curve order."""
    placed = shards(df, dims, n_shards)
    placed.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
