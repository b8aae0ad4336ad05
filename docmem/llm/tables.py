"""Intermediate tables in the shared folder, rows with ids, and exact global ranks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def written(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from that table.

    The table outlives lost executors. `discard` removes it once nothing reads it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docmem-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def again(df: DataFrame) -> DataFrame:
    """A second reader of a `written` table, to be joined with the first."""
    return df.sparkSession.read.schema(df.schema).parquet(df._written_to)


def discard(*frames: DataFrame) -> None:
    """Remove tables of `written` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def dealt(df: DataFrame) -> DataFrame:
    """Deal the rows of a few files out to all cores; a scan of more tasks than cores stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ranked(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """Add `name`, the place from 0 of each row in the order of the columns.

    Rows are dealt out by ranges, numbered within their range, and moved by the
    sizes of the ranges before; only one count per range meets in one place.
    Equal rows take consecutive places, and may be split over ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    tie, part, n, start = (fresh(df, c) for c in ("_tie", "_part", "_n", "_before"))
    placed = written(
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys, tie)
        .withColumn(part, F.spark_partition_id())
    )
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    starts = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(part).orderBy(*keys, tie)
    return (
        placed.withColumn(n, F.row_number().over(within))
        .join(F.broadcast(starts), part)  # one row per range
        .withColumn(name, F.col(start) + F.col(n) - 1)
        .drop(tie, part, n, start)
    )
