"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", app: str = "docmem") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session without the setting (a local test) gets a folder of its own.
    """
    where = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docmem-checkpoint-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from that table.

    Unlike an RDD checkpoint the table is columnar, so later passes read only
    the columns they use, and its size is known to the planner.
    """
    spark = df.sparkSession
    table = f"{shared_dir(spark)}/docmem-{uuid.uuid4().hex}"
    df.write.parquet(table)
    return spark.read.schema(df.schema).parquet(table)


def cut_wide(df: DataFrame) -> DataFrame:
    """`cut_lineage` of a table as long as its input, which no join may broadcast.

    The planner takes a table for as small as its files. Repeated texts and numbers in order
    take a tenth or less there of what they take in memory, and a broadcast passes through the driver.
    """
    return cut_lineage(df).hint("merge")


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no plan reads any more, through Spark's own file systems."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
