"""Document stores: a folder of JSON files, saved documents, descriptions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmem.functions.jsontext import is_json
from docmem.functions.paths import simplify
from docmem.operators.leaves import explode_leaves
from docmem.session import cut_lineage


def _folder_texts(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    named = files.select(F.url_decode(name).alias("db_id"), F.col("value").alias("text"))
    return named.where(~F.col("db_id").endswith("-desc")).withColumn("fine", is_json("text"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """`{db_id}.json` files as `(db_id, doc)`; description files are left out, broken ones are in `folder_faults`."""
    return _folder_texts(spark, folder).where("fine").select("db_id", F.parse_json("text").alias("doc"))


def folder_faults(spark: SparkSession, folder: str) -> DataFrame:
    """`(db_id, text)` of files that are no JSON value or repeat a key."""
    return _folder_texts(spark, folder).where("NOT fine").select("db_id", "text")


def read_descriptions(spark: SparkSession, folder: str) -> DataFrame:
    """`{db_id}-desc.json` files as `(db_id, path, description)`."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)-desc\.json$", 1)
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*-desc.json")
    return description_rows(
        files.select(F.url_decode(name).alias("db_id"), F.parse_json("value").alias("doc"))
    )


def description_rows(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Text leaves of description documents."""
    return explode_leaves(docs.select("db_id", "doc"), max_depth=max_depth).select(
        "db_id", "path", F.try_variant_get("v", "$", "string").alias("description")
    ).where(F.col("path") != "$")


def lookup(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """The document of each requested key; an unknown key has the empty one."""
    return requests.select("db_id").join(docs.select("db_id", "doc"), "db_id", "left").select(
        "db_id", F.coalesce("doc", F.parse_json(F.lit("{}"))).alias("doc")
    )


def upsert_descriptions(edits: DataFrame) -> DataFrame:
    """Latest non-empty description per simplified path."""
    return (
        edits.where(F.coalesce(F.col("description"), F.lit("")) != "")
        .withColumn("path", simplify("path"))
        .groupBy("db_id", "path")
        .agg(F.max_by("description", "seq").alias("description"))
    )


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("db_id"), F.lit(buckets)).cast("int")


def _layout(spark: SparkSession, folder: str) -> tuple[int, int] | None:
    """(buckets, files per bucket) of a stored folder, None where nothing is stored."""
    try:
        row = spark.read.parquet(f"{folder}/_layout").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row.buckets, row.files


def save(docs: DataFrame, folder: str, buckets: int = 256, files_per_bucket: int = 1) -> None:
    """Write documents `(db_id, doc)`; those already in the folder under other keys stay.

    The layout is by a hash of the key, never one folder per key. Choose
    `buckets * files_per_bucket` so that a file has some hundred megabytes; the
    choice of the first save is kept with the folder and holds for all later ones.
    """
    spark = docs.sparkSession
    if _layout(spark, folder) is not None:
        replace(spark, folder, docs)
        return
    _write(docs, folder, buckets, files_per_bucket)
    spark.createDataFrame([(buckets, files_per_bucket)], "buckets int, files int").coalesce(1).write.parquet(f"{folder}/_layout")


def _write(docs: DataFrame, folder: str, buckets: int, files_per_bucket: int) -> None:
    """Replace every bucket that the documents fall into."""
    spread = F.pmod(F.xxhash64("db_id", F.lit(1)), F.lit(files_per_bucket))
    (
        docs.select(_bucket(buckets).alias("bucket"), "db_id", "doc")
        .repartition("bucket", spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(folder)
    )


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("db_id", "doc")


def replace(spark: SparkSession, folder: str, changed: DataFrame) -> None:
    """Replace or add whole documents; only the buckets they touch are rewritten."""
    layout = _layout(spark, folder)
    if layout is None:
        raise ValueError(f"no documents are stored under {folder}")
    buckets, files_per_bucket = layout
    stored = spark.read.parquet(folder)
    touched = changed.select(_bucket(buckets).alias("bucket")).distinct()
    kept = (
        stored.join(touched, "bucket", "left_semi")
        .join(changed.select("db_id"), "db_id", "left_anti")
        .select("db_id", "doc")
    )
    # the result is written aside first: it reads the files it replaces
    _write(cut_lineage(kept.unionByName(changed.select("db_id", "doc"))), folder, buckets, files_per_bucket)
