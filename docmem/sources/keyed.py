"""Keyed record stores: blobs by owner and path, records by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_blobs(log: DataFrame) -> DataFrame:
    """Latest `data` per `(uid, path)` of a put log `(uid, path, seq, data)`."""
    return log.groupBy("uid", "path").agg(F.max_by("data", "seq").alias("data"))


def get_blob(blobs: DataFrame, uid: object, path: str) -> DataFrame:
    return blobs.where((F.col("uid") == uid) & (F.col("path") == path))


def new_id(collection: Column, *parts: Column) -> Column:
    """A repeatable id from the record's own values, so that a retry makes no second one."""
    return F.md5(F.to_json(F.array(collection, *[p.cast("string") for p in parts])))


def create(records: DataFrame, collection: str, *identity: str) -> DataFrame:
    """Records with a generated id: field `uid` in `users`, `id` elsewhere."""
    made = new_id(F.lit(collection), *[F.col(c) for c in identity])
    field = "uid" if collection == "users" else "id"
    return records.withColumn(field, made)


def get(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Batch lookup: every requested key with its record, or NULLs when missing."""
    return keys.join(table, key, "left")
