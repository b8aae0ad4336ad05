"""Schemas of document streams: types by path as state, and drift against a known profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmem.operators import schema


def type_counts(docs: DataFrame, max_depth: int) -> DataFrame:
    """`(path, jtype, n)` over all documents so far; for streams in update mode.

    The state has one row per path and type, however many documents pass. Nesting
    deeper than `max_depth` fails the batch and so loses nothing.
    """
    return schema.seen_types(docs, max_depth)


def profile_of(sent: DataFrame) -> DataFrame:
    """The profile after all updates sent: of each path and type the latest, which is the largest, count."""
    latest = sent.groupBy("path", "jtype").agg(F.max("n").alias("n"))
    return schema.merge_profiles(latest)


def drift(known: DataFrame, sent: DataFrame) -> DataFrame:
    """What the stream shows against a known profile (`schema.profile(..., containers=True)`).

    `removed` means not seen in the stream so far.
    """
    return schema.drift(known, profile_of(sent))
