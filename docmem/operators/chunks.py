"""Texts to searchable chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def qa_chunks(sets: DataFrame, keep: list[str]) -> DataFrame:
    """Question and answer arrays to one chunk per pair: question, newline, answer.

    Sets whose arrays differ in length are the caller's to set aside first
    (`validate.check_qa`); empty sets give no chunk.
    """
    pairs = sets.where(F.size("question") > 0).select(
        *keep, F.posexplode(F.arrays_zip("question", "answers")).alias("pos", "qa")
    )
    return pairs.select(*keep, "pos", F.concat_ws("\n", "qa.question", "qa.answers").alias("content"))


def sentence_chunks(texts: DataFrame) -> DataFrame:
    """Non-blank lines of `(uid, text_id, text)` as `(uid, text_id, line, content)`; `(text_id, line)` is their id."""
    lines = texts.select("uid", "text_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return lines.where(F.trim("content") != "")


def stamp(chunks: DataFrame, **metadata: str) -> DataFrame:
    """Add the owner, and further columns by name, to the chunk metadata."""
    entries = [F.lit("uid"), F.col("uid").cast("string")]
    for key, column in metadata.items():
        entries += [F.lit(key), F.col(column).cast("string")]
    old = F.col("metadata") if "metadata" in chunks.columns else F.create_map().cast("map<string,string>")
    kept = F.map_filter(old, lambda k, v: ~k.isin("uid", *metadata))
    return chunks.withColumn("metadata", F.map_concat(kept, F.create_map(*entries)))


def ingest(chunks: DataFrame, ids: tuple[str, ...] = ("chunk_id",), into: DataFrame | None = None) -> DataFrame:
    """Distinct contents per owner with the ids and metadata of their first chunk and the number of copies.

    Contents meet by their hash, on the map side first, so a content that makes up
    a third of all chunks reaches the final task as one row per map task. With
    `into`, an earlier result, only contents new to their owner are given.
    """
    rest = ["content", *(c for c in ("metadata",) if c in chunks.columns)]
    first = F.min_by(F.struct(*ids, *rest), F.struct(*ids))
    out = chunks.groupBy("uid", F.sha2("content", 256).alias("fp")).agg(first.alias("first"), F.count("*").alias("copies"))
    out = out.select("uid", "first.*", "copies", "fp")
    return out if into is None else out.join(into.select("uid", "fp"), ["uid", "fp"], "left_anti").select(*out.columns)
