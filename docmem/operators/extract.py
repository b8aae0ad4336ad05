"""Facts out of text: a user-supplied extractor, and a fixed one by patterns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmem.functions.jsontext import quote

# Fixed patterns: list path, pattern, group that holds the fact.
FACTS = (
    ("$.emails", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0),
    ("$.links", r"https?://[A-Za-z0-9./?=&#_%-]+", 0),
    ("$.phones", r"(?:\+[0-9]{1,3}[ -])?[0-9]{3}[ -][0-9]{3}[ -][0-9]{3,4}|\+[0-9]{3}[ -][0-9]{3}[ -][0-9]{3,4}|\+[0-9]{9,15}", 0),
    ("$.dates", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0),
    ("$.last_names", r"last name is (\pL[\pL-]*)", 1),
    ("$.places", r"lives in (\pL[\pL-]*(?: \p{Lu}[\pL-]*)*)", 1),
    ("$.birthdays", r"birthday is ([A-Za-z0-9 ]+)", 1),
    ("$.likes", r"likes ([^.,;:!?\n]+)", 1),
)


def extract_edits(texts: DataFrame) -> DataFrame:
    """List edits `(db_id, path, ord, data)` for the facts in `(db_id, text)`.

    All patterns run in one pass over the text; `ord` counts the facts of one
    path in the order they appear.
    """
    found = F.array(
        *[
            F.struct(F.lit(path).alias("path"), F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("facts"))
            for path, pattern, group in FACTS
        ]
    )
    per_path = texts.select("db_id", F.explode(found).alias("f")).where(F.size("f.facts") > 0)
    return per_path.select("db_id", "f.path", F.posexplode("f.facts").alias("ord", "fact")).select(
        "db_id", "path", "ord", quote("fact").alias("data")
    )


def extract_log(texts: DataFrame) -> DataFrame:
    """A log `(db_id, seq, path, data)` of the facts in `(db_id, seq, text)`, ready to be folded.

    The facts of one path in one text are one list edit; edits of a text keep its
    place in the order of `seq`.
    """
    number = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FACTS) for x in (f[0], i)]), F.col("path"))
    rows = texts.select(F.struct("db_id", "seq").alias("db_id"), "text")
    facts = extract_edits(rows).groupBy("db_id", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "data"))).alias("f"))
    listed = F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: x["data"]), ","), F.lit("]"))
    return facts.select(
        "db_id.db_id", (F.col("db_id.seq") * len(FACTS) + number).alias("seq"), "path", listed.alias("data")
    )


def extract_with(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str
) -> DataFrame:
    """Run a user's extractor over Arrow batches; `schema` types its output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def records_to_edits(df: DataFrame, db_id: str, seq: str, kind: str) -> DataFrame:
    """Semi-structured records to list edits: each lands under the list of its kind."""
    rest = [c for c in df.columns if c not in (db_id, seq, kind)]
    return df.select(
        F.col(db_id).alias("db_id"),
        F.col(seq).alias("seq"),
        F.concat(F.lit("$."), F.col(kind)).alias("path"),
        F.concat(F.lit("["), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), F.lit("]")).alias("data"),
    )
