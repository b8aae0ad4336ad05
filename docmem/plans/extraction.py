"""Facts from text and records from tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from docmem.operators import extract
from docmem.plans import query
from docmem.sources import testdata as td


@query(
    "extract_edits",
    " UNION ALL ".join(
        f"""SELECT db_id, path, ord, to_json(fact)::VARCHAR AS data FROM (SELECT doc_id AS db_id, '{path}' AS path,
generate_subscripts(f, 1) - 1 AS ord, unnest(f) AS fact FROM
(SELECT doc_id, regexp_extract_all(text, '{pattern}', {group}) AS f FROM documents))"""
        for path, pattern, group in extract.FACTS
    ),
)
def extract_edits(spark, sf):
    texts = td.busy(td.table(spark, sf, "documents")).select(F.col("doc_id").alias("db_id"), "text")
    return extract.extract_edits(texts)


def line_facts(batch: pd.DataFrame) -> pd.DataFrame:
    """A user's extractor: counts over the text of each document."""
    return pd.DataFrame(
        {
            "doc_id": batch["doc_id"],
            "n_lines": batch["text"].str.count("\n") + 1,
            "n_commas": batch["text"].str.count(","),
            "first_line": batch["text"].str.split("\n", n=1).str[0],
        }
    )


@query(
    "extract_with_udf",
    """SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(string_split(text, ',')) - 1 AS n_commas,
string_split(text, chr(10))[1] AS first_line FROM documents""",
)
def extract_with_udf(spark, sf):
    texts = td.busy(td.table(spark, sf, "documents")).select("doc_id", "text")
    return extract.extract_with(texts, line_facts, "doc_id bigint, n_lines bigint, n_commas bigint, first_line string")


@query(
    "ingest_records",
    """SELECT c_nationkey AS db_id, c_custkey AS seq, '$.' || lower(c_mktsegment) AS path,
'[{"name":"' || c_name || '","rich":' || (c_acctbal >= 5000)::VARCHAR || '}]' AS data FROM customer""",
)
def ingest_records(spark, sf):
    records = td.table(spark, sf, "customer").select(
        "c_nationkey",
        "c_custkey",
        F.lower("c_mktsegment").alias("kind"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") >= 5000).alias("rich"),
    )
    return extract.records_to_edits(records, "c_nationkey", "c_custkey", "kind")
