"""Document stores, descriptions, blobs and records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmem.operators import tables as tb
from docmem.plans import query
from docmem.session import shared_dir
from docmem.sources import documents as dc
from docmem.sources import files, keyed
from docmem.sources import testdata as td


@query(
    "doc_lookup",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '{}' ELSE '{"quality":' || quality || ',"toxic":' || toxic || '}' END AS doc
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def doc_lookup(spark, sf):
    stored = td.table(spark, sf, "labels").select(
        F.col("doc_id").alias("db_id"), F.to_variant_object(F.struct("quality", "toxic")).alias("doc")
    )
    asked = td.table(spark, sf, "documents").select(F.col("doc_id").alias("db_id"))
    return dc.lookup(asked, stored).select(F.col("db_id").alias("doc_id"), F.to_json("doc").alias("doc"))


@query(
    "descriptions_read",
    """SELECT p_partkey AS db_id, unnest(['$.part.name', '$.part.type', '$.brand']) AS path,
unnest([p_name, p_type, p_brand]) AS description FROM part""",
)
def descriptions_read(spark, sf):
    doc = F.struct(
        F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("type")).alias("part"),
        F.col("p_brand").alias("brand"),
    )
    docs = td.busy(td.table(spark, sf, "part")).select(
        F.col("p_partkey").alias("db_id"), F.parse_json(F.to_json(doc)).alias("doc")
    )
    return dc.description_rows(docs, max_depth=3)


@query(
    "descriptions_upsert",
    """SELECT user_id AS db_id, '$.' || event_type || '.k' AS path,
arg_max(event_type || ' of ' || json_extract_string(props, '$.k'), event_id) AS description
FROM events WHERE value >= 20 GROUP BY ALL""",
)
def descriptions_upsert(spark, sf):
    k = F.get_json_object("props", "$.k")
    edits = td.table(spark, sf, "events").select(
        F.col("user_id").alias("db_id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("$."), "event_type", F.lit('[?k = "'), k, F.lit('"].k')).alias("path"),
        F.when(F.col("value") >= 20, F.concat("event_type", F.lit(" of "), k)).otherwise("").alias("description"),
    )
    return dc.upsert_descriptions(edits)


@query("csv_sentences", "SELECT conv_id, turn, text AS sentence FROM conversations")
def csv_sentences(spark, sf):
    """Texts written as CSV records and read back, commas and quotes included."""
    options = {"quote": '"', "escape": '"'}
    lines = td.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.to_csv(F.struct("conv_id", "text"), options).alias("line")
    )
    return lines.select(
        "conv_id", "turn", files.csv_field(F.col("line"), "id bigint, sentence string", "sentence").alias("sentence")
    )


@query("csv_column", "SELECT text AS sentence FROM conversations")
def csv_column(spark, sf):
    """CSV files with a header, written to the shared folder, and one column of them read back."""
    folder = f"{shared_dir(spark)}/docmem-csv-{uuid.uuid4().hex}"
    rows = td.table(spark, sf, "conversations").select("conv_id", F.col("text").alias("sentence"), "turn")
    rows.write.options(header="true", quote='"', escape='"').csv(folder)
    return files.read_csv_column(spark, folder, "sentence")


@query(
    "dump_collections",
    """SELECT source AS uid, 'texts' AS collection, to_json({'doc_id': doc_id, 'lang': lang, 'text': text})::VARCHAR AS doc FROM documents
UNION ALL SELECT 'user' || conv_id, 'turns', to_json({'turn': turn, 'role': role, 'text': text})::VARCHAR FROM conversations""",
)
def dump_collections(spark, sf):
    texts = td.table(spark, sf, "documents")
    turns = td.table(spark, sf, "conversations")
    a = texts.select("source", F.lit("texts").alias("collection"), F.to_json(F.struct("doc_id", "lang", "text")).alias("doc"))
    b = turns.select(
        F.concat(F.lit("user"), "conv_id").alias("source"),
        F.lit("turns").alias("collection"),
        F.to_json(F.struct("turn", "role", "text")).alias("doc"),
    )
    return a.unionByName(b).withColumnRenamed("source", "uid")


URL = r"^[a-z]+://([^/]+)(/[^?#]*)"


@query(
    "blob_upsert_latest",
    f"""SELECT regexp_extract(url, '{URL}', 1) AS uid, regexp_extract(url, '{URL}', 2) AS path,
arg_max(html, page_id) AS data FROM pages GROUP BY ALL""",
)
def blob_upsert_latest(spark, sf):
    log = td.table(spark, sf, "pages").select(
        F.regexp_extract("url", URL, 1).alias("uid"),
        F.regexp_extract("url", URL, 2).alias("path"),
        F.col("page_id").alias("seq"),
        F.col("html").alias("data"),
    )
    return keyed.upsert_blobs(log)


@query(
    "docs_create",
    """SELECT md5(to_json(['users', c_name])::VARCHAR) AS uid, NULL AS id, c_name AS name FROM customer
UNION ALL SELECT NULL, md5(to_json(['shops', s_name])::VARCHAR), s_name FROM supplier""",
)
def docs_create(spark, sf):
    users = keyed.create(td.table(spark, sf, "customer").select(F.col("c_name").alias("name")), "users", "name")
    shops = keyed.create(td.table(spark, sf, "supplier").select(F.col("s_name").alias("name")), "shops", "name")
    return tb.widen(users, shops).select("uid", "id", "name")


@query(
    "docs_get",
    "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def docs_get(spark, sf):
    keys = td.table(spark, sf, "documents").select("doc_id")
    return keyed.get(td.table(spark, sf, "labels"), keys, "doc_id")


@query(
    "docs_partial_update",
    """SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_acctbal ELSE top END AS c_acctbal,
CASE WHEN n >= 12 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN
(SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def docs_partial_update(spark, sf):
    """A customer's best order becomes the balance; twelve orders clear the segment."""
    patches = (
        td.table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.count("*").alias("n"), F.max("o_totalprice").alias("c_acctbal"))
        .withColumn("c_mktsegment", F.lit(None).cast("string"))
    )
    customers = td.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return tb.patch_rows(
        customers, patches, "c_custkey", {"c_acctbal": F.lit(True), "c_mktsegment": F.col("p.n") >= 12}
    )


@query(
    "docs_delete",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def docs_delete(spark, sf):
    gone = (
        td.table(spark, sf, "orders")
        .where(F.col("o_orderstatus") == "F")
        .select(F.col("o_custkey").alias("c_custkey"))
        .distinct()
    )
    return tb.delete_rows(td.table(spark, sf, "customer").select("c_custkey", "c_name"), gone, "c_custkey")
