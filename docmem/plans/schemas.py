"""Schema inference, drift, validation, tree nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.operators import nodes, schema, validate
from docmem.plans import query
from docmem.sources import documents as dc
from docmem.sources import testdata as td

_PROFILE_TEXT = """SELECT * FROM (
SELECT '$.source' AS path, count(*) AS n, 'string' AS types FROM documents
UNION ALL SELECT '$.lang', count(*), 'string' FROM documents
UNION ALL SELECT '$.stats.chars', count(*), 'integer' FROM documents
UNION ALL SELECT '$.lines[*].n', sum(len(string_split(text, chr(10))))::BIGINT, 'integer' FROM documents
UNION ALL SELECT '$.lines[*].chars', sum(len(string_split(text, chr(10))))::BIGINT, 'integer' FROM documents
UNION ALL SELECT '$.lines[*].text', sum(len(string_split(text, chr(10))))::BIGINT, 'string' FROM documents)"""


@query(
    "schema_infer",
    """SELECT event_type, 'OBJECT<' || string_agg(DISTINCT key || ': ' || CASE json_type(props, '$.' || key)
WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'BIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DOUBLE' ELSE 'STRING' END, ', ') || '>' AS schema
FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) GROUP BY event_type""",
)
def schema_infer(spark, sf):
    docs = td.table(spark, sf, "events").select("event_type", F.parse_json("props").alias("doc"))
    return schema.infer(docs, "event_type")


@query("schema_path_profile", _PROFILE_TEXT)
def schema_path_profile(spark, sf):
    return schema.profile(td.text_docs(spark, sf), max_depth=3).withColumn("types", F.array_join("types", "|"))


@query(
    "schema_compressed",
    """SELECT '{"lang":"string","lines":[{"chars":"integer","n":"integer","text":"string"}],"source":"string","stats":{"chars":"integer"}}' AS schema
FROM documents LIMIT 1""",
)
def schema_compressed(spark, sf):
    return schema.compress(schema.profile(td.text_docs(spark, sf), max_depth=3), max_depth=4)


@query(
    "schema_field_presence",
    """SELECT path, count(*) AS n, count(*) / (SELECT count(*) FROM customer) AS ratio FROM (
SELECT '$.name' AS path FROM customer UNION ALL SELECT '$.balance' FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT '$.segment' FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY path""",
)
def schema_field_presence(spark, sf):
    record = F.struct(
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )
    docs = td.busy(td.table(spark, sf, "customer")).select(
        F.col("c_custkey").alias("db_id"), F.parse_json(F.to_json(record)).alias("doc")
    )
    return schema.presence(docs, max_depth=2)


@query(
    "schema_drift",
    """SELECT path, old_types, new_types, change FROM (VALUES
('$.nation', 'integer', 'string', 'retyped'), ('$.market.segment', 'string', NULL, 'removed'), ('$.market', 'object', NULL, 'removed'),
('$.supplier', NULL, 'boolean', 'added')) t(path, old_types, new_types, change)""",
)
def schema_drift(spark, sf):
    return schema.drift(
        schema.profile(td.customer_docs(spark, sf), max_depth=3, containers=True),
        schema.profile(td.supplier_docs(spark, sf), max_depth=3, containers=True),
    )


@query(
    "schema_conflicts",
    """SELECT '$.nation' AS path, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n,
'integer|string' AS types UNION ALL
SELECT '$.market', (SELECT count(*) FROM customer) + (SELECT count(*) FROM part), 'integer|object'""",
)
def schema_conflicts(spark, sf):
    sizes = td.table(spark, sf, "part").select(
        F.col("p_partkey").alias("db_id"), F.to_variant_object(F.struct(F.col("p_size").alias("market"))).alias("doc")
    )
    both = td.customer_docs(spark, sf).unionByName(td.supplier_docs(spark, sf)).unionByName(sizes)
    return schema.conflicts(schema.profile(both, max_depth=3, containers=True)).withColumn("types", F.array_join("types", "|"))


@query(
    "schema_with_descriptions",
    """SELECT c_custkey AS db_id, path, 1 AS n, types, description FROM (VALUES ('$.name', 'string'), ('$.nation', 'integer'),
('$.balance', 'number'), ('$.market.segment', 'string')) t(path, types), customer
LEFT JOIN (SELECT r_regionkey AS owner, '$.' || key AS key, key || ' in ' || r_name AS description
FROM region, (VALUES ('name'), ('nation')) k(key)) ON owner = c_custkey AND key = path""",
)
def schema_with_descriptions(spark, sf):
    prof = schema.profile(td.customer_docs(spark, sf), max_depth=3, by=("db_id",)).withColumn("types", F.array_join("types", "|"))
    notes = td.table(spark, sf, "region").select(
        F.col("r_regionkey").alias("seq"),
        F.explode(F.array(F.lit("name"), F.lit("nation"))).alias("key"),
        F.col("r_name"),
    )
    descriptions = notes.select(
        F.col("seq").alias("db_id"),
        "seq",
        F.concat(F.lit("$."), "key").alias("path"),
        F.concat("key", F.lit(" in "), "r_name").alias("description"),
    )
    return schema.with_descriptions(prof, dc.upsert_descriptions(descriptions))


@query(
    "schema_from_first_doc",
    """SELECT source, unnest(['$.lang', '$.lines', '$.source', '$.stats.chars']) AS path,
unnest(['string', 'array', 'string', 'integer']) AS jtype FROM (SELECT DISTINCT source FROM documents)""",
)
def schema_from_first_doc(spark, sf):
    docs = td.text_docs(spark, sf).withColumn("source", F.variant_get("doc", "$.source", "string"))
    return schema.listing(schema.first_doc(docs, "source", "db_id"), ["source"], max_depth=3)


@query(
    "first_doc_per_collection",
    "SELECT source, min(doc_id) AS doc_id, min_by(text, doc_id) AS text FROM documents GROUP BY source",
)
def first_doc_per_collection(spark, sf):
    docs = td.table(spark, sf, "documents").select("source", "doc_id", "text")
    return schema.first_doc(docs, "source", "doc_id")


_RAW = """(SELECT user_id AS db_id, event_id AS seq, '$.' || event_type AS path, props AS data FROM events
UNION ALL SELECT p_partkey, p_partkey, '$.' || p_name, p_size::VARCHAR FROM part
UNION ALL SELECT conv_id, turn, '$.' || role, text FROM conversations)"""
_PATH_OK = r"regexp_full_match(path, '\$(\.[A-Za-z_][A-Za-z0-9_-]*)+')"


@query("edits_valid", f"SELECT * FROM {_RAW} WHERE {_PATH_OK} AND json_valid(data)")
def edits_valid(spark, sf):
    return validate.valid(validate.check_edits(td.raw_edits(spark, sf)))


@query(
    "edits_quarantine",
    f"""SELECT db_id, seq, path, data, CASE WHEN NOT {_PATH_OK} THEN 'path' ELSE 'data' END AS fault
FROM {_RAW} WHERE NOT ({_PATH_OK} AND json_valid(data))""",
)
def edits_quarantine(spark, sf):
    return validate.quarantine(validate.check_edits(td.raw_edits(spark, sf)))


@query(
    "requests_valid",
    """SELECT p_partkey, p_size >= 10 AND p_type <> 'PROMO' AS ok FROM part
UNION ALL SELECT p_partkey, true FROM part""",
)
def requests_valid(spark, sf):
    part = td.table(spark, sf, "part")
    asked = part.select(
        "p_partkey",
        F.array(
            F.concat(F.lit("$."), F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(F.col("p_type"))),
            F.when(F.col("p_size") >= 10, "$.parts[?size >= 10].name").otherwise("$.parts[?size"),
        ).alias("path_list"),
    )
    good = part.select(
        "p_partkey",
        F.array(
            F.concat(F.lit("$.parts[?brand = '"), "p_brand", F.lit("'].name")),
            F.concat(F.lit("$.parts["), "p_size", F.lit("].."), F.lower("p_type")),
            F.lit("$.parts[\\price,/name]"),
            F.lit("$.parts[*].name.`len`"),
        ).alias("path_list"),
    )
    return validate.check_requests(asked.unionByName(good)).select("p_partkey", "ok")


@query(
    "tree_nodes",
    """SELECT doc_id, 'root' AS path, '{"source":"' || source || '","lang":"' || lang || '"}' AS node FROM documents
UNION ALL SELECT doc_id, 'stats', '{"chars":' || n_chars || '}' FROM documents
UNION ALL SELECT doc_id, 'lines[' || (n - 1) || '] (' || substr('n: ' || n || ', chars: ' || length(text) || ', text: ' || text, 1, 50) || ')',
'{"n":' || n || ',"chars":' || length(text) || ',"text":' || to_json(text) || '}'
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents)""",
)
def tree_nodes(spark, sf):
    out = nodes.tree_nodes(ordered_text_docs(spark, sf), max_depth=4)
    return out.select(F.col("db_id").alias("doc_id"), "path", "node")


def ordered_text_docs(spark, sf):
    """Text documents as JSON text, keys in the order they were written."""
    lines = F.transform(
        F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), F.length(x).alias("chars"), x.alias("text"))
    )
    doc = F.struct("source", "lang", F.struct(F.col("n_chars").alias("chars")).alias("stats"), lines.alias("lines"))
    docs = td.busy(td.table(spark, sf, "documents"))
    return docs.select(F.col("doc_id").alias("db_id"), F.to_json(doc).alias("doc"))


@query(
    "duplicate_nodes",
    """SELECT sha256(node) AS fp, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
SELECT doc_id, '{"source":"' || source || '","lang":"' || lang || '"}' AS node FROM documents
UNION ALL SELECT doc_id, '{"chars":' || n_chars || '}' FROM documents
UNION ALL SELECT doc_id, '{"n":' || n || ',"chars":' || length(text) || ',"text":' || to_json(text) || '}'
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents))
GROUP BY node HAVING count(*) > 1""",
)
def duplicate_nodes(spark, sf):
    return nodes.duplicates(nodes.tree_nodes(ordered_text_docs(spark, sf), max_depth=4))


_REGION = """'{"name":"' || r_name || '"}'"""
_NATION = f"""'{{"name":"' || n_name || '","region":' || {_REGION} || '}}'"""
_TAG = """'{"tag":"' || c_mktsegment || '"}'"""
_PLACE = f"""'{{"band":' || floor(c_acctbal)::BIGINT || ',"nation":' || {_NATION} || ',"tags":[' || {_TAG} || ']}}'"""


@query(
    "duplicate_subtrees",
    f"""WITH c AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
nodes AS (SELECT c_custkey, '{{"name":"' || c_name || '","place":' || {_PLACE} || '}}' AS node, NULL AS parent FROM c
UNION ALL SELECT c_custkey, {_PLACE}, '{{"name":"' || c_name || '","place":' || {_PLACE} || '}}' FROM c
UNION ALL SELECT c_custkey, {_NATION}, {_PLACE} FROM c UNION ALL SELECT c_custkey, {_REGION}, {_NATION} FROM c
UNION ALL SELECT c_custkey, '[' || {_TAG} || ']', {_PLACE} FROM c UNION ALL SELECT c_custkey, {_TAG}, '[' || {_TAG} || ']' FROM c),
seen AS (SELECT node, count(*) AS n, count(DISTINCT c_custkey) AS n_docs FROM nodes GROUP BY node HAVING count(*) > 1)
SELECT sha256(node) AS fp, n, n_docs, count(*) AS n_top FROM seen JOIN nodes USING (node)
WHERE parent IS NULL OR parent NOT IN (SELECT node FROM seen) GROUP BY ALL""",
)
def duplicate_subtrees(spark, sf):
    return nodes.duplicate_subtrees(nodes.subtrees(td.place_docs(spark, sf), max_depth=5))
