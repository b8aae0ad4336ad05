"""Chunk and vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.operators import chunks as ck
from docmem.operators import convo, vectors
from docmem.plans import query
from docmem.sources import testdata as td

# DuckDB: questions and answers of a whole conversation in order.
_QA = """(SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'user') AS question,
list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY ALL)"""


@query(
    "qa_length_check",
    f"""SELECT conv_id, len(coalesce(question, [])) AS n_questions, len(coalesce(answers, [])) AS n_answers,
len(coalesce(question, [])) = len(coalesce(answers, [])) AS ok FROM {_QA}""",
)
def qa_length_check(spark, sf):
    return convo.qa_counts(td.said(spark, sf)).withColumnRenamed("thread_id", "conv_id")


@query(
    "qa_chunks",
    f"""SELECT conv_id, generate_subscripts(question, 1) - 1 AS pos, unnest(question) || chr(10) || unnest(answers) AS content
FROM {_QA} WHERE len(question) = len(answers)""",
)
def qa_chunks(spark, sf):
    pairs = convo.qa_pairs(td.said(spark, sf))
    return pairs.select(F.col("thread_id").alias("conv_id"), "pos", F.concat_ws("\n", "question", "answer").alias("content"))


_LINES = """(SELECT source AS uid, lang, doc_id AS text_id, n - 1 AS line, content FROM
(SELECT source, lang, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n,
unnest(string_split(text, chr(10))) AS content FROM documents) WHERE trim(content, ' ') <> '')"""


def _lines(spark, sf):
    docs = td.table(spark, sf, "documents")
    return ck.sentence_chunks(docs.select(F.col("source").alias("uid"), F.col("doc_id").alias("text_id"), "text"))


@query("sentence_chunks", f"SELECT uid, text_id, line, content FROM {_LINES}")
def sentence_chunks(spark, sf):
    return _lines(spark, sf)


@query(
    "chunk_metadata",
    "SELECT doc_id AS chunk_id, lang, source AS owner, n_chars::VARCHAR AS size FROM documents",
)
def chunk_metadata(spark, sf):
    docs = td.table(spark, sf, "documents").select(
        F.col("source").alias("uid"),
        F.col("doc_id").alias("chunk_id"),
        "lang",
        F.create_map(F.lit("size"), F.col("n_chars").cast("string"), F.lit("uid"), F.lit("nobody")).alias("metadata"),
    )
    m = ck.stamp(docs, lang="lang")
    return m.select("chunk_id", m.metadata["lang"].alias("lang"), m.metadata["uid"].alias("owner"), m.metadata["size"].alias("size"))


@query(
    "ingest_chunks",
    f"""SELECT uid, content, text_id, arg_min(line, (text_id, line)) AS line, copies, fp, 'lines' AS kind FROM
(SELECT uid, content, line, text_id, count(*) OVER (PARTITION BY uid, content) AS copies, sha256(content) AS fp,
min(text_id) OVER (PARTITION BY uid, content) AS least FROM {_LINES}) WHERE text_id = least GROUP BY uid, content, text_id, copies, fp""",
)
def ingest_chunks(spark, sf):
    stamped = ck.stamp(_lines(spark, sf).withColumn("kind", F.lit("lines")), kind="kind")
    out = ck.ingest(stamped, ("text_id", "line"))
    return out.withColumn("kind", F.col("metadata")["kind"]).drop("metadata")


@query("tenant_filter", "SELECT doc_id, source AS uid, text FROM documents WHERE source = 'src7'")
def tenant_filter(spark, sf):
    docs = td.table(spark, sf, "documents")
    return docs.where(F.col("source") == "src7").select("doc_id", F.col("source").alias("uid"), "text")


# DuckDB: the mean vector of every label is the query.
_MEANS = """(SELECT label, list(m ORDER BY i) AS q FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM
(SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def _ranked(join: str, uid: str) -> str:
    return f"""SELECT * FROM (SELECT {uid} AS uid, m.label AS query_id, vec_id, score,
row_number() OVER (PARTITION BY m.label ORDER BY score DESC, vec_id) AS rank FROM
(SELECT m.label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score
FROM embeddings e JOIN {_MEANS} m ON {join}) m) WHERE rank <= 10"""


def _queries(spark, sf, tenant):
    means = vectors.centroids(td.vectors(spark, sf), "uid")
    return means.select((F.col("uid") if tenant else F.lit(0)).alias("uid"), F.col("uid").alias("query_id"), "vector")


@query("vector_topk", _ranked("true", "0"))
def vector_topk(spark, sf):
    candidates = td.vectors(spark, sf).withColumn("uid", F.lit(0))
    return vectors.top_k(candidates, _queries(spark, sf, False), 10)


@query("vector_topk_by_tenant", _ranked("e.label = m.label", "m.label"))
def vector_topk_by_tenant(spark, sf):
    return vectors.top_k(td.vectors(spark, sf), _queries(spark, sf, True), 10)


@query(
    "context_assemble",
    f"""SELECT uid, query_id, string_agg(text, '|' ORDER BY rank) AS context FROM ({_ranked("e.label = m.label", "m.label")})
JOIN documents ON doc_id = vec_id GROUP BY ALL""",
)
def context_assemble(spark, sf):
    hits = vectors.top_k(td.vectors(spark, sf), _queries(spark, sf, True), 10)
    texts = td.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    out = vectors.context_of(hits, texts)
    return out.select("uid", "query_id", F.array_join("texts", "|").alias("context"))
