"""Path extraction, predicates, sorting (projection and filter operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.functions import paths as p
from docmem.operators import leaves as lv
from docmem.operators import lists, reads
from docmem.operators import requests as rq
from docmem.plans import query
from docmem.sources import testdata as td

# DuckDB: the lines of every text, numbered from 1.
LINES = """(SELECT doc_id, source, lang, n_chars, generate_subscripts(l, 1) AS n, unnest(l) AS text
FROM (SELECT *, string_split(text, chr(10)) AS l FROM (SELECT doc_id, source, lang, n_chars, text FROM documents)))"""

LONG = p.where(p.compare("chars", ">=", 200))
LINE_ORDER = p.order(("chars", "bigint", True), ("n", "bigint", False))


def _rows(df, found, value="value"):
    return df.select(F.col("db_id").alias("doc_id"), F.posexplode(found).alias("ord", value))


@query(
    "path_query",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, n) - 1 AS ord,
text AS value FROM {LINES} WHERE length(text) >= 200""",
)
def path_query(spark, sf):
    # $.lines[\chars,/n][?chars >= 200].text
    df = td.text_docs(spark, sf)
    return _rows(df, p.texts()(p.matches("doc", p.field("lines"), LINE_ORDER, LONG, p.field("text"))))


@query("path_nested_field", "SELECT doc_id, n_chars AS chars FROM documents")
def path_nested_field(spark, sf):
    df = td.text_docs(spark, sf)
    return df.select(F.col("db_id").alias("doc_id"), F.variant_get("doc", "$.stats.chars", "bigint").alias("chars"))


@query("path_wildcard_explode", f"SELECT doc_id, n - 1 AS pos, text FROM {LINES}")
def path_wildcard_explode(spark, sf):
    return spark.sql(
        """SELECT db_id AS doc_id, e.pos, variant_get(e.value, '$.text', 'string') AS text
        FROM {docs}, LATERAL variant_explode(variant_get(doc, '$.lines', 'variant')) AS e""",
        docs=td.text_docs(spark, sf),
    )


@query(
    "path_filter_then_field",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS ord, n
FROM {LINES} WHERE length(text) < 40""",
)
def path_filter_then_field(spark, sf):
    found = p.matches("doc", p.field("lines"), p.where(p.compare("chars", "<", 40)), p.field("n"))
    df = _rows(td.text_docs(spark, sf), found)
    return df.select("doc_id", "ord", F.variant_get("value", "$", "bigint").alias("n"))


@query(
    "path_whole_object",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS ord,
to_json({{'chars': length(text), 'n': n, 'text': text}})::VARCHAR AS value FROM {LINES} WHERE length(text) >= 400""",
)
def path_whole_object(spark, sf):
    found = p.matches("doc", p.field("lines"), p.where(p.compare("chars", ">=", 400)))
    return _rows(td.text_docs(spark, sf), F.transform(found, lambda x: F.to_json(x)))


@query(
    "multi_path_fetch",
    """SELECT doc_id, '$.stats.chars' AS path, n_chars::VARCHAR AS value FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, '$.lang', '"' || lang || '"' FROM documents WHERE lang = 'en'
UNION ALL SELECT doc_id, '$.source', '"' || source || '"' FROM documents WHERE lang <> 'en'""",
)
def multi_path_fetch(spark, sf):
    requests = td.table(spark, sf, "documents").select(
        F.col("doc_id").alias("db_id"),
        F.when(
            F.col("lang") == "en", F.array(F.lit("$.stats.chars"), F.lit("$.lang"), F.lit("$.nothing.here"))
        ).otherwise(F.array(F.lit("$.source"))).alias("path_list"),
    )
    return reads.fetch(td.text_docs(spark, sf), requests).withColumnRenamed("db_id", "doc_id")


_ANY = {
    "$.lines[*].n": "SELECT doc_id, n - 1 AS ord, n::VARCHAR AS value FROM {lines}",
    "$.lines[?chars >= 200].text": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1, to_json(text)::VARCHAR FROM {lines} WHERE length(text) >= 200",
    "$.lines[-3:-1].chars": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1, length(text)::VARCHAR FROM {lines} WHERE n BETWEEN of - 2 AND of - 1",
    "$.lines[-1].text": "SELECT doc_id, 0, to_json(text)::VARCHAR FROM {lines} WHERE n = of",
    "$.lines[\\chars,/n][0:2][*].n": None,  # slices give elements, which are no lists
    "$.lines[\\chars,/n][0:2].n": "SELECT doc_id, r, n::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, n) - 1 AS r FROM {lines}) WHERE r < 2",
    "$..chars": "SELECT doc_id, n - 1, length(text)::VARCHAR FROM {lines} UNION ALL SELECT DISTINCT doc_id, of, n_chars::VARCHAR FROM {lines}",
    "$.lines.`len`": "SELECT DISTINCT doc_id, 0, of::VARCHAR FROM {lines}",
    "$.stats.chars": "SELECT DISTINCT doc_id, 0, n_chars::VARCHAR FROM {lines}",
    '$.lines[?text =~ "^.? "]': "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1, to_json({{'chars': length(text), 'n': n, 'text': text}})::VARCHAR FROM {lines} WHERE regexp_matches(text, '^.? ')",
}
_COUNTED = f"(SELECT *, count(*) OVER (PARTITION BY doc_id) AS of FROM {LINES})"


@query(
    "multi_path_fetch_any",
    " UNION ALL ".join(
        f"SELECT doc_id, '{path}' AS path, ord, value FROM ({sql.format(lines=_COUNTED)}) AS t(doc_id, ord, value)" for path, sql in _ANY.items() if sql
    ),
)
def multi_path_fetch_any(spark, sf):
    """Wildcards, tests, slices, sorts, `..chars` and functions, all asked of every document at once."""
    docs = td.text_docs(spark, sf)
    asked = docs.select("db_id", F.array(*[F.lit(p) for p in _ANY], F.lit("NA"), F.lit("$.nothing[*]")).alias("path_list"))
    return rq.fetch_any(docs, asked).withColumnRenamed("db_id", "doc_id")


@query(
    "fetch_skip_na",
    """SELECT o_orderkey, '$.status.code' AS path, '"' || o_orderstatus || '"' AS value
FROM orders WHERE o_totalprice >= 100000""",
)
def fetch_skip_na(spark, sf):
    requests = td.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("db_id"),
        F.array(F.when(F.col("o_totalprice") >= 100000, "$.status.code").otherwise("NA")).alias("path_list"),
    )
    return reads.fetch(td.order_docs(spark, sf), requests).withColumnRenamed("db_id", "o_orderkey")


@query(
    "retrieve_as_text",
    f"""SELECT doc_id, coalesce(to_json(list(text ORDER BY n) FILTER (WHERE length(text) < 60))::VARCHAR, '[]') AS value
FROM {LINES} GROUP BY doc_id""",
)
def retrieve_as_text(spark, sf):
    found = p.matches("doc", p.field("lines"), p.where(p.compare("chars", "<", 60)), p.field("text"))
    df = td.text_docs(spark, sf)
    return df.select(F.col("db_id").alias("doc_id"), reads.as_text(p.texts()(found)).alias("value"))


@query("sql_select_star", "SELECT * FROM customer")
def sql_select_star(spark, sf):
    return td.table(spark, sf, "customer").select("*")


@query("filter_eq", f"SELECT doc_id, n, text FROM {LINES} WHERE length(text) = 100")
def filter_eq(spark, sf):
    found = p.matches("doc", p.field("lines"), p.where(p.eq("chars", 100)))
    return _line_rows(td.text_docs(spark, sf), found)


def _line_rows(df, found):
    line = F.transform(found, lambda x: F.variant_get(x, "$", "struct<n bigint, text string>"))
    return df.select(F.col("db_id").alias("doc_id"), F.explode(line).alias("l")).select("doc_id", "l.n", "l.text")


@query(
    "filter_range",
    f"SELECT doc_id, n, text FROM {LINES} WHERE length(text) > 50 AND length(text) <= 80 AND n <> 1",
)
def filter_range(spark, sf):
    tests = (p.compare("chars", ">", 50), p.compare("chars", "<=", 80), p.compare("n", "!=", 1))
    return _line_rows(td.text_docs(spark, sf), p.matches("doc", p.field("lines"), p.where(*tests)))


@query("filter_regex", f"SELECT doc_id, n, text FROM {LINES} WHERE regexp_matches(text, 'Th[ae]|[0-9]{{3}}')")
def filter_regex(spark, sf):
    found = p.matches("doc", p.field("lines"), p.where(p.regex("text", "Th[ae]|[0-9]{3}")))
    return _line_rows(td.text_docs(spark, sf), found)


@query("filter_case_insensitive", "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'")
def filter_case_insensitive(spark, sf):
    status = p.matches("doc", p.field("status"))
    hit = F.exists(status, p.eq_any_case("priority", "1-Urgent"))
    return td.order_docs(spark, sf).where(hit).select(F.col("db_id").alias("o_orderkey"))


@query(
    "filter_upcoming",
    """SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) = DATE '1998-06-16' THEN 'tomorrow' ELSE 'later' END AS due
FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-06-15'""",
)
def filter_upcoming(spark, sf, as_of: str = "1998-06-15"):
    # ISO dates compare as text; "today" is a parameter so that runs repeat
    date = F.variant_get("doc", "$.date", "string")
    tomorrow = F.date_format(F.date_add(F.lit(as_of).cast("date"), 1), "yyyy-MM-dd")
    return (
        td.order_docs(spark, sf)
        .where(date > as_of)
        .select(
            F.col("db_id").alias("o_orderkey"), F.when(date == tomorrow, "tomorrow").otherwise("later").alias("due")
        )
    )


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%'")
def filter_like(spark, sf):
    return td.table(spark, sf, "part").where(F.col("p_name").ilike("%BOLT%")).select("p_partkey", "p_name")


@query(
    "sort_elements_multi_key",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, n) - 1 AS ord, n
FROM {LINES}""",
)
def sort_elements_multi_key(spark, sf):
    found = p.matches("doc", p.field("lines"), LINE_ORDER, p.each(), p.field("n"))
    df = _rows(td.text_docs(spark, sf), found)
    return df.select("doc_id", "ord", F.variant_get("value", "$", "bigint").alias("n"))


@query(
    "path_index",
    f"""SELECT doc_id, min_by(text, n) AS first_line, max_by(text, n) AS last_line FROM {LINES} GROUP BY doc_id""",
)
def path_index(spark, sf):
    def at(i):
        return F.element_at(p.texts()(p.matches("doc", p.field("lines"), p.index(i), p.field("text"))), 1)

    df = td.text_docs(spark, sf)
    return df.select(F.col("db_id").alias("doc_id"), at(0).alias("first_line"), at(-1).alias("last_line"))


@query("path_slice", f"SELECT doc_id, n - 2 AS ord, text AS value FROM {LINES} WHERE n BETWEEN 2 AND 4")
def path_slice(spark, sf):
    df = td.text_docs(spark, sf)
    return _rows(df, p.texts()(p.matches("doc", p.field("lines"), p.part(1, 4), p.field("text"))))


@query(
    "path_descendants",
    f"""SELECT doc_id, '$.stats.chars' AS path, n_chars AS value FROM documents
UNION ALL SELECT doc_id, '$.lines[' || (n - 1) || '].chars', length(text) FROM {LINES}""",
)
def path_descendants(spark, sf):
    rows = reads.descendants(td.text_docs(spark, sf), "chars", max_depth=3)
    return rows.select(
        F.col("db_id").alias("doc_id"), "path", F.variant_get("v", "$", "bigint").alias("value")
    )


@query(
    "path_len",
    f"SELECT doc_id, count(*) AS n_lines FROM {LINES} GROUP BY doc_id",
)
def path_len(spark, sf):
    df = td.text_docs(spark, sf)
    n = F.element_at(p.length()(p.matches("doc", p.field("lines"))), 1)
    return df.select(F.col("db_id").alias("doc_id"), n.alias("n_lines"))


@query(
    "path_split",
    "SELECT c_custkey, string_split(c_name, '#')[2] AS number FROM customer",
)
def path_split(spark, sf):
    found = p.split("#", 1)(p.matches("doc", p.field("name")))
    return td.customer_docs(spark, sf).select(
        F.col("db_id").alias("c_custkey"), F.element_at(found, 1).alias("number")
    )


@query(
    "path_sub",
    "SELECT c_custkey, regexp_replace(c_name, '[^0-9]+0*', 'c', 'g') AS name FROM customer",
)
def path_sub(spark, sf):
    found = p.sub("[^0-9]+0*", "c")(p.matches("doc", p.field("name")))
    return td.customer_docs(spark, sf).select(F.col("db_id").alias("c_custkey"), F.element_at(found, 1).alias("name"))


_SHIPPED = """(SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS rank,
count(*) OVER (PARTITION BY l_returnflag) AS size FROM lineitem)"""


def _shipped(spark, sf):
    """Line items as three lists, of which one holds half of them."""
    rows = td.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return lists.ranked(rows, ["l_returnflag"], order)


@query("list_rank_rows", f"SELECT l_returnflag, l_orderkey, l_linenumber, rank, size FROM {_SHIPPED}")
def list_rank_rows(spark, sf):
    return _shipped(spark, sf).select("l_returnflag", "l_orderkey", "l_linenumber", "rank", "size")


@query(
    "list_slice_rows",
    f"""SELECT 'first and last' AS part, l_returnflag, rank AS ord, l_orderkey, l_linenumber FROM {_SHIPPED}
WHERE rank IN (0, size - 1)
UNION ALL SELECT '[-100:]', l_returnflag, rank - greatest(size - 100, 0), l_orderkey, l_linenumber FROM {_SHIPPED} WHERE rank >= size - 100
UNION ALL SELECT '[10:-10:7]', l_returnflag, (rank - 10) // 7, l_orderkey, l_linenumber FROM {_SHIPPED}
WHERE rank >= 10 AND rank < size - 10 AND (rank - 10) % 7 = 0
UNION ALL SELECT '[::-3]', l_returnflag, (size - 1 - rank) // 3, l_orderkey, l_linenumber FROM {_SHIPPED} WHERE (size - 1 - rank) % 3 = 0""",
)
def list_slice_rows(spark, sf):
    placed = _shipped(spark, sf)
    parts = {
        "first and last": lists.at(placed, 0, -1).withColumn("ord", F.col("rank")),
        "[-100:]": lists.sliced(placed, -100),
        "[10:-10:7]": lists.sliced(placed, 10, -10, 7),
        "[::-3]": lists.sliced(placed, step=-3),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "l_returnflag", "ord", "l_orderkey", "l_linenumber")
        out = rows if out is None else out.unionByName(rows)
    return out
