"""Relational queries: inserts, updates, splitting, listings, plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.operators import tables as tb
from docmem.plans import query
from docmem.sources import testdata as td

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
}
_ACCOUNTS = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"


def _all(spark, sf):
    return {name: td.table(spark, sf, name) for name in NAMES}


def _accounts(spark, sf):
    return td.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )


def _suppliers(spark, sf):
    return td.table(spark, sf, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").alias("nation"),
    )


@query("sql_insert_rows", f"{_ACCOUNTS} UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier")
def sql_insert_rows(spark, sf):
    return tb.insert_rows(_accounts(spark, sf), _suppliers(spark, sf))


@query(
    "sql_update_rows",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def sql_update_rows(spark, sf):
    """Orders with a returned line become 'R'."""
    patches = (
        td.table(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("o_orderkey"))
        .distinct()
        .withColumn("o_orderstatus", F.lit("R"))
    )
    orders = td.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return tb.patch_rows(orders, patches, "o_orderkey", {"o_orderstatus": F.lit(True)})


@query(
    "widen_union",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INT AS nation FROM customer
UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal, s_nationkey FROM supplier""",
)
def widen_union(spark, sf):
    return tb.widen(_accounts(spark, sf), _suppliers(spark, sf))


@query(
    "split_into_tables",
    """SELECT 'lang' AS table_name, doc_id AS db_id, 0 AS item, 'value' AS column_name, '"' || lang || '"' AS value FROM documents
UNION ALL SELECT 'source', doc_id, 0, 'value', '"' || source || '"' FROM documents
UNION ALL SELECT 'stats', doc_id, 0, 'chars', n_chars::VARCHAR FROM documents
UNION ALL SELECT 'lines', doc_id, n - 1, unnest(['n', 'chars', 'text']), unnest([n::VARCHAR, length(text)::VARCHAR, to_json(text)::VARCHAR])
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS text FROM documents)""",
)
def split_into_tables(spark, sf):
    return tb.split_into_tables(td.text_docs(spark, sf), max_depth=3)


@query(
    "relate_children",
    """SELECT doc_id AS parent_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS child_no,
unnest(string_split(text, chr(10))) AS text FROM documents""",
)
def relate_children(spark, sf):
    rows = tb.relate_children(td.text_docs(spark, sf), "lines")
    return rows.select("parent_id", "child_no", F.variant_get("child", "$.text", "string").alias("text"))


@query("orphan_check", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark, sf):
    out = tb.orphans(td.table(spark, sf, "documents"), td.table(spark, sf, "labels"), "doc_id", "doc_id")
    return out.select("doc_id", "source")


_TYPES = "CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp' END"


@query(
    "catalog_listing",
    f"""SELECT i.table_name, ordinal_position - 1 AS pos, column_name, {_TYPES} AS type,
(i.table_name || '.' || column_name) IN ({", ".join(f"'{t}.{c}'" for t, c in KEYS.items())}) AS pk, n.n AS filled
FROM information_schema.columns i JOIN ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in NAMES)}) n
ON i.table_name = n.table_name""",
)
def catalog_listing(spark, sf):
    out = tb.listing(_all(spark, sf), KEYS)
    return out.withColumn("type", F.regexp_replace("type", "_ntz$", ""))


def _duck_row(name: str) -> str:
    """DuckDB: a row as JSON with the same texts for doubles, floats and times."""
    money = "'{0}': {0}::DECIMAL(18,2)::VARCHAR"
    time = "'{0}': strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
    plain = "'{0}': {0}"
    shape = {
        "region": [(plain, "r_regionkey r_name")],
        "nation": [(plain, "n_nationkey n_name n_regionkey")],
        "customer": [(plain, "c_custkey c_name c_nationkey"), (money, "c_acctbal"), (plain, "c_mktsegment")],
        "supplier": [(plain, "s_suppkey s_name s_nationkey"), (money, "s_acctbal")],
        "part": [(plain, "p_partkey p_name p_brand p_type p_size"), (money, "p_retailprice")],
        "orders": [
            (plain, "o_orderkey o_custkey o_orderstatus"),
            (money, "o_totalprice"),
            (time, "o_orderdate"),
            (plain, "o_orderpriority"),
        ],
        "lineitem": [
            (plain, "l_orderkey l_partkey l_suppkey l_linenumber"),
            (money, "l_quantity l_extendedprice l_discount l_tax"),
            (plain, "l_returnflag l_linestatus"),
            (time, "l_shipdate"),
        ],
        "events": [(plain, "event_id"), (time, "ts"), (plain, "user_id event_type"), (money, "value"), (plain, "props")],
        "documents": [(plain, "doc_id text lang source n_chars")],
        "embeddings": [
            (plain, "vec_id"),
            ("'{0}': [x::DOUBLE::DECIMAL(18,6)::VARCHAR FOR x IN {0}]", "embedding"),
            (plain, "label"),
        ],
        "pages": [(plain, "page_id url html")],
        "benchmark": [(plain, "item_id text")],
        "labels": [(plain, "doc_id quality toxic")],
        "conversations": [(plain, "conv_id turn role text")],
    }[name]
    return ", ".join(form.format(c) for form, cs in shape for c in cs.split())


def _printable(df):
    """Doubles, floats and times as fixed texts, so that every engine prints them alike."""

    def one(f):
        kind = f.dataType.simpleString()
        if kind == "double":
            return F.col(f.name).cast("decimal(18,2)").cast("string").alias(f.name)
        if kind == "array<float>":
            return F.transform(f.name, lambda x: x.cast("double").cast("decimal(18,6)").cast("string")).alias(f.name)
        if kind.startswith("timestamp"):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        return F.col(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


@query(
    "dump_all_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, to_json({{{_duck_row(t)}}})::VARCHAR AS row FROM {t}" for t in NAMES
    ),
)
def dump_all_tables(spark, sf):
    return tb.dump({name: _printable(df) for name, df in _all(spark, sf).items()})


# ---- statements a user hands to the engine as they are ---------------------------


def _sql(spark, sf, text, *names):
    return spark.sql(text, **{n: td.table(spark, sf, n) for n in names})


@query(
    "sql_join",
    """SELECT o_orderkey, o_orderpriority, c_custkey, c_name, n_name FROM orders
LEFT JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def sql_join(spark, sf):
    return _sql(
        spark,
        sf,
        """SELECT o_orderkey, o_orderpriority, c_custkey, c_name, n_name FROM {orders}
        LEFT JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
        "customer",
        "nation",
        "orders",
    )


@query(
    "sql_group_agg",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
round(avg(l_discount), 6) AS discount, max(l_extendedprice) AS top_price FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def sql_group_agg(spark, sf):
    return _sql(
        spark,
        sf,
        """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
        round(avg(l_discount), 6) AS discount, max(l_extendedprice) AS top_price
        FROM {lineitem} GROUP BY l_returnflag, l_linestatus""",
        "lineitem",
    )


@query("sql_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def sql_distinct(spark, sf):
    return _sql(spark, sf, "SELECT DISTINCT p_brand, p_type FROM {part}", "part")


@query("sql_topn", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sql_topn(spark, sf):
    return _sql(
        spark,
        sf,
        "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
        "orders",
    )


@query("sql_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def sql_union(spark, sf):
    return _sql(
        spark,
        sf,
        "SELECT c_nationkey AS nation FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
        "customer",
        "supplier",
    )


@query(
    "sql_window",
    """SELECT o_custkey, rank, o_orderkey FROM (SELECT o_custkey, o_orderkey,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def sql_window(spark, sf):
    return _sql(
        spark,
        sf,
        """SELECT o_custkey, rank, o_orderkey FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM {orders})
        WHERE rank <= 3""",
        "orders",
    )
