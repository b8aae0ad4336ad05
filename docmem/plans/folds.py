"""The edit fold on logs derived from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.operators import fold as fo
from docmem.operators import leaves as lv
from docmem.operators import matching
from docmem.plans import query
from docmem.session import cut_lineage
from docmem.sources import testdata as td

K = "json_extract_string(props, '$.k')"
# DuckDB: lists of the list log; f is the edit that starts the list of a path.
LIST_LOG = f"""(SELECT user_id AS db_id, '$.' || event_type AS path, event_id AS seq, {K} AS k,
min(event_id) FILTER (WHERE value >= 50) OVER (PARTITION BY user_id, event_type) AS f FROM events)"""
LIST_ITEMS = f"""(SELECT db_id, path, row_number() OVER (PARTITION BY db_id, path ORDER BY seq) - 1 AS pos, k AS value
FROM {LIST_LOG} WHERE f IS NOT NULL AND seq >= f)"""
LIST_PLAIN = f"(SELECT db_id, path, arg_max(k, seq) AS value FROM {LIST_LOG} WHERE f IS NULL GROUP BY ALL)"
LIST_VALUES = f"""(SELECT db_id, path, '[' || string_agg(value, ',' ORDER BY pos) || ']' AS value
FROM {LIST_ITEMS} GROUP BY ALL UNION ALL SELECT * FROM {LIST_PLAIN})"""


@query(
    "fold_last_write_wins",
    f"""SELECT user_id AS db_id, '$.' || event_type || '.k' AS path, arg_max({K}, event_id) AS value
FROM events GROUP BY ALL""",
)
def fold_last_write_wins(spark, sf):
    return fo.last_values(td.field_edits(spark, sf)).select("db_id", "path", "value")


@query("fold_elements", f"SELECT * FROM {LIST_ITEMS} UNION ALL SELECT db_id, path, NULL, value FROM {LIST_PLAIN}")
def fold_elements(spark, sf):
    return fo.fold(td.list_edits(spark, sf), nested=False).select("db_id", "path", "pos", "value")


@query(
    "fold_list_append",
    f"SELECT db_id, path, count(*) AS n, max(pos) AS last_pos FROM {LIST_ITEMS} GROUP BY ALL",
)
def fold_list_append(spark, sf):
    items = fo.fold(td.list_edits(spark, sf), nested=False).where("pos IS NOT NULL")
    return items.groupBy("db_id", "path").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query(
    "fold_list_extend",
    f"""SELECT user_id AS db_id, '$.' || event_type AS path, 2 * (r - 1) + i AS pos,
CASE WHEN i = 0 THEN {K} ELSE event_type END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events),
(VALUES (0), (1)) t(i)""",
)
def fold_list_extend(spark, sf):
    pair = F.concat(F.lit("["), F.col("k"), F.lit(',"'), F.substring("path", 3, 100), F.lit('"]'))
    log = td.object_edits(spark, sf).select("db_id", "seq", "path", pair.alias("data"))
    out = fo.fold(log, nested=False)
    return out.select("db_id", "path", "pos", F.replace("value", F.lit('"'), F.lit("")).alias("value"))


@query(
    "fold_create",
    f"""SELECT user_id AS db_id, '{{' || string_agg('"' || event_type || '":{{"k":' || k || '}}', ',' ORDER BY event_type) || '}}' AS doc
FROM (SELECT user_id, event_type, arg_max({K}, event_id) AS k FROM events GROUP BY ALL) GROUP BY ALL""",
)
def fold_create(spark, sf):
    folded = fo.fold(td.field_edits(spark, sf))
    return fo.documents(folded, max_depth=3).select("db_id", "doc")


@query("fold_docs", f"SELECT db_id, path, 0 AS page, value FROM {LIST_VALUES}")
def fold_docs(spark, sf):
    return fo.pages(fo.fold(td.list_edits(spark, sf), nested=False))


@query(
    "replay_edits",
    f"""SELECT db_id, 0 AS part, 0 AS page,
'{{' || string_agg('"' || path[3:] || '":' || value, ',' ORDER BY path) || '}}' AS doc
FROM {LIST_VALUES} GROUP BY db_id""",
)
def replay_edits(spark, sf):
    return fo.documents(fo.fold(td.list_edits(spark, sf)), max_depth=2)


@query(
    "fold_onto_base",
    f"""SELECT coalesce(c_custkey, db_id) AS db_id, coalesce(path, '$.market.segment') AS path, value FROM (
SELECT c_custkey, NULL AS db_id, '$.market.segment' AS path, '"' || c_mktsegment || '"' AS value FROM customer
WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT c_custkey, NULL, '$.name', '"' || c_name || '"' FROM customer
UNION ALL SELECT c_custkey, NULL, '$.nation', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT c_custkey, NULL, '$.balance', c_acctbal::VARCHAR FROM customer
UNION ALL SELECT NULL, user_id, CASE WHEN event_type = 'purchase' THEN '$.market.k' ELSE '$.last.' || event_type END,
arg_max({K}, event_id) FROM events GROUP BY user_id, event_type)""",
)
def fold_onto_base(spark, sf):
    """Stored customers and all events; a purchase replaces `$.market` by its props. Owners without a base start from nothing."""
    base = fo.base_edits(td.customer_docs(spark, sf), max_depth=3)
    bought = F.col("event_type") == "purchase"
    log = td.table(spark, sf, "events").select(
        F.col("user_id").alias("db_id"),
        F.col("event_id").alias("seq"),
        F.when(bought, "$.market").otherwise(F.concat(F.lit("$.last."), "event_type")).alias("path"),
        F.when(bought, F.col("props")).otherwise(F.get_json_object("props", "$.k")).alias("data"),
    )
    return fo.fold(base.unionByName(log), positions=False, nested=True, max_depth=3).select("db_id", "path", "value")


@query(
    "drop_na_edits",
    """SELECT user_id AS db_id, event_id AS seq, '$.' || event_type AS path, props AS data
FROM events WHERE value >= 10""",
)
def drop_na_edits(spark, sf):
    log = td.table(spark, sf, "events").select(
        F.col("user_id").alias("db_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") < 10, "NA").otherwise(F.concat(F.lit("$."), "event_type")).alias("path"),
        F.when(F.col("value") < 10, "{}").otherwise(F.col("props")).alias("data"),
    )
    return fo.drop_na(log)


@query(
    "fold_prefix_conflicts",
    f"""WITH e AS (SELECT user_id AS db_id, event_type, event_id, value, {K} AS k FROM events),
w AS (SELECT db_id, event_type, max(event_id) AS s FROM e WHERE value >= 60 GROUP BY ALL),
p AS (SELECT db_id, event_type, '$.' || event_type || '.k' AS path, k AS value FROM e JOIN w USING (db_id, event_type) WHERE event_id = s)
SELECT db_id, path, value FROM p
UNION ALL SELECT e.db_id, '$.' || e.event_type || '.v', arg_max(k, event_id) FROM e
LEFT JOIN w ON e.db_id = w.db_id AND e.event_type = w.event_type
WHERE e.value < 60 AND event_id > coalesce(s, -1) GROUP BY ALL""",
)
def fold_prefix_conflicts(spark, sf):
    """`$.t` is replaced by an object while `$.t.v` is edited: both interact."""
    return fo.fold(td.nested_edits(spark, sf), positions=False, nested=True, max_depth=3).select("db_id", "path", "value")


_ELEMENTS = f"""(SELECT user_id AS db_id, '$.' || event_type AS path, event_id AS seq, {K} AS k,
row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos FROM events)"""


@query(
    "update_matching_elements",
    f"""WITH u AS (SELECT user_id AS db_id, '$.' || event_type AS path, {K} AS k, max(event_id) AS s,
arg_max(event_type || '-' || event_id, event_id) AS mark FROM events WHERE value >= 100 GROUP BY ALL)
SELECT e.db_id, e.path, e.pos, '{{"k":' || e.k || CASE WHEN u.s > e.seq THEN ',"mark":"' || mark || '"' ELSE '' END || '}}' AS value
FROM {_ELEMENTS} e LEFT JOIN u ON e.db_id = u.db_id AND e.path = u.path AND e.k = u.k""",
)
def update_matching_elements(spark, sf):
    """`$.t[?k = K].mark` set by every event of value 100 or more."""
    log = td.object_edits(spark, sf)
    elements = fo.fold(log.drop("k", "value"), nested=False)
    updates = log.where(F.col("value") >= 100).select(
        "db_id",
        "seq",
        "path",
        F.lit("k").alias("field"),
        F.col("k").alias("equals"),
        F.lit("mark").alias("target"),
        F.concat(F.lit('"'), F.substring("path", 3, 100), F.lit("-"), "seq", F.lit('"')).alias("data"),
    )
    out = matching.update_matching(elements, updates)
    return out.select("db_id", "path", "pos", "value")


_UPDATES = "(SELECT user_id AS db_id, '$.' || event_type AS path, event_id AS seq, k::BIGINT AS k FROM (SELECT *, " + K + """ AS k FROM events) WHERE value >= 60)"""


@query(
    "update_elements_by_selector",
    f"""SELECT e.db_id, e.path, e.pos, e.k::BIGINT AS k,
max(u.seq) FILTER (u.seq % 4 = 0 AND e.k::BIGINT > u.k) AS over,
max(u.seq) FILTER (u.seq % 4 = 1 AND e.pos = 0) AS first,
max(u.seq) FILTER (u.seq % 4 = 2 AND (e.next IS NULL OR u.seq < e.next)) AS last,
max(u.seq) FILTER (u.seq % 4 = 3) AS seen
FROM (SELECT *, lead(seq) OVER (PARTITION BY db_id, path ORDER BY seq) AS next FROM {_ELEMENTS}) e
LEFT JOIN {_UPDATES} u ON e.db_id = u.db_id AND e.path = u.path AND u.seq >= e.seq GROUP BY ALL""",
)
def update_elements_by_selector(spark, sf):
    """`[?k > K].over`, `[0].first`, `[-1].last` and `[*].at.seen`, each an edit of the log."""
    out = matching.replay(td.selector_edits(spark, sf), nested=False)
    v = F.parse_json("value")
    get = lambda p: F.try_variant_get(v, f"$.{p}", "bigint")
    return out.select(
        "db_id",
        "path",
        "pos",
        get("k").alias("k"),
        get("over").alias("over"),
        get("first").alias("first"),
        get("last").alias("last"),
        get("at.seen").alias("seen"),
    )


@query(
    "replay_dependent_updates",
    f"""WITH e AS (SELECT e.db_id, e.path, e.pos, e.seq, e.k, min(u.seq) FILTER (u.seq % 3 = 0) AS t0 FROM {_ELEMENTS} e
LEFT JOIN {_UPDATES} u ON e.db_id = u.db_id AND e.path = u.path AND u.seq >= e.seq GROUP BY ALL),
f AS (SELECT e.*, min(u.seq) FILTER (u.seq % 3 = 1) AS t1 FROM e
LEFT JOIN {_UPDATES} u ON e.db_id = u.db_id AND e.path = u.path AND u.seq > e.t0 GROUP BY ALL)
SELECT f.db_id, f.path, f.pos, f.k::BIGINT AS k, CASE WHEN t1 IS NOT NULL THEN 'done' WHEN t0 IS NOT NULL THEN 'seen' ELSE 'new' END AS s,
max(u.seq) FILTER (u.seq % 3 = 2) AS at FROM f
LEFT JOIN {_UPDATES} u ON f.db_id = u.db_id AND f.path = u.path AND u.seq > t0 AND (t1 IS NULL OR u.seq < t1) GROUP BY ALL""",
)
def replay_dependent_updates(spark, sf):
    """Updates of the very field that others select by: elements go from `new` over `seen` to `done`."""
    out = matching.replay(td.state_edits(spark, sf), nested=False)
    v = F.parse_json("value")
    return out.select(
        "db_id",
        "path",
        "pos",
        F.variant_get(v, "$.k", "bigint").alias("k"),
        F.variant_get(v, "$.s", "string").alias("s"),
        F.variant_get(v, "$.at", "bigint").alias("at"),
    )


@query(
    "append_per_match",
    """SELECT d.doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos,
CASE WHEN l.quality IS NULL THEN '[]' ELSE '[' || quality || ',' || toxic || ']' END AS tags,
unnest(string_split(text, chr(10))) AS text
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def append_per_match(spark, sf):
    """`$.lines[*].tags` gets the labels of the text, in every line."""
    docs = td.table(spark, sf, "documents").select(
        F.col("doc_id").alias("db_id"),
        F.transform(
            F.split("text", "\n"), lambda x: F.to_json(F.struct(x.alias("text"), F.array().cast("array<int>").alias("tags")))
        ).alias("items"),
    )
    adds = td.table(spark, sf, "labels").select(
        F.col("doc_id").alias("db_id"), F.array("quality", "toxic").cast("array<string>").alias("adds")
    )
    out = matching.append_to_each(docs, adds, "tags")
    v = F.parse_json("item")
    return out.select(F.col("db_id").alias("doc_id"), F.posexplode("items").alias("pos", "item")).select(
        "doc_id",
        "pos",
        F.to_json(F.variant_get(v, "$.tags", "variant")).alias("tags"),
        F.variant_get(v, "$.text", "string").alias("text"),
    )


@query(
    "leaves",
    """SELECT o_orderkey AS db_id, unnest(['$.customer', '$.date', '$.status.code', '$.status.priority']) AS path,
unnest([o_custkey::VARCHAR, '"' || strftime(o_orderdate, '%Y-%m-%d') || '"', '"' || o_orderstatus || '"', '"' || o_orderpriority || '"']) AS value,
unnest(['integer', 'string', 'string', 'string']) AS jtype FROM orders""",
)
def leaves(spark, sf):
    return lv.leaves(td.order_docs(spark, sf), max_depth=3)


@query(
    "rebuild_docs",
    """SELECT o_orderkey AS db_id, '{"customer":' || o_custkey || ',"date":"' || strftime(o_orderdate, '%Y-%m-%d') ||
'","status":{"code":"' || o_orderstatus || '","priority":"' || o_orderpriority || '"}}' AS doc FROM orders""",
)
def rebuild_docs(spark, sf):
    rows = lv.leaves(td.order_docs(spark, sf), enter_lists=False, max_depth=3)
    return lv.rebuild(rows, ["db_id"], max_depth=3)


_PLAIN = "regexp_replace({}::DECIMAL(12,2)::VARCHAR, '\\.?0+$', '')"  # VARIANT drops zeros at the end of a fraction
_DEEP_ITEMS = f"""(SELECT l_orderkey, '[' || string_agg('[' || l_linenumber || ',' || {_PLAIN.format("l_extendedprice")} || ']', ',' ORDER BY l_linenumber, l_extendedprice) || ']' AS items
FROM lineitem GROUP BY l_orderkey)"""


@query(
    "leaves_any_depth",
    f"""SELECT o_orderkey AS db_id, '$' || repeat('.d[0]', (o_orderkey % 16)::INT) || '.total' AS path, {_PLAIN.format("o_totalprice")} AS value FROM orders
UNION ALL SELECT o_orderkey, '$' || repeat('.d[0]', (o_orderkey % 16)::INT) || '.items', '[]' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, '$' || repeat('.d[0]', (l_orderkey % 16)::INT) || '.items[' || pos || '][' || i || ']',
CASE WHEN i = 0 THEN l_linenumber::VARCHAR ELSE {_PLAIN.format("l_extendedprice")} END
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS pos FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), (VALUES (0), (1)) t(i)""",
)
def leaves_any_depth(spark, sf):
    """Up to 33 levels; the depth of the walk comes from the documents."""
    return lv.leaves(td.deep_orders(spark, sf)).select("db_id", "path", "value")


@query(
    "rebuild_any_depth",
    f"""SELECT o_orderkey AS db_id, repeat('{{"d":[', (o_orderkey % 16)::INT) || '{{"items":' || coalesce(items, '[]') || ',"total":' ||
{_PLAIN.format("o_totalprice")} || '}}' || repeat(']}}', (o_orderkey % 16)::INT) AS doc FROM orders LEFT JOIN {_DEEP_ITEMS} ON o_orderkey = l_orderkey""",
)
def rebuild_any_depth(spark, sf):
    rows = cut_lineage(lv.leaves(td.deep_orders(spark, sf)))
    return lv.rebuild(rows, ["db_id"])
