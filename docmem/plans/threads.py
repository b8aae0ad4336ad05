"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docmem.operators import convo, schema
from docmem.operators import fold as fo
from docmem.operators import requests as rq
from docmem.plans import query
from docmem.session import cut_lineage
from docmem.sources import documents as dc
from docmem.sources import testdata as td

SYSTEM_PROMPT = "You keep what the user tells you."
# Tools of the test program: event type to handler.
TOOLS = (("purchase", "update"), ("signup", "create"), ("view", "fetch"))

_ALL = """(SELECT conv_id AS thread_id, turn, role, text AS content FROM conversations
UNION ALL SELECT user_id, event_id + 1000, 'tool', props FROM events)"""


@query("message_visibility", f"SELECT thread_id, turn, role <> 'tool' AS is_visible FROM {_ALL}")
def message_visibility(spark, sf):
    return convo.with_visibility(td.messages(spark, sf)).select("thread_id", "turn", "is_visible")


@query("visible_messages", "SELECT conv_id AS thread_id, turn, role, text AS content FROM conversations")
def visible_messages(spark, sf):
    return convo.visible(convo.with_visibility(td.messages(spark, sf))).drop("is_visible")


@query(
    "seed_system_turn",
    f"""SELECT conv_id AS thread_id, turn, role, text AS content FROM conversations
UNION ALL SELECT conv_id, -1, 'system', '{SYSTEM_PROMPT}' FROM conversations
GROUP BY conv_id HAVING NOT bool_or(role = 'system')""",
)
def seed_system_turn(spark, sf):
    return convo.seed_system_turn(td.said(spark, sf), SYSTEM_PROMPT)


@query(
    "thread_assemble",
    f"""SELECT thread_id, turn // 256 AS page, max(turn) AS last_turn, count(*) AS n,
string_agg(role || ':' || content, '|' ORDER BY turn) AS said FROM {_ALL} GROUP BY ALL""",
)
def thread_assemble(spark, sf):
    threads = convo.assemble(convo.with_visibility(td.messages(spark, sf)))
    said = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return threads.select(
        "thread_id", "page", "last_turn", F.size("messages").alias("n"), F.array_join(said, "|").alias("said")
    )


@query(
    "thread_export",
    f"""SELECT thread_id, turn // 256 AS page, coalesce(to_json(list({{'role': role, 'content': content}} ORDER BY turn)
FILTER (WHERE role <> 'tool'))::VARCHAR, '[]') AS messages FROM {_ALL} GROUP BY ALL""",
)
def thread_export(spark, sf):
    threads = convo.assemble(convo.with_visibility(td.messages(spark, sf)))
    return convo.export(threads).select("thread_id", "page", F.to_json("messages").alias("messages"))


@query(
    "last_message",
    f"""SELECT thread_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(content, turn) AS content
FROM {_ALL} GROUP BY thread_id""",
)
def last_message(spark, sf):
    return convo.last_message(td.messages(spark, sf))


@query(
    "previous_context",
    r"""SELECT conv_id AS thread_id, turn, coalesce(string_agg(text, chr(10) || '  ')
OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context
FROM conversations""",
)
def previous_context(spark, sf):
    return convo.previous_context(td.said(spark, sf)).select("thread_id", "turn", "context")


@query(
    "explode_tool_calls",
    """SELECT event_id, i AS pos, CASE WHEN i = 0 THEN event_type ELSE 'log' END AS name, 'k' AS arg,
json_extract_string(props, '$.k') AS value FROM events, (VALUES (0), (1)) t(i)""",
)
def explode_tool_calls(spark, sf):
    call = F.struct(F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    log = F.struct(F.lit("log").alias("name"), F.col("props").alias("arguments"))
    responses = td.table(spark, sf, "events").select("event_id", F.array(call, log).alias("tool_calls"))
    calls = convo.explode_calls(responses, ["event_id"])
    return calls.select("event_id", "pos", "name", F.explode("args").alias("arg", "value"))


def _registry(spark):
    rows = ", ".join(f"('{name}', '{handler}')" for name, handler in TOOLS)
    # inline rows have a known size, so that Spark broadcasts them by its own check
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(name, handler)")


@query(
    "route_tool_calls",
    """SELECT event_id, user_id AS uid, event_type AS name, CASE event_type WHEN 'purchase' THEN 'update'
WHEN 'signup' THEN 'create' WHEN 'view' THEN 'fetch' END AS handler FROM events""",
)
def route_tool_calls(spark, sf):
    calls = td.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("uid"), F.col("event_type").alias("name")
    )
    return convo.route_calls(calls, _registry(spark))


@query("concat_deltas", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def concat_deltas(spark, sf):
    words = F.transform(
        F.split("text", " "),
        lambda w, i: F.struct(
            i.alias("pos"),
            F.lit(None).cast("string").alias("role"),
            F.when(i > 0, F.concat(F.lit(" "), w)).otherwise(w).alias("content"),
        ),
    )
    opening = F.array(F.struct(F.lit(-1).alias("pos"), F.col("role"), F.lit(None).cast("string").alias("content")))
    closing = F.array(
        F.struct(F.lit(1 << 30).alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    )
    frames = td.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.explode(F.concat(opening, words, closing)).alias("f")
    )
    out = convo.concat_deltas(frames.select("conv_id", "turn", "f.*"), ["conv_id", "turn"])
    return out.where("text <> ''")


PROMPT = "SCHEMA:\n{schema}\nPREVIOUS USER REQUESTS:\n{context}\nREQUEST:\n{request}"


OWNER_PROMPT = "SCHEMA:\n{schema}\nDESCRIPTIONS:\n{descriptions}\nDATA:\n{data}\nPREVIOUS USER REQUESTS:\n{context}\nREQUEST:\n{request}"


@query(
    "prompt_table_of_owners",
    """WITH l AS (SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY ALL),
s AS (SELECT user_id, '{' || string_agg('"' || event_type || '":{"k":"integer"}', ',' ORDER BY event_type) || '}' AS schema,
string_agg('$.' || event_type || '.k: last ' || event_type, chr(10) ORDER BY event_type) AS descriptions,
coalesce(string_agg('$.' || event_type || '.k: [' || k || ']', chr(10) ORDER BY event_type) FILTER (event_type IN ('click', 'purchase')), '') AS data
FROM l GROUP BY user_id)
SELECT conv_id AS thread_id, turn, 'SCHEMA:' || chr(10) || coalesce(schema, '') || chr(10) || 'DESCRIPTIONS:' || chr(10) || coalesce(descriptions, '') ||
chr(10) || 'DATA:' || chr(10) || coalesce(data, '') || chr(10) || 'PREVIOUS USER REQUESTS:' || chr(10) || coalesce(string_agg(text, chr(10) || '  ')
OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ||
chr(10) || 'REQUEST:' || chr(10) || text AS prompt FROM conversations LEFT JOIN s ON conv_id = user_id WHERE role = 'user'""",
)
def prompt_table_of_owners(spark, sf):
    """Prompts with the schema, the descriptions and the fetched data of each thread's own document."""
    last = fo.last_values(td.field_edits(spark, sf))
    entry = F.concat(F.lit('"'), F.regexp_extract("path", r"^\$\.(.*)\.k$", 1), F.lit('":{"k":'), "value", F.lit("}"))
    docs = last.groupBy("db_id").agg(
        F.parse_json(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}"))).alias("doc")
    )
    docs = cut_lineage(docs)
    schemas = schema.compress(schema.profile(docs, max_depth=2, by=("db_id",)), by=("db_id",), max_depth=2)
    said = F.concat(F.lit("last "), F.regexp_extract("path", r"^\$\.(.*)\.k$", 1))
    told = td.field_edits(spark, sf).withColumn("description", said)
    wanted = docs.select("db_id", F.array(F.lit("$.click.k"), F.lit("$.purchase.k")).alias("path_list"))
    asked = td.said(spark, sf).where(F.col("role") == "user")
    return convo.owner_prompts(asked, OWNER_PROMPT, schemas, dc.upsert_descriptions(told), rq.fetch_any(docs, wanted))


@query(
    "prompt_table",
    """SELECT conv_id AS thread_id, turn, 'SCHEMA:' || chr(10) || '{"k":"integer"}' || chr(10) ||
'PREVIOUS USER REQUESTS:' || chr(10) || coalesce(string_agg(text, chr(10) || '  ')
OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ||
chr(10) || 'REQUEST:' || chr(10) || text AS prompt FROM conversations WHERE role = 'user'""",
)
def prompt_table(spark, sf):
    asked = td.said(spark, sf).where(F.col("role") == "user")
    docs = td.table(spark, sf, "events").select(F.col("event_id").alias("db_id"), F.parse_json("props").alias("doc"))
    shown = schema.compress(schema.profile(docs, max_depth=2), max_depth=2).scalar()
    prompt = convo.render(PROMPT, schema=F.col("schema"), context=F.col("context"), request=F.col("content"))
    return (
        convo.previous_context(asked)
        .withColumn("schema", shown)
        .select("thread_id", "turn", prompt.alias("prompt"))
    )
