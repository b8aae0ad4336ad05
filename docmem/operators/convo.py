"""Conversations: messages, threads, contexts, tool calls, prompts.

`assemble` and `export` give a thread in *pages* of `PAGE` turn numbers.
`(thread_id, turn)` is unique, so a page holds at most `PAGE` messages however
long its thread is; the thread is its pages in the order of `page`. Contexts and
question-answer pairs are those of whole threads: pages only split the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 256
CONTEXT_SEPARATOR = "\n  "


def page_of(turn: str = "turn", size: int = PAGE) -> Column:
    return F.floor(F.greatest(F.col(turn), F.lit(0)) / size)


def with_visibility(messages: DataFrame) -> DataFrame:
    """Messages of tools are hidden, all others shown."""
    return messages.withColumn("is_visible", F.col("role") != "tool")


def visible(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("is_visible"))


def seed_system_turn(messages: DataFrame, prompt: str) -> DataFrame:
    """Give every thread without a system message one at turn -1."""
    threads = messages.groupBy("thread_id").agg(F.max(F.col("role") == "system").alias("seeded"))
    seeds = threads.where(~F.col("seeded")).select(
        "thread_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.lit(prompt).alias("content")
    )
    return messages.unionByName(seeds, allowMissingColumns=True)


def assemble(messages: DataFrame, size: int = PAGE) -> DataFrame:
    """Thread pages `(thread_id, page, messages, last_turn)` in turn order."""
    one = F.struct(*[c for c in ("turn", "role", "content", "is_visible") if c in messages.columns])
    return messages.groupBy("thread_id", page_of(size=size).alias("page")).agg(
        F.array_sort(F.collect_list(one)).alias("messages"), F.max("turn").alias("last_turn")
    )


def touched(messages: DataFrame, time: str = "created_at") -> DataFrame:
    """When each thread was last added to."""
    return messages.groupBy("thread_id").agg(F.max(time).alias("updated_at"))


def export(threads: DataFrame) -> DataFrame:
    """Visible messages as `{role, content}` in order."""
    shown = F.filter("messages", lambda m: m["is_visible"])
    return threads.withColumn(
        "messages", F.transform(shown, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    )


def last_message(messages: DataFrame) -> DataFrame:
    """Newest message per thread; partial results combine before the shuffle."""
    rest = [c for c in messages.columns if c != "thread_id"]
    return (
        messages.groupBy("thread_id").agg(F.max_by(F.struct(*rest), "turn").alias("m")).select("thread_id", "m.*")
    )


def previous_context(messages: DataFrame, size: int = PAGE) -> DataFrame:
    """Each message with all texts before it in its thread, as `context`.

    Texts are joined within a page first; the text of all earlier pages is made
    once per page and joined to its messages.
    """
    paged = messages.withColumn("_page", page_of(size=size))
    inside = Window.partitionBy("thread_id", "_page").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    one = F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("turn", "content"))))
    pages = paged.groupBy("thread_id", "_page").agg(F.transform(one, lambda m: m["content"]).alias("_texts"))
    earlier = Window.partitionBy("thread_id").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.size("_texts") > 0, F.array_join("_texts", CONTEXT_SEPARATOR))
    before = F.collect_list("_text").over(earlier)
    pages = pages.select("thread_id", "_page", text.alias("_text")).withColumn(
        "_before", F.when(F.size(before) > 0, F.array_join(before, CONTEXT_SEPARATOR))
    )
    own = F.collect_list("content").over(inside)
    return (
        paged.withColumn("_own", F.when(F.size(own) > 0, F.array_join(own, CONTEXT_SEPARATOR)))
        .join(pages.drop("_text"), ["thread_id", "_page"])
        .withColumn("context", F.concat_ws(CONTEXT_SEPARATOR, "_before", "_own"))
        .drop("_page", "_own", "_before")
    )


def numbered_by_role(messages: DataFrame, size: int = PAGE) -> DataFrame:
    """Messages with `pos`, their number among those of the same role in the whole thread.

    A message is numbered in its page; how many came in earlier pages is one row
    per page and role.
    """
    paged = messages.withColumn("_page", page_of(size=size))
    here = F.row_number().over(Window.partitionBy("thread_id", "role", "_page").orderBy("turn"))
    earlier = Window.partitionBy("thread_id", "role").orderBy("_page").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        paged.groupBy("thread_id", "role", "_page")
        .count()
        .withColumn("_before", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
        .drop("count")
    )
    return (
        paged.withColumn("_here", here)
        .join(counts, ["thread_id", "role", "_page"])
        .withColumn("pos", F.col("_before") + F.col("_here") - 1)
        .drop("_page", "_here", "_before")
    )


def qa_counts(messages: DataFrame) -> DataFrame:
    """`(thread_id, n_questions, n_answers, ok)` of every thread: `ok` when there are as many answers as questions."""
    return (
        messages.groupBy("thread_id")
        .agg(F.count_if(F.col("role") == "user").alias("n_questions"), F.count_if(F.col("role") == "assistant").alias("n_answers"))
        .withColumn("ok", F.col("n_questions") == F.col("n_answers"))
    )


def qa_pairs(messages: DataFrame) -> DataFrame:
    """`(thread_id, pos, question, answer)`: the n-th user turn with the n-th assistant turn, in threads that are `ok`."""
    whole = messages.join(qa_counts(messages).where("ok").select("thread_id"), "thread_id", "left_semi")
    turns = numbered_by_role(whole.where(F.col("role").isin("user", "assistant")))
    asked = turns.where(F.col("role") == "user").select("thread_id", "pos", F.col("content").alias("question"))
    told = turns.where(F.col("role") == "assistant").select("thread_id", "pos", F.col("content").alias("answer"))
    return asked.join(told, ["thread_id", "pos"])


def explode_calls(responses: DataFrame, keep: list[str]) -> DataFrame:
    """Tool calls of responses: `tool_calls array<struct<name, arguments>>` to rows."""
    return responses.select(*keep, F.posexplode("tool_calls").alias("pos", "call")).select(
        *keep, "pos", F.col("call.name").alias("name"), F.from_json("call.arguments", "map<string,string>").alias("args")
    )


def route_calls(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Calls with the `handler` of their name; NULL marks an unknown name.

    The registry lists the program's tools; Spark broadcasts it by its size.
    """
    return calls.join(registry.select("name", "handler"), "name", "left")


def concat_deltas(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Stream frames `(keys, pos, role, content)` to the text of each response.

    Frames that carry a role or no content add nothing. A response is one
    message, so its frames fit where the message does.
    """
    used = frames.where(F.col("role").isNull() & F.col("content").isNotNull())
    pieces = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return (
        used.groupBy(*keys)
        .agg(pieces.alias("p"))
        .select(*keys, F.array_join(F.transform("p", lambda x: x["content"]), "").alias("text"))
    )


def owner_prompts(asked: DataFrame, template: str, schemas: DataFrame, descriptions: DataFrame, fetched: DataFrame) -> DataFrame:
    """A prompt for each message `(thread_id, turn, content)` from what its owner has.

    `schemas(db_id, schema)`, `descriptions(db_id, path, description)` and `fetched(db_id,
    path, ord, value)` belong to the thread of the same id. The template's places are
    `{schema}`, `{descriptions}`, `{data}`, `{context}` and `{request}`; what an owner
    does not have is empty. Descriptions and answers are one line per path, in the
    order of the paths; what is fetched for a prompt has to fit into it.
    """
    line = lambda value: F.concat(F.col("path"), F.lit(": "), value)
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    described = descriptions.groupBy("db_id").agg(lines(line(F.col("description"))).alias("descriptions"))
    matches = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    answers = fetched.groupBy("db_id", "path").agg(F.concat(F.lit("["), F.array_join(matches, ","), F.lit("]")).alias("m"))
    data = answers.groupBy("db_id").agg(lines(line(F.col("m"))).alias("data"))
    owner = schemas.join(described, "db_id", "full").join(data, "db_id", "full").withColumnRenamed("db_id", "thread_id")
    places = {c: F.col(c) for c in ("schema", "descriptions", "data", "context")}
    prompt = render(template, request=F.col("content"), **places)
    return previous_context(asked).join(owner, "thread_id", "left").select("thread_id", "turn", prompt.alias("prompt"))


def render(template: str, **fields: Column) -> Column:
    """Fill `{name}` places of a template; fields are not searched for places."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in fields if "{" + k + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(fields[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)
