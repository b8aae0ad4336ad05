"""Documents to leaf rows, and back.

The walk to a given depth is a chain of one `explode` per nesting level inside a single
stage: a container is replaced by its children, a finished leaf passes through. Without a
given depth each document is walked to its own depth by a kernel, and exploded once.
No shuffle, no recursion, no per-level job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions import kernels
from docmem.functions.jsontext import Col, col, json_type, quote
from docmem.functions.paths import key_step, steps_of

CHAIN = 8  # levels of one walk; documents nested deeper are walked apart from the others


def json_depth(text: Col) -> Column:
    """How many containers enclose the innermost place of a JSON text; empty containers count."""
    bare = F.regexp_replace(F.regexp_replace(col(text), r"\\.", ""), r'"[^"]*"', "")
    marks = F.regexp_replace(bare, r"[^\[\]{}]+", "")
    runs = F.regexp_extract_all(marks, F.lit(r"[\[{]+[\]}]*"), F.lit(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, run: Column) -> Column:
        opens = F.length(F.translate(run, "]}", ""))
        return F.struct(
            (acc["now"] + 2 * opens - F.length(run)).alias("now"), F.greatest(acc["most"], acc["now"] + opens).alias("most")
        )

    return F.aggregate(runs, start, step, lambda acc: acc["most"])


def document_depth(df: DataFrame, text: Column | None = None) -> int:
    """The depth of the deepest document (VARIANT `doc`, or `text`); one scan, nothing is exploded."""
    return df.agg(F.max(json_depth(F.to_json("doc") if text is None else text))).first()[0] or 0


def walked(df: DataFrame, walk: Callable[[DataFrame, int], DataFrame], text: Column | None = None) -> DataFrame:
    """A walk of all documents to their own depth: `walk(docs, levels)` for each depth class.

    Nearly all documents go through one chain of few levels. Deeper ones are told by
    their text and walked in chains of doubled length, so that one deep document
    neither fails the job nor lengthens the walk of the others.
    """
    deepest = document_depth(df, text)
    if deepest <= CHAIN:
        return walk(df, deepest)
    depth = json_depth(F.to_json("doc") if text is None else text)
    out, low, high = None, -1, CHAIN
    while low < deepest:
        levels = min(high, deepest)
        some = walk(df.where((F.coalesce(depth, F.lit(0)) > low) & (F.coalesce(depth, F.lit(0)) <= levels)), levels)
        out = some if out is None else out.unionByName(some)
        low, high = levels, 2 * high
    return out


def object_entries(v: Col) -> Column:
    """`array<struct<key, value>>` of an object, NULL for anything else."""
    return F.map_entries(F.try_variant_get(col(v), "$", "map<string,variant>"))


def list_items(v: Col) -> Column:
    return F.try_variant_get(col(v), "$", "array<variant>")


def open_containers(df: DataFrame, enter_lists: bool) -> DataFrame:
    """Add the children of `v` as `_fields` and `_items`, NULL where there are none.

    They are columns of their own, so that each value is opened once although
    the next step looks at its children more than once.
    """
    out = df.withColumn("_fields", object_entries("v"))
    return out.withColumn("_items", list_items("v") if enter_lists else F.lit(None).cast("array<variant>"))


def step_down() -> Column:
    """Children of an opened non-empty container as an array, else the leaf itself."""
    path = F.col("path")
    return (
        F.when(
            F.size("_fields") > 0,
            F.transform(
                "_fields",
                lambda e: F.struct(F.concat(path, key_step(e["key"])).alias("path"), e["value"].alias("v")),
            ),
        )
        .when(
            F.size("_items") > 0,
            F.transform(
                "_items",
                lambda x, i: F.struct(
                    F.concat(path, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")
                ),
            ),
        )
        .otherwise(F.array(F.struct(path.alias("path"), F.col("v").alias("v"))))
    )


def is_container(v: Col, enter_lists: bool = True) -> Column:
    more = F.coalesce(F.size(object_entries(v)) > 0, F.lit(False))
    if enter_lists:
        more = more | F.coalesce(F.size(list_items(v)) > 0, F.lit(False))
    return more


def explode_leaves(
    df: DataFrame,
    doc: str = "doc",
    *,
    enter_lists: bool = True,
    max_depth: int | None = None,
    root: Column | None = None,
) -> DataFrame:
    """One row per leaf of the VARIANT column `doc`: `(..., path, v)`.

    Leaves are scalars, JSON null, and empty containers (kept so that a rebuild
    gives the document back). With `enter_lists=False` a list is a leaf. Each document is
    walked to its own depth; a caller who knows the depth gives `max_depth`, so that no text
    is looked at: deeper nesting then fails the job instead of losing data.
    """
    keep = [c for c in df.columns if c != doc]
    out = df.select(*keep, (root if root is not None else F.lit("$")).alias("path"), F.col(doc).alias("v"))
    if max_depth is None:
        return out.select(*keep, F.explode(kernels.opened(F.col("path"), F.col("v"), enter_lists)).alias("_item")).select(*keep, "_item.path", "_item.v")
    for _ in range(max_depth):
        out = (
            open_containers(out, enter_lists)
            .select(*keep, F.explode(step_down()).alias("_item"))
            .select(*keep, "_item.path", "_item.v")
        )
    too_deep = F.raise_error(F.concat(F.lit(f"nesting deeper than {max_depth} levels at "), F.col("path")))
    checked = F.when(is_container("v", enter_lists), too_deep.cast("string")).otherwise(F.col("path"))
    return out.withColumn("path", checked)


def leaves(df: DataFrame, doc: str = "doc", **options) -> DataFrame:
    """Leaf rows with JSON text and type: `(..., path, value, jtype)`."""
    out = explode_leaves(df, doc, **options)
    keep = [c for c in out.columns if c != "v"]
    return out.select(*keep, F.to_json("v").alias("value"), json_type("v").alias("jtype"))


def _key_of(step: Column) -> Column:
    """The key of a step as a JSON string."""
    inner = step.substr(F.lit(3), F.length(step) - 4)
    raw = F.regexp_replace(inner, r"\\(.)", "$1")
    return quote(F.when(step.startswith("."), F.substring(step, 2, 1 << 30)).otherwise(raw))


def rebuild(df: DataFrame, keys: list[str], max_depth: int | None = None, alternatives: bool = False) -> DataFrame:
    """Inverse of the leaf walk: rows `(keys, path, value)` to `(keys, doc)`.

    Levels close from the deepest up. Every level groups by `keys` plus the
    parent path on data already partitioned by `keys`, so one shuffle serves
    all of them. Documents deeper than a few levels are written in one go instead, from
    their leaves in order (`_written`). Steps `[i]` close as a list in order,
    a step `[*]` as a one-element list (used for schemas).
    Keys must bound the group: callers page large documents first. There are as many
    levels as the longest path has steps; a caller who knows gives `max_depth` and
    saves that count: deeper paths then fail the job instead of giving a second
    document. So does a place with a value of its own and children; with
    `alternatives` (schemas) it closes as a list of both.
    """
    if max_depth is None:
        max_depth = df.agg(F.max(kernels.most_steps(F.col("path")))).first()[0] or 0
    if max_depth > CHAIN + 1 and not alternatives:
        return _written(df, keys, max_depth)
    steps = steps_of("path")
    deep = F.raise_error(F.concat(F.lit(f"nesting deeper than {max_depth} levels at "), F.col("path")))
    steps = F.when(F.size(steps) > max_depth, deep.cast("array<string>")).otherwise(steps)
    out = df.select(*keys, steps.alias("_at"), "value")
    if max_depth > CHAIN + 1:
        below = F.size("_at") > CHAIN
        closed = _close(out.where(below).repartition(*keys), keys, max_depth, CHAIN + 1, alternatives)
        out = out.where(~below).unionByName(closed)
        max_depth = CHAIN + 1
    return _close(out.repartition(*keys), keys, max_depth, 0, alternatives).select(*keys, F.col("value").alias("doc"))


def _written(rows: DataFrame, keys: list[str], deepest: int) -> DataFrame:
    """Rows `(keys, path, value)` to `(keys, doc)`, one grouping whatever the depth.

    The leaves of a document are put in order and written one after the other, so the
    work is that of the leaves, not of leaves times levels.
    """
    parallel = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, so that small but laborious parts are not merged
    leaf = F.struct(F.col("path").alias("path"), F.col("value").alias("value"))
    docs = rows.select(*keys, leaf.alias("_leaf")).repartition(parallel, *keys).groupBy(*keys).agg(F.collect_list("_leaf").alias("_all"))
    return docs.select(*keys, kernels.text_of_leaves(F.col("_all"), deepest).alias("doc"))


def _close(out: DataFrame, keys: list[str], deepest: int, until: int, alternatives: bool) -> DataFrame:
    """Rows `(keys, _at, value)` with the places deeper than `until` closed into their parents."""
    # an empty object above its fields is those fields, an empty list above its elements those elements
    own_counts = F.when(F.col("_own") == "{}", F.size("_fields") == 0).when(F.col("_own") == "[]", F.size("_slots") == 0).otherwise(True)
    kept_own = F.when(own_counts, F.col("_own"))
    both = (
        (F.size("_fields") > 0).cast("int")
        + (F.size("_slots") > 0).cast("int")
        + F.col("_item").isNotNull().cast("int")
        + kept_own.isNotNull().cast("int")
    )
    fields = F.when(
        F.size("_fields") > 0, F.concat(F.lit("{"), F.array_join(F.array_sort("_fields"), ","), F.lit("}"))
    )
    in_order = F.transform(F.array_sort("_slots"), lambda s: s["value"])
    slots = F.when(F.size("_slots") > 0, F.concat(F.lit("["), F.array_join(in_order, ","), F.lit("]")))
    item = F.concat(F.lit("["), "_item", F.lit("]"))
    if alternatives:
        own = F.regexp_replace(kept_own, r"^\[(.*)\]$", "$1")
        clash = F.concat(F.lit("["), F.concat_ws(",", own, fields, slots, item), F.lit("]"))
    else:
        clash = F.raise_error(F.concat(F.lit("a value and children at the same place below "), F.to_json("_at"))).cast("string")

    for depth in range(deepest, until, -1):
        here = F.size("_at") == depth
        step = F.try_element_at("_at", F.lit(-1))
        position = F.regexp_extract(step, r"^\[(\d+)\]$", 1)
        is_key = (position == "") & (step != "[*]")
        out = (
            out.select(
                *keys,
                F.when(here, F.slice("_at", 1, depth - 1)).otherwise(F.col("_at")).alias("_at"),
                F.when(here & is_key, F.concat(_key_of(step), F.lit(":"), "value")).alias("_field"),
                F.when(here & (position != ""), F.struct(position.try_cast("bigint").alias("i"), F.col("value").alias("value"))).alias("_slot"),
                F.when(here & (step == "[*]"), F.col("value")).alias("_item"),
                F.when(~here, F.col("value")).alias("_own"),
            )
            .groupBy(*keys, "_at")
            .agg(
                F.collect_list("_field").alias("_fields"),
                F.collect_list("_slot").alias("_slots"),
                F.max("_item").alias("_item"),
                F.max("_own").alias("_own"),
            )
            .select(
                *keys,
                "_at",
                F.when(both > 1, clash).otherwise(F.coalesce(fields, slots, item, kept_own)).alias("value"),
            )
        )
    return out
