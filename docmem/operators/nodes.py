"""Tree nodes: every object as one row holding only its scalar fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions.jsontext import quote
from docmem.operators.leaves import is_container, list_items, walked
from docmem.session import cut_lineage

SUMMARY_CHARS = 50


def _entries(text: Column) -> Column:
    """Fields of an object in written order: key, raw text, and VARIANT for the kind.

    A map parsed from JSON keeps the written order of the keys and the raw text
    of nested values, which a VARIANT would sort.
    """
    raw = F.map_entries(F.from_json(text, "map<string,string>"))
    typed = F.map_entries(F.from_json(text, "map<string,variant>"))
    return F.zip_with(
        raw,
        typed,
        lambda r, t: F.struct(
            r["key"].alias("key"),
            r["value"].alias("text"),
            t["value"].alias("v"),
            _is_nested(t["value"]).alias("nested"),
        ),
    )


def _is_nested(v: Column) -> Column:
    return F.coalesce(
        F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        | F.try_variant_get(v, "$", "array<variant>").isNotNull(),
        F.lit(False),
    )


def _shown(e: Column) -> Column:
    """A scalar as the summary prints it: None, True, False, text or number."""
    kind = F.schema_of_variant(e["v"])
    return (
        F.when(e["text"].isNull(), "None")
        .when(kind == "BOOLEAN", F.initcap(e["text"]))
        .otherwise(e["text"])
    )


def _literal(e: Column) -> Column:
    string = F.schema_of_variant(e["v"]) == "STRING"
    return F.when(e["text"].isNull(), "null").when(string, quote(e["text"])).otherwise(e["text"])


def _scalars(entries: Column) -> Column:
    return F.filter(entries, lambda e: ~e["nested"])


def _summary(text: Column) -> Column:
    shown = F.transform(_scalars(_entries(text)), lambda e: F.concat(e["key"], F.lit(": "), _shown(e)))
    return F.substring(F.array_join(shown, ", "), 1, SUMMARY_CHARS)


def tree_nodes(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(db_id, path, node)` from JSON texts `(db_id, doc)`.

    `node` is JSON text of the object's scalar fields in written order; objects
    without any give no row. The top is `root`; the items of a list are
    `path[i] (summary)`, the summary naming their scalar fields. Scalar items
    give no row. Like the leaf walk this is one explode per level, no shuffle.
    """
    if max_depth is None:
        return walked(docs.select("db_id", "doc"), tree_nodes, F.col("doc"))
    out = docs.select(
        "db_id", F.array(F.struct(F.lit("").alias("path"), F.col("doc").alias("text"))).alias("todo")
    ).select("db_id", F.explode("todo").alias("t"))
    out = out.select("db_id", "t.path", "t.text", F.lit(False).alias("done"))
    for _ in range(max_depth):
        first = F.substring(F.ltrim("text"), 1, 1)
        is_object = ~F.col("done") & (first == "{")
        is_list = ~F.col("done") & (first == "[")
        here = F.col("path")
        entries = F.col("_entries")
        own = F.transform(_scalars(entries), lambda e: F.concat(quote(e["key"]), F.lit(":"), _literal(e)))
        node = F.struct(
            F.when(here == "", "root").otherwise(here).alias("path"),
            F.concat(F.lit("{"), F.array_join(own, ","), F.lit("}")).alias("text"),
            F.lit(True).alias("done"),
        )
        below = F.transform(
            F.filter(entries, lambda e: e["nested"]),
            lambda e: F.struct(
                F.when(here == "", e["key"]).otherwise(F.concat(here, F.lit("."), e["key"])).alias("path"),
                e["text"].alias("text"),
                F.lit(False).alias("done"),
            ),
        )
        items, kinds = F.col("_items"), F.col("_kinds")
        listed = F.filter(
            F.zip_with(
                F.transform(
                    items,
                    lambda x, i: F.struct(
                        F.concat(here, F.lit("["), i.cast("string"), F.lit("] (")).alias("head"), x.alias("text")
                    ),
                ),
                kinds,
                lambda p, k: F.when(
                    _is_nested(k),
                    F.struct(
                        F.concat(
                            p["head"],
                            F.when(F.substring(p["text"], 1, 1) == "{", _summary(p["text"])).otherwise(
                                F.substring(p["text"], 1, SUMMARY_CHARS)
                            ),
                            F.lit(")"),
                        ).alias("path"),
                        p["text"].alias("text"),
                        F.lit(False).alias("done"),
                    ),
                ),
            ),
            lambda x: x.isNotNull(),
        )
        itself = F.array(F.struct(F.col("path"), F.col("text"), F.col("done")))
        some = F.filter(F.array(node), lambda x: x["text"] != "{}")
        step = F.when(is_object, F.concat(some, below)).when(is_list, listed).otherwise(itself)
        # opened in columns of their own: each text is parsed once per level
        opened = (
            out.withColumn("_entries", _entries(F.when(is_object, F.col("text"))))
            .withColumn("_items", F.from_json(F.when(is_list, F.col("text")), "array<string>"))
            .withColumn("_kinds", F.from_json(F.when(is_list, F.col("text")), "array<variant>"))
        )
        out = opened.select("db_id", F.explode(step).alias("t")).select("db_id", "t.path", "t.text", "t.done")
    too_deep = F.raise_error(F.concat(F.lit(f"nesting deeper than {max_depth} levels at "), F.col("path")))
    return out.select(
        "db_id",
        F.when(F.col("done"), F.col("path")).otherwise(too_deep.cast("string")).alias("path"),
        F.col("text").alias("node"),
    )


def duplicates(rows: DataFrame) -> DataFrame:
    """Fingerprints of equal nodes: `(fp, n, n_docs)` for those seen more than once.

    Counts per `(node, document)` come first, so that a node found in a third of
    all documents is counted by many tasks and combined from small rows.
    """
    fp = rows.select("db_id", F.sha2("node", 256).alias("fp"))
    per_doc = fp.groupBy("fp", "db_id").agg(F.count("*").alias("n"))
    return (
        per_doc.groupBy("fp").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).where(F.col("n") > 1)
    )


def subtrees(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(db_id, fp, parent)` of every object and list of the documents (VARIANT `doc`) that is not empty.

    `fp` is the SHA-256 of the value's JSON text with sorted keys, so that the order
    in which keys were written does not matter; `parent` is that of the object or list
    around it, NULL at the top. Numbers are equal if they are written alike (`1`, not `1.0`).
    """
    if max_depth is None:
        return walked(docs.select("db_id", "doc"), subtrees, F.to_json("doc"))
    none = F.lit(None).cast("string")
    out = docs.where(is_container("doc")).select(
        "db_id", none.alias("parent"), none.alias("fp"), F.col("doc").alias("v")
    )
    for _ in range(max_depth):
        opened = (
            out.withColumn("_own", F.coalesce("fp", F.sha2(F.to_json("v"), 256)))
            .withColumn("_fields", F.when(F.col("fp").isNull(), F.map_values(F.try_variant_get("v", "$", "map<string,variant>"))))
            .withColumn("_items", F.when(F.col("fp").isNull(), list_items("v")))
        )
        below = F.filter(F.coalesce("_fields", "_items", F.array().cast("array<variant>")), lambda x: is_container(x))
        itself = F.array(
            F.struct(F.col("parent"), F.col("_own").alias("fp"), F.lit(None).cast("variant").alias("v"))
        )
        children = F.transform(below, lambda x: F.struct(F.col("_own").alias("parent"), none.alias("fp"), x.alias("v")))
        out = opened.select("db_id", F.explode(F.concat(itself, children)).alias("t")).select("db_id", "t.parent", "t.fp", "t.v")
    too_deep = F.raise_error(F.lit(f"nesting deeper than {max_depth} levels"))
    return out.select("db_id", F.coalesce("fp", too_deep.cast("string")).alias("fp"), "parent")


def duplicate_subtrees(rows: DataFrame) -> DataFrame:
    """Repeated objects and lists, maximal ones only: `(fp, n, n_docs, n_top)` from `subtrees`.

    `n_top` counts the places where what is around the value is not itself repeated;
    values that are only ever found inside larger repeated ones are left out. Counts
    combine by value and document, and by value and parent, before anything is joined.
    """
    rows = cut_lineage(rows)
    per_doc = rows.groupBy("fp", "db_id").agg(F.count("*").alias("n"))
    counts = per_doc.groupBy("fp").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).where(F.col("n") > 1)
    # tops have no parent: keys of their own, which match nothing, spread them
    around = F.coalesce("parent", F.concat(F.lit("top "), "fp")).alias("parent")
    pairs = rows.groupBy("fp", around).agg(F.count("*").alias("n_top"))
    inside = counts.select(F.col("fp").alias("parent"))
    tops = pairs.join(inside, "parent", "left_anti").groupBy("fp").agg(F.sum("n_top").alias("n_top"))
    return counts.join(tops, "fp")
