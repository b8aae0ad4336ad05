"""Schemas derived from data: profiles, drift, conflicts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions.jsontext import json_type
from docmem.functions.paths import any_index, key_step
from docmem.operators.leaves import explode_leaves, is_container, list_items, object_entries, rebuild, walked

SEEN = "array<struct<path:string,jtype:string,leaf:boolean>>"


def infer(docs: DataFrame, *by: str) -> DataFrame:
    """One merged type per group of documents (or over all of them)."""
    return docs.groupBy(*by).agg(F.schema_of_variant_agg("doc").alias("schema"))


def typed_paths(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Leaf rows `(db_id, path, jtype)`; list positions become `[*]`."""
    return explode_leaves(docs.select("db_id", "doc"), max_depth=max_depth).select(
        "db_id", any_index("path").alias("path"), json_type("v").alias("jtype")
    )


def seen_paths(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(db_id, seen)`: all paths of a document, `seen` holding `(path, jtype, leaf)` once each.

    Documents are opened level by level inside their row, so that what occurs a
    thousand times in a document is told apart there and not by a shuffle.
    """
    if max_depth is None:
        return walked(docs.select("db_id", "doc"), seen_paths, F.to_json("doc"))

    def below(n: Column) -> Column:
        fields = F.transform(
            object_entries(n["v"]),
            lambda e: F.struct(F.concat(n["path"], key_step(e["key"])).alias("path"), e["value"].alias("v")),
        )
        items = F.transform(
            list_items(n["v"]), lambda x: F.struct(F.concat(n["path"], F.lit("[*]")).alias("path"), x.alias("v"))
        )
        return F.coalesce(fields, items, F.array().cast("array<struct<path:string,v:variant>>"))

    def told(n: Column) -> Column:
        return F.struct(n["path"].alias("path"), json_type(n["v"]).alias("jtype"), (~is_container(n["v"])).alias("leaf"))

    top = F.array(F.struct(F.lit("$").alias("path"), F.col("doc").alias("v")))
    out = docs.select("db_id", top.alias("_open"))
    # a document that is no object or list, or an empty one, is a leaf itself
    out = out.withColumn("seen", F.filter(F.transform("_open", told), lambda s: s["leaf"]))
    for _ in range(max_depth):
        out = out.withColumn("_open", F.flatten(F.transform("_open", below)))
        out = out.withColumn("seen", F.concat("seen", F.array_distinct(F.transform("_open", told))))
    deeper = F.exists("_open", lambda n: is_container(n["v"]))
    too_deep = F.raise_error(F.lit(f"nesting deeper than {max_depth} levels")).cast(SEEN)
    return out.select("db_id", F.when(deeper, too_deep).otherwise(F.col("seen")).alias("seen"))


def container_paths(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(db_id, path, jtype)` of the objects and lists above the leaves, each once per document."""
    above = F.filter("seen", lambda s: ~s["leaf"])
    rows = seen_paths(docs, max_depth).select("db_id", F.explode(above).alias("s"))
    return rows.select("db_id", "s.path", "s.jtype")


def _merge_types(types: Column) -> Column:
    """A set of type names in order; integers and numbers together are numbers."""
    both = F.array_contains(types, "integer") & F.array_contains(types, "number")
    return F.array_sort(F.when(both, F.array_remove(types, "integer")).otherwise(types))


def profile(docs: DataFrame, max_depth: int | None = None, by: tuple[str, ...] = (), containers: bool = False) -> DataFrame:
    """`(by, path, n, types)` over all documents, or per owner with `by=("db_id",)`.

    Counts per `(path, type)` combine on the map side, so what is shuffled grows
    with the number of distinct paths and not with the documents. With `containers`,
    paths of objects and lists are told as well, counted once per document.
    """
    rows = typed_paths(docs, max_depth)
    if containers:
        rows = rows.unionByName(container_paths(docs, max_depth))
    counts = rows.groupBy(*by, "path", "jtype").agg(F.count("*").alias("n"))
    return merge_profiles(counts, by)


def seen_types(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """`(path, jtype, n)`: documents that hold each path with each type, containers included.

    With `max_depth` given it serves streams as well: the state is one row per path and type.
    """
    rows = seen_paths(docs, max_depth).select(F.explode("seen").alias("s"))
    return rows.groupBy("s.path", "s.jtype").agg(F.count("*").alias("n"))


def merge_profiles(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Profiles from `(by, path, jtype, n)` rows; those of batches can be added up."""
    return counts.groupBy(*by, "path").agg(
        F.sum("n").alias("n"), _merge_types(F.collect_set("jtype")).alias("types")
    )


def presence(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Share of documents (one row each) that have each path; nothing is ever *required*."""
    paths = F.array_distinct(F.transform("seen", lambda s: s["path"]))
    per_doc = seen_paths(docs, max_depth).select(F.explode(paths).alias("path"))
    total = docs.agg(F.count("*")).scalar()
    return (
        per_doc.groupBy("path").agg(F.count("*").alias("n")).withColumn("ratio", F.col("n") / total)
    )


def compress(prof: DataFrame, by: tuple[str, ...] = (), max_depth: int | None = None) -> DataFrame:
    """A profile as one nested name-to-type text, lists as `[type]`.

    A field that happens to be called `type` is a field like any other. The
    result is one text: it grows with the distinct paths, not with the data.
    """
    keys = list(by) or ["_all"]
    rows = prof if by else prof.withColumn("_all", F.lit(0))
    # a path that is sometimes a leaf and sometimes a container shows both
    value = F.when(
        F.size("types") == 1, F.concat(F.lit('"'), F.element_at("types", 1), F.lit('"'))
    ).otherwise(F.to_json("types"))
    out = rebuild(rows.select(*keys, "path", value.alias("value")), keys, max_depth, alternatives=True)
    return out.select(*by, F.col("doc").alias("schema"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths added, removed or retyped from one profile to another.

    Profiles with containers show a scalar that became an object as retyped.
    """
    a = before.select("path", F.array_join("types", "|").alias("old_types"))
    b = after.select("path", F.array_join("types", "|").alias("new_types"))
    change = (
        F.when(F.col("old_types").isNull(), "added")
        .when(F.col("new_types").isNull(), "removed")
        .when(F.col("old_types") != F.col("new_types"), "retyped")
    )
    return a.join(b, "path", "full").withColumn("change", change).where("change IS NOT NULL")


def conflicts(prof: DataFrame) -> DataFrame:
    """Paths that hold values of several types, containers included if the profile has them; they stay VARIANT."""
    return prof.where(F.size("types") > 1)


def with_descriptions(prof: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Descriptions by path, and by owner where the profile is by owner."""
    keys = [c for c in ("db_id", "path") if c in prof.columns]
    return prof.join(descriptions.select(*keys, "description"), keys, "left")


def first_doc(docs: DataFrame, by: str, order: str) -> DataFrame:
    """The first stored document of each collection; `order` is unique in it.

    Collections are few and documents large: the first keys are found on the key
    columns alone, and fetch their documents by a join on that small side.
    """
    firsts = docs.groupBy(by).agg(F.min(order).alias(order))
    return docs.join(firsts, [by, order], "left_semi")


def listing(docs: DataFrame, keep: list[str], max_depth: int | None = None) -> DataFrame:
    """Nested field listing `(keep, path, jtype)`; lists are not entered."""
    rows = explode_leaves(docs.select(*keep, "doc"), enter_lists=False, max_depth=max_depth)
    return rows.select(*keep, "path", json_type("v").alias("jtype"))
