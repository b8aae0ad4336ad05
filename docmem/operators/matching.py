"""Updates of the list elements that match a condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmem.functions.jsontext import quote, text_kind
from docmem.functions.paths import ANY_ELEMENT_PATH, ELEMENT_PATH
from docmem.operators import fold as fo
from docmem.operators import sequenced
from docmem.operators.leaves import object_entries
from docmem.session import cut_lineage, cut_wide


def _object_text(entries):
    """JSON text of `array<struct<key, value>>`, `value` being JSON text."""
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(":"), e["value"])), ","),
        F.lit("}"),
    )


def _entries(text):
    return F.transform(
        object_entries(F.try_parse_json(text)),
        lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
    )


def element_updates(edits: DataFrame) -> DataFrame:
    """Edits of list elements, taken apart:
    `(db_id, seq, path, field, equals, target, data)`.

    `$.phones[?name = "adam"].prefix` selects elements by a field and a JSON
    literal; `$.phones[*].prefix` selects all (`field` and `equals` are empty).
    """
    part = lambda i: F.regexp_extract("path", ELEMENT_PATH, i)
    return edits.where(F.col("path").rlike(ELEMENT_PATH)).select(
        "db_id",
        "seq",
        part(1).alias("path"),
        part(2).alias("field"),
        part(3).alias("equals"),
        part(4).alias("target"),
        "data",
    )


def update_matching(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """Set or extend a field of selected elements.

    `elements` are fold rows, `updates` as
    from `element_updates`. An update reaches the elements that were in the list
    before it. The fold rule holds per element and field: a list grows, anything
    else is replaced; every matching element keeps its own list.

    Of the updates that select alike only the latest can win, and it wins iff it
    is later than the element. So updates shrink to one row per selector before
    they meet the elements, by equality of `(db_id, path, field, equals)`. Only
    fields where lists are involved need all updates; there each one ends up in
    the result.

    An update of a field that also selects in the same list would change what
    later updates select; such lists belong to `update_any`, and none may come here.
    """
    key = ["db_id", "path", "field", "equals"]
    latest = updates.groupBy(*key, "target").agg(
        F.max("seq").alias("u_seq"),
        F.max_by("data", "seq").alias("data"),
        F.max(text_kind("data") == "list").alias("lists"),
    )
    fields = latest.select("db_id", "path", "field").distinct()
    identity = ["db_id", "path", "seq", "idx"]
    every = F.struct(F.lit("").alias("field"), F.lit("").alias("equals"))
    own = F.transform(_entries(F.col("value")), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("equals")))
    facts = (
        elements.where(F.col("in_list") & (text_kind("value") == "object"))
        .select(*identity, "value", F.explode(F.concat(own, F.array(every))).alias("fact"))
        .select(*identity, "value", "fact.*")
        .join(fields, ["db_id", "path", "field"], "left_semi")
    )
    old = F.to_json(F.try_variant_get(F.parse_json("value"), F.concat(F.lit("$."), F.col("target")), "variant"))
    met = (
        facts.join(latest, key)
        .where(F.col("u_seq") > F.col("seq"))
        .withColumn("old", old)
        .withColumn("grows", F.col("lists") | F.coalesce(text_kind("old") == "list", F.lit(False)))
    )
    met = cut_lineage(met)  # read by each of the branches below
    one = F.struct(*identity).alias("element")
    # a field grows if any of its selectors says so
    growing = met.where("grows").select(one, "target").distinct()
    plain = (
        met.select(one, "target", "u_seq", "data")
        .join(growing, ["element", "target"], "left_anti")
        .groupBy("element", "target")
        .agg(F.max_by("data", "u_seq").alias("data"))
    )
    hits = met.select(one, *key, "target", "old").join(growing, ["element", "target"], "left_semi")
    added = hits.join(updates, [*key, "target"]).where(F.col("seq") > F.col("element.seq"))
    writes = added.select("element", "target", "seq", "data").unionByName(
        hits.where("old IS NOT NULL")
        .select("element", "target", F.col("element.seq").alias("seq"), F.col("old").alias("data"))
        .distinct()
    )
    folded = fo.fold_writes(
        writes.select(
            F.col("element").alias("db_id"),
            F.col("target").alias("path"),
            "seq",
            F.col("data").alias("value"),
            F.lit(False).alias("marker"),
            text_kind("data").alias("kind"),
        ),
        positions=False,
    )
    grown = (
        folded.groupBy("db_id", "path")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("in_list"), F.struct("seq", "idx", "value")))).alias("items"),
            F.max(F.when(~F.col("in_list"), F.col("value"))).alias("plain"),
        )
        .select(
            F.col("db_id").alias("element"),
            F.col("path").alias("target"),
            F.coalesce(
                "plain",
                F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["value"]), ",", "null"), F.lit("]")),
            ).alias("data"),
        )
    )
    changes = (
        plain.unionByName(grown)
        .groupBy("element")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("target").alias("key"), F.col("data").alias("value")))).alias(
                "set"
            )
        )
        .select("element.*", "set")
    )
    entries = _entries(F.col("value"))
    named = F.transform("set", lambda s: s["key"])
    merged = F.concat(F.filter(entries, lambda e: ~F.array_contains(named, e["key"])), F.col("set"))
    return elements.join(changes, identity, "left").select(
        "db_id",
        "path",
        "pos",
        "seq",
        "idx",
        F.when(F.col("set").isNull(), F.col("value")).otherwise(_object_text(merged)).alias("value"),
        "in_list",
    )


def replay(edits: DataFrame, **options) -> DataFrame:
    """Fold a log that may also edit list elements, by any selector (see `sequenced.element_edits`)."""
    of_elements = F.col("path").rlike(ANY_ELEMENT_PATH)
    folded = fo.fold(edits.where(~of_elements), **options)
    if edits.where(of_elements).isEmpty():
        return folded
    return update_any(cut_wide(folded), edits)


def update_any(elements: DataFrame, edits: DataFrame) -> DataFrame:
    """Fold rows with the element edits of a log applied.

    Lists whose updates select by equality and set one other field take
    `update_matching`, where only the latest update of each selector travels. The
    rest, positions, comparisons, whole elements, nested targets, and updates that
    change what others select by, takes `sequenced.replay_lists`.
    """
    updates = sequenced.element_edits(edits)
    lists = cut_wide(sequenced.entangled(updates))
    if lists.isEmpty():
        return update_matching(elements, element_updates(edits))
    key = ["db_id", "path"]
    simple = element_updates(edits).join(lists, key, "left_anti")
    easy = update_matching(elements.join(lists, key, "left_anti"), simple)
    hard = sequenced.replay_lists(elements.join(lists, key, "left_semi"), updates.join(lists, key, "left_semi"))
    return easy.unionByName(hard)


def append_to_each(docs: DataFrame, adds: DataFrame, target: str) -> DataFrame:
    """`$.list[*].target`: add to the list of *every* matching element.

    `docs(db_id, items)` holds the list's elements as JSON texts, `adds(db_id,
    adds)` the JSON texts to add. Each element keeps its own list; the added
    values do not overwrite what the other elements hold. A field that is no
    list is set to the last added value, a missing one is left missing.
    """

    def change(item):
        v = F.parse_json(item)
        have = F.try_variant_get(v, f"$.{target}", "array<variant>")
        grown = F.concat(
            F.lit("["),
            F.array_join(F.concat(F.transform(have, lambda x: F.to_json(x)), F.col("adds")), ",", "null"),
            F.lit("]"),
        )
        value = F.when(have.isNotNull(), grown).otherwise(F.element_at("adds", -1))
        entries = F.transform(
            _entries(item),
            lambda e: F.when(
                e["key"] == target, F.struct(e["key"].alias("key"), value.alias("value"))
            ).otherwise(e),
        )
        return _object_text(entries)

    return docs.join(adds, "db_id", "left").select(
        "db_id",
        F.when(F.coalesce(F.size("adds"), F.lit(0)) == 0, F.col("items"))
        .otherwise(F.transform("items", change))
        .alias("items"),
    )
