"""Updates of list elements in every form, also where one update changes what another selects.

An element is told by its arrival `(db_id, path, seq, idx)`; its position never changes,
as lists only grow. What an update does to it depends on that element alone, so no
list is ever replayed as a whole: elements meet the updates that select them by joins
(equal values, bins of compared values, positions), and each element applies its own
hits in order.

Where an update may change a field that others select by, elements live through
*versions*: in each round every element that is still open looks for the first such
update that reaches it, takes it, and goes on from there. Rounds end when no element is
reached any more; there are as many as the most such updates of one element, not of a
list. All other updates meet the versions, each within its span of `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmem.functions.jsontext import let, quote, text_kind
from docmem.functions.paths import ANY_ELEMENT_PATH
from docmem.operators.leaves import list_items, object_entries
from docmem.session import cut_wide

SEGMENT = 1 << 20
LIST = ["db_id", "path"]
_UPDATE = ["how", "field", "op", "literal", "at", "target", "data"]


def element_edits(edits: DataFrame) -> DataFrame:
    """Edits of list elements, taken apart: `(db_id, seq, path, how, field, op, literal, at, target, data)`.

    `how` is `all` (`[*]`), `at` (`[2]`, `[-1]`) or `test` (`[?price > 10]`). `target`
    holds the keys below the element, empty when the edit is of the element itself.
    """
    part = lambda i: F.regexp_extract("path", ANY_ELEMENT_PATH, i)
    selector = part(2)
    return edits.where(F.col("path").rlike(ANY_ELEMENT_PATH)).select(
        "db_id",
        "seq",
        part(1).alias("path"),
        F.when(selector == "*", "all").when(selector.startswith("?"), "test").otherwise("at").alias("how"),
        part(3).alias("field"),
        F.when(part(4) == "==", "=").otherwise(part(4)).alias("op"),
        part(5).alias("literal"),
        F.when(selector.rlike(r"^-?\d+$"), selector.cast("bigint")).alias("at"),
        F.filter(F.split(part(6), r"\."), lambda k: k != "").alias("target"),
        "data",
    )


def _top() -> Column:
    return F.coalesce(F.get("target", F.lit(0)), F.lit(""))


def entangled(updates: DataFrame) -> DataFrame:
    """`(db_id, path)` of the lists that need `replay_lists`: other than equality tests of one field that set another."""
    simple = (F.col("how") == "all") | ((F.col("how") == "test") & (F.col("op") == "="))
    other = updates.where(~simple | (F.size("target") != 1)).select(*LIST)
    fields = updates.where("how = 'test'").select(*LIST, "field").distinct()
    moving = updates.select(*LIST, _top().alias("field")).distinct().join(fields, [*LIST, "field"], "left_semi")
    return other.unionByName(moving.select(*LIST)).distinct()


# ---- one element ---------------------------------------------------------------


def _entries(text: Column) -> Column:
    return F.transform(
        object_entries(F.try_parse_json(text)),
        lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
    )


def _list_texts(text: Column) -> Column:
    return F.transform(list_items(F.try_parse_json(text)), lambda x: F.to_json(x))


def _grown(old: Column, data: Column) -> Column:
    """The fold rule at one place: a list grows, anything else is replaced."""
    more = F.when(text_kind(data) == "list", _list_texts(data)).otherwise(F.array(data))
    joined = F.concat(F.lit("["), F.array_join(F.concat(_list_texts(old), more), ",", "null"), F.lit("]"))
    return F.when(old.isNotNull() & (text_kind(old) == "list"), joined).otherwise(data)


def _put(text: Column, keys: Column, data: Column, depth: int, most: int) -> Column:
    """The JSON text with `data` written at the place `keys[depth:]` below it.

    Missing objects are made; below a scalar, null or list there is no place to go.
    """
    here = _grown(text, data)
    if depth == most:
        return here
    key = F.get(keys, F.lit(depth))

    def into(entries: Column) -> Column:
        old = F.get(F.filter(entries, lambda e: e["key"] == key), F.lit(0))["value"]
        new = let(old, lambda o: _put(o, keys, data, depth + 1, most))
        kept = F.filter(entries, lambda e: e["key"] != key)
        all_of = F.concat(kept, F.array(F.struct(key.alias("key"), new.alias("value"))))
        told = F.transform(all_of, lambda e: F.concat(quote(e["key"]), F.lit(":"), e["value"]))
        return F.concat(F.lit("{"), F.array_join(told, ","), F.lit("}"))

    nothing = F.array().cast("array<struct<key: string, value: string>>")
    held = F.when(text.isNull(), nothing).when(text_kind(text) == "object", F.coalesce(_entries(text), nothing))
    below = let(held, lambda entries: F.when(entries.isNull(), text).otherwise(into(entries)))
    return F.when(F.size(keys) == depth, here).otherwise(below)


# ---- elements and updates ------------------------------------------------------


def _value_key(kind: Column, number: Column, text: Column) -> Column:
    return F.when(kind == "n", F.concat(F.lit("n"), number.cast("string"))).when(kind == "s", F.concat(F.lit("s"), text))


def _bin(kind: Column, number: Column, text: Column) -> Column:
    """Bins in the order of the values: powers of two of numbers, first characters of text."""
    power = F.floor(F.log2(F.abs(number))).cast("int") + 1100
    of_number = F.when(number == 0, 0).otherwise((F.signum(number) * power).cast("int"))
    return F.when(kind == "n", of_number).otherwise(F.ascii(text))


def _typed(updates: DataFrame) -> DataFrame:
    """Tests with their literal as a value: `kind`, `number`, `text`, `bin`."""
    literal = F.col("literal")
    is_text = literal.startswith('"')
    out = updates.withColumn("kind", F.when(is_text, "s").otherwise("n"))
    out = out.withColumn("number", F.when(~is_text, literal.cast("double")))
    out = out.withColumn("text", F.when(is_text, literal.substr(F.lit(2), F.length(literal) - 2)))
    return out.withColumn("bin", _bin(F.col("kind"), F.col("number"), F.col("text")))


def _facts(versions: DataFrame, fields: DataFrame) -> DataFrame:
    """`(element, since, until, db_id, path, field, kind, number, text)` of the fields that tests of the list look at."""
    v = F.try_parse_json("value")
    found = F.transform(
        "fields",
        lambda f: F.struct(f.alias("field"), F.try_variant_get(v, F.concat(F.lit('$["'), f, F.lit('"]')), "variant").alias("v")),
    )
    rows = versions.join(fields, LIST).select("element", "since", "until", *LIST, F.explode(found).alias("f"))
    kind = F.schema_of_variant("f.v")
    rows = rows.select(
        "element",
        "since",
        "until",
        *LIST,
        "f.field",
        F.when(kind == "STRING", "s").when(kind.rlike("^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"), "n").alias("kind"),
        F.col("f.v").alias("v"),
    ).where("kind IS NOT NULL")
    number = F.when(F.col("kind") == "n", F.try_variant_get("v", "$", "double"))
    text = F.when(F.col("kind") == "s", F.try_variant_get("v", "$", "string"))
    return rows.select(*[c for c in rows.columns if c != "v"], number.alias("number"), text.alias("text"))


def _selectors(updates: DataFrame) -> set[str]:
    """The kinds of selectors that occur: of `all`, `at`, `=` and `range`."""
    kind = F.when(F.col("how") != "test", F.col("how")).when(F.col("op") == "=", "=").otherwise("range")
    return {r.kind for r in updates.select(kind.alias("kind")).distinct().collect()}  # at most four


def _met(versions: DataFrame, updates: DataFrame, kinds: set[str]) -> DataFrame:
    """`(element, u_seq, target, data)` for each update that selects a version within its span."""
    u = updates.withColumnRenamed("seq", "u_seq")
    span = ["element", "since", "until"]
    out = []
    if "all" in kinds:
        out.append(versions.join(u.where("how = 'all'"), LIST).select(*span, "u_seq", "target", "data"))
    if "at" in kinds:
        at = u.where("how = 'at'").withColumnRenamed("at", "pos")
        out.append(versions.join(at, [*LIST, "pos"]).select(*span, "u_seq", "target", "data"))
    tests = u.where("how = 'test'")
    fields = tests.groupBy(*LIST).agg(F.collect_set("field").alias("fields"))
    facts = _facts(versions, fields)
    typed = _typed(tests)
    key = _value_key(F.col("kind"), F.col("number"), F.col("text")).alias("key")
    if "=" in kinds:
        equal = typed.where("op = '='").select(*LIST, "field", key, "u_seq", "target", "data")
        met = facts.select(*span, *LIST, "field", key).join(equal, [*LIST, "field", "key"])
        out.append(met.select(*span, "u_seq", "target", "data"))
    if "range" in kinds:
        ranges = typed.where("op <> '='")
        binned = cut_wide(facts.withColumn("bin", _bin(F.col("kind"), F.col("number"), F.col("text"))))
        place = [*LIST, "field", "kind"]
        bins = binned.select(*place, "bin").distinct()
        r = ranges.select(*place, "op", F.col("number").alias("c_number"), F.col("text").alias("c_text"), F.col("bin").alias("c_bin"), "u_seq", "target", "data")
        covers = (
            F.when(F.col("op").isin(">", ">="), F.col("bin") >= F.col("c_bin"))
            .when(F.col("op").isin("<", "<="), F.col("bin") <= F.col("c_bin"))
            .otherwise(True)
        )
        ranged = bins.join(r, place).where(covers)

        def holds(x: Column, c: Column) -> Column:
            return (
                F.when(F.col("op") == ">", x > c)
                .when(F.col("op") == ">=", x >= c)
                .when(F.col("op") == "<", x < c)
                .when(F.col("op") == "<=", x <= c)
                .otherwise(x != c)
            )

        met = binned.join(ranged, [*place, "bin"]).where(
            F.when(F.col("kind") == "n", holds(F.col("number"), F.col("c_number"))).otherwise(holds(F.col("text"), F.col("c_text")))
        )
        out.append(met.select(*span, "u_seq", "target", "data"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    inside = (F.col("u_seq") > F.col("since")) & F.coalesce(F.col("u_seq") < F.col("until"), F.lit(True))
    return every.where(inside).select("element", "u_seq", "target", "data")


def _from_the_end(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates with negative positions turned into positions, by the length of the list at their time.

    Lengths are counted per segment of `seq` first, so a long list is no single task.
    """
    back = updates.where("at < 0")
    if back.isEmpty():
        return updates
    lists = back.select(*LIST).distinct()
    marks = (
        elements.join(lists, LIST, "left_semi")
        .select(*LIST, "seq", F.lit(1).alias("n"))
        .unionByName(back.select(*LIST, "seq", F.lit(0).alias("n")))
        .withColumn("segment", F.floor(F.col("seq") / SEGMENT))
    )
    along = Window.partitionBy(*LIST).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marks.groupBy(*LIST, "segment").agg(F.sum("n").alias("s")).withColumn("offset", F.coalesce(F.sum("s").over(along), F.lit(0)))
    )
    within = Window.partitionBy(*LIST, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lengths = (
        marks.withColumn("k", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .where("n = 0")
        .join(offsets.select(*LIST, "segment", "offset"), [*LIST, "segment"])
        .select(*LIST, "seq", (F.col("k") + F.col("offset")).alias("length"))
    )
    told = back.join(lengths, [*LIST, "seq"]).withColumn("at", F.col("at") + F.col("length")).where("at >= 0")
    return updates.where("at IS NULL OR at >= 0").unionByName(told.select(updates.columns))


def _shrunk(elements: DataFrame, updates: DataFrame, moving: DataFrame) -> DataFrame:
    """Without updates that a later one of the same selector and target always overwrites.

    That holds for lists in which no value can be a list that grows and no update
    changes what others select or writes at two depths; of the others every update counts.
    """
    nested = F.col("data").contains("[") | (F.size("target") != 1)
    keep_all = (
        updates.where(nested)
        .select(*LIST)
        .unionByName(moving.select(*LIST))
        .unionByName(elements.where(F.col("value").contains("[")).select(*LIST))
        .distinct()
    )
    same = [*LIST, "how", "field", "op", "literal", "at", "target"]
    last = (
        updates.join(keep_all, LIST, "left_anti")
        .groupBy(*same)
        .agg(F.max(F.struct("seq", "data")).alias("u"))
        .select("u.seq", *same, "u.data")
    )
    return updates.join(keep_all, LIST, "left_semi").unionByName(last.select(updates.columns))


def replay_lists(elements: DataFrame, updates: DataFrame) -> DataFrame:
    """Fold rows with `updates` (see `element_edits`) applied in order of `seq`.

    An update reaches the elements that were in the list before it and that it selects
    at that time.
    """
    identity = ["db_id", "path", "seq", "idx"]
    listed = cut_wide(elements.where("in_list"))
    updates = cut_wide(_from_the_end(listed, cut_wide(updates)))
    fields = updates.where("how = 'test'").select(*LIST, F.col("field").alias("_field")).distinct()
    # moves: what may change a field that is selected by, or the whole element
    u, f = updates.alias("u"), fields.alias("f")
    same_list = (F.col("u.db_id") == F.col("f.db_id")) & (F.col("u.path") == F.col("f.path"))
    touches = (F.size("u.target") == 0) | (F.get("u.target", F.lit(0)) == F.col("f._field"))
    moving = cut_wide(u.join(f, same_list & touches, "left_semi"))
    still = u.join(f, same_list & touches, "left_anti")
    still = cut_wide(_shrunk(listed, still, moving))
    most = updates.agg(F.max(F.size("target"))).first()[0] or 0

    one = F.struct(*identity).alias("element")
    open_ = cut_wide(listed.select(one, *LIST, "pos", "value", F.col("seq").alias("since")))
    no_end = F.lit(None).cast("bigint").alias("until")
    kinds, versions, hits = _selectors(moving), None, None
    while kinds:
        first = (
            _met(open_.select("*", no_end), moving, kinds)
            .groupBy("element")
            .agg(F.min(F.struct("u_seq", "target", "data")).alias("u"))
        )
        first = cut_wide(first)
        span = open_.join(first.select("element", F.col("u.u_seq").alias("until")), "element", "left")
        versions = span if versions is None else versions.unionByName(span)
        if first.isEmpty():
            break
        taken = first.select("element", "u.u_seq", "u.target", "u.data")
        hits = taken if hits is None else hits.unionByName(taken)
        new = _put(F.col("value"), F.col("target"), F.col("data"), 0, most)
        open_ = cut_wide(open_.drop("since").join(taken, "element").select("element", *LIST, "pos", new.alias("value"), F.col("u_seq").alias("since")))
    versions = open_.select("*", no_end) if versions is None else cut_wide(versions)
    if kinds := _selectors(still):
        reached = _met(versions, still, kinds)
        hits = reached if hits is None else hits.unionByName(reached)
    if hits is None:
        return elements
    changes = hits.groupBy("element").agg(F.array_sort(F.collect_list(F.struct("u_seq", "target", "data"))).alias("hits"))
    value = F.aggregate("hits", F.col("value"), lambda acc, h: _put(acc, h["target"], h["data"], 0, most))
    out = elements.join(changes.select("element.*", "hits").hint("merge"), identity, "left")
    return out.select(
        "db_id",
        "path",
        "pos",
        "seq",
        "idx",
        F.when(F.col("in_list") & F.col("hits").isNotNull(), value).otherwise(F.col("value")).alias("value"),
        "in_list",
    )
