"""The edit fold: a log of path edits to the current values of many documents.

Log: `(db_id, seq, path, data)`, `data` being JSON text and `(db_id, seq)`
unique. For one path, in `seq` order: once the value is a list it stays a list
and later edits add to it (a list element by element, anything else as one
element); before that each edit replaces the value. Writing an object below or
above another edited path interacts with it; see `settle`.

Nothing here walks one owner's log in one task. The unit of work is a
*segment*: the edits of one `(db_id, path)` whose `seq` falls into one window
of `SEGMENT` numbers. As `(db_id, seq)` is unique a segment holds at most
`SEGMENT` edits, however hot its owner or path is; everything per path is then
put together from one small row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmem.functions.jsontext import text_kind
from docmem.functions.paths import depth_of, prefixes_of
from docmem.operators.leaves import explode_leaves, rebuild
from docmem.session import cut_lineage, cut_wide

SEGMENT = 1 << 20
PAGE = 10_000
KEY = ["db_id", "path"]


def drop_na(edits: DataFrame) -> DataFrame:
    """Edits with the path `NA` say that nothing fits; they change nothing."""
    return edits.where(F.col("path") != "NA")


def spread(edits: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Log rows to write rows `(db_id, seq, path, value, kind, implied, marker)`.

    An edit holding a non-empty object becomes a *marker* at its path, which
    says that the subtree was replaced, and one *implied* write per leaf of the
    object (lists stay whole). Every other edit is one write as it is. Only the
    edits with objects are taken apart.
    """
    kind = text_kind("data")
    own = drop_na(edits).select(
        "db_id",
        "seq",
        "path",
        F.col("data").alias("value"),
        kind.alias("kind"),
        F.lit(False).alias("implied"),
        ((kind == "object") & ~F.col("data").rlike(r"^\s*\{\s*\}\s*$")).alias("marker"),
    )
    objects = own.where("marker").select("db_id", "seq", F.col("path").alias("top"), F.parse_json("value").alias("doc"))
    inside = explode_leaves(objects, enter_lists=False, max_depth=max_depth, root=F.col("top"))
    implied = inside.select("db_id", "seq", "path", F.to_json("v").alias("value")).select(
        "*", text_kind("value").alias("kind"), F.lit(True).alias("implied"), F.lit(False).alias("marker")
    )
    return own.unionByName(implied)


def path_pairs(writes: DataFrame) -> DataFrame:
    """`(db_id, path, above)`: written paths with each written proper ancestor."""
    paths = writes.select(*KEY).distinct()
    up = paths.select(*KEY, F.explode(prefixes_of("path")).alias("above"))
    written = paths.select("db_id", F.col("path").alias("above"))
    return up.join(written, ["db_id", "above"], "left_semi")


def _survives(seq: Column, implied: Column, reset: Column, open_: Column) -> Column:
    """Does a write outlive the last replacement of an ancestor?

    A leaf of an object counts iff that very object is the last replacement. An
    edit of its own counts iff it came later and every ancestor is an object:
    below a scalar or a list there is no place to write to.
    """
    own = (seq > F.coalesce(reset, F.lit(-(1 << 62)))) & F.coalesce(open_, F.lit(True))
    return F.when(implied, seq == reset).otherwise(own)


def settle(writes: DataFrame) -> DataFrame:
    """Drop the writes that ancestor replacements made void.

    Only paths that were written *and* have written descendants matter
    (`inner`, few next to the log). They are settled from the top down, one
    round per nesting level: the last replacement of a path needs only the
    state of the paths above it. A round joins by `(db_id, path, segment)` and
    aggregates, so a hot owner or path is split. Without nested paths there
    are no rounds and the log passes unchanged.
    """
    pairs = path_pairs(writes)
    inner = cut_lineage(
        pairs.select("db_id", F.col("above").alias("path")).distinct().withColumn("depth", depth_of("path"))
    )
    deepest = inner.agg(F.max("depth")).first()[0]
    if deepest is None:
        return writes
    inner_pairs = pairs.join(inner, KEY, "inner")
    slim = writes.select(
        "db_id", "seq", "path", "kind", "implied", F.floor(F.col("seq") / SEGMENT).alias("segment")
    ).join(inner.select(*KEY, "depth"), KEY, "inner")
    slim = cut_lineage(slim)
    state = None
    for depth in range(1, deepest + 1):
        here = slim.where(F.col("depth") == depth)
        units = here.select(*KEY, "segment").distinct()
        if state is None:
            units = units.select(
                "*", F.lit(None).cast("bigint").alias("reset"), F.lit(None).cast("boolean").alias("open")
            )
        else:
            above = _gate(inner_pairs.where(F.col("depth") == depth), state)
            units = units.join(above, KEY, "left")
        alive = here.join(units, [*KEY, "segment"]).where(
            _survives(F.col("seq"), F.col("implied"), F.col("reset"), F.col("open"))
        )
        per_segment = alive.groupBy(*KEY, "segment").agg(
            F.min(F.when(F.col("kind") == "list", F.col("seq"))).alias("first_list"),
            F.max("seq").alias("last"),
            F.max_by(F.col("kind") == "object", "seq").alias("last_object"),
        )
        level = (
            per_segment.groupBy(*KEY)
            .agg(
                F.min("first_list").alias("first_list"),
                F.max("last").alias("last"),
                F.max_by("last_object", "last").alias("last_object"),
            )
            .select(
                *KEY,
                F.coalesce("first_list", "last").alias("replaced"),
                (F.col("first_list").isNull() & F.col("last_object")).alias("is_object"),
            )
        )
        state = cut_lineage(level if state is None else state.unionByName(level))
    # a gate row counts only where its path has a written ancestor
    gate = _gate(pairs, state)
    units = (
        writes.select(*KEY, F.floor(F.col("seq") / SEGMENT).alias("segment"))
        .distinct()
        .join(gate, KEY, "inner")
    )
    return (
        writes.withColumn("segment", F.floor(F.col("seq") / SEGMENT))
        .join(units, [*KEY, "segment"], "left")
        .where(_survives(F.col("seq"), F.col("implied"), F.col("reset"), F.col("open")))
        .drop("segment", "reset", "open")
    )


def _gate(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Per path: when an ancestor was last replaced, and whether all are objects."""
    above = state.select("db_id", F.col("path").alias("above"), "replaced", "is_object")
    return (
        pairs.join(above, ["db_id", "above"], "inner")
        .groupBy(*KEY)
        .agg(F.max("replaced").alias("reset"), F.min("is_object").alias("open"))
    )


def fold_writes(writes: DataFrame, *, positions: bool = True) -> DataFrame:
    """Settled writes to current values: `(db_id, path, pos, seq, idx, value, in_list)`.

    A plain value has `pos` NULL. A list gives one row per element, numbered
    from 0 in `pos` (`positions=False` leaves that out; `(seq, idx)` orders
    them too). A list that is still empty gives one row `[]` with `pos` NULL.

    The log is read once to summarise its segments, and once more for the rows
    of lists if there are any. Everything else works on the summary, which is
    written out: it has one row per path and segment.
    """
    w = writes.withColumn("segment", F.floor(F.col("seq") / SEGMENT)).withColumn(
        "n", F.when(F.col("kind") == "list", F.json_array_length("value")).otherwise(1)
    )
    w = w.hint("merge")  # the log is never broadcast, however small its files are
    summary = cut_wide(
        w.groupBy(*KEY, "segment").agg(
            F.min(F.when(F.col("kind") == "list", F.col("seq"))).alias("first_list"),
            F.max("seq").alias("last"),
            F.max(F.when(F.col("n") > 0, F.col("seq"))).alias("last_full"),
            F.sum("n").alias("n_segment"),
            F.max_by(F.when(~F.col("marker"), F.col("value")), "seq").alias("value"),
        )
    )
    per_path = summary.groupBy(*KEY).agg(
        F.min("first_list").alias("start"),
        F.max("last").alias("last"),
        F.max("last_full").alias("last_full"),
        F.max_by("value", "last").alias("value"),
    )
    no_pos = F.lit(None).cast("bigint").alias("pos")
    still_empty = F.coalesce(F.col("last_full") < F.col("start"), F.col("start").isNotNull())
    plain = per_path.where((F.col("start").isNull() & F.col("value").isNotNull()) | still_empty).select(
        *KEY,
        no_pos,
        F.col("last").alias("seq"),
        F.lit(0).alias("idx"),
        F.when(F.col("start").isNull(), F.col("value")).otherwise("[]").alias("value"),
        F.lit(False).alias("in_list"),
    )
    if summary.where("first_list IS NOT NULL").isEmpty():
        return plain

    starts = summary.groupBy(*KEY).agg(F.min("first_list").alias("start")).where("start IS NOT NULL")
    segments = (
        summary.select(*KEY, "segment", "last", "n_segment").join(starts, KEY).where(F.col("last") >= F.col("start"))
    )
    adds = (
        w.select(*KEY, "segment", "seq", "kind", "value", "n")
        .join(_offsets(w, segments) if positions else segments.select(*KEY, "segment", "start"), [*KEY, "segment"])
        .where(F.col("seq") >= F.col("start"))
    )
    if positions:
        before = (
            Window.partitionBy(*KEY, "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        )
        adds = adds.withColumn("base", F.col("offset") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    else:
        adds = adds.withColumn("base", F.lit(None).cast("bigint"))
    items = F.when(
        F.col("kind") == "list",
        F.transform(F.parse_json("value").cast("array<variant>"), lambda x: F.to_json(x)),
    ).otherwise(F.array("value"))
    elements = adds.select(*KEY, "base", "seq", F.posexplode(items).alias("idx", "value")).select(
        *KEY, (F.col("base") + F.col("idx")).alias("pos"), "seq", "idx", "value", F.lit(True).alias("in_list")
    )
    return plain.unionByName(elements)


def _offsets(w: DataFrame, segments: DataFrame) -> DataFrame:
    """List segments with the number of elements in the segments before them.

    Only lists that span several segments need any; of those the segment with
    the start is counted anew from the start on, the rest is in the summary.
    """
    spans = segments.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY)
    if spans.isEmpty():
        return segments.select(*KEY, "segment", "start", F.lit(0).cast("bigint").alias("offset"))
    first = F.col("segment") == F.floor(F.col("start") / SEGMENT)
    head = (
        w.select(*KEY, "segment", "seq", "n")
        .join(segments.where(first).join(spans, KEY, "left_semi").select(*KEY, "segment", "start"), [*KEY, "segment"])
        .where(F.col("seq") >= F.col("start"))
        .groupBy(*KEY, "segment")
        .agg(F.sum("n").alias("n_head"))
    )
    along = Window.partitionBy(*KEY).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    counted = segments.join(head, [*KEY, "segment"], "left").withColumn("n", F.coalesce("n_head", "n_segment"))
    return counted.select(
        *KEY, "segment", "start", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("offset")
    )


def compact(writes: DataFrame) -> DataFrame:
    """The write rows that still matter once no earlier edit can come any more.

    Void writes go; of a path its last write stays, or all writes from the first
    list on. Folding these with any later writes gives what folding everything
    gives: later writes look at a path's last replacement and at nothing before it.
    """
    settled = settle(writes)
    w = settled.withColumn("segment", F.floor(F.col("seq") / SEGMENT))
    summary = cut_wide(
        w.groupBy(*KEY, "segment").agg(
            F.min(F.when(F.col("kind") == "list", F.col("seq"))).alias("first_list"), F.max("seq").alias("last")
        )
    )
    first = summary.groupBy(*KEY).agg(F.coalesce(F.min("first_list"), F.max("last")).alias("first"))
    units = summary.select(*KEY, "segment").join(first, KEY)
    return w.join(units, [*KEY, "segment"]).where(F.col("seq") >= F.col("first")).select(writes.columns)


def is_flat(edits: DataFrame) -> bool:
    """No edit holds an object and no edited path lies below another one.

    One pass with map-side combining to the distinct paths; stops at the first
    counterexample.
    """
    paths = drop_na(edits).groupBy(*KEY).agg(F.max(text_kind("data") == "object").alias("has_object"))
    objects = paths.where("has_object").select("db_id")
    return objects.unionAll(path_pairs(paths).select("db_id")).isEmpty()


def fold(
    edits: DataFrame, *, positions: bool = True, nested: bool | None = None, max_depth: int | None = None
) -> DataFrame:
    """Replay a log of edits: `(db_id, path, pos, seq, idx, value, in_list)`.

    `nested` says whether edits may hold objects or lie below one another; left
    open, a cheap pass finds out, and flat logs are folded straight away.
    `max_depth` bounds the nesting of objects inside an edit.
    """
    if nested is None:
        nested = not is_flat(edits)
    if nested:
        writes = cut_lineage(spread(edits, max_depth))
        settled = settle(writes)
        writes = settled if settled is writes else cut_lineage(settled)
    else:
        writes = drop_na(edits).select(
            "db_id",
            "seq",
            "path",
            F.col("data").alias("value"),
            F.lit(False).alias("implied"),
            F.lit(False).alias("marker"),
            text_kind("data").alias("kind"),
        )
    return fold_writes(writes, positions=positions)


def last_values(edits: DataFrame) -> DataFrame:
    """Last write per path, for logs that hold no lists."""
    return (
        drop_na(edits)
        .groupBy(*KEY)
        .agg(F.max("seq").alias("seq"), F.max_by("data", "seq").alias("value"))
    )


def base_edits(docs: DataFrame, seq: int = -1, max_depth: int | None = None) -> DataFrame:
    """Stored documents `(db_id, doc VARIANT)` as the first edits of a log.

    Objects are taken apart, lists stay whole so that later appends see them.
    Nothing precedes the base, hence no markers are needed.
    """
    return (
        explode_leaves(docs.select("db_id", "doc"), enter_lists=False, max_depth=max_depth)
        .where(F.col("path") != "$")
        .select("db_id", F.lit(seq).cast("bigint").alias("seq"), "path", F.to_json("v").alias("data"))
    )


def pages(folded: DataFrame, size: int = PAGE) -> DataFrame:
    """Fold rows to values `(db_id, path, page, value)`, lists collected by page.

    A page holds at most `size` elements; the list is its pages in order. Most
    lists are one page, a huge one never has to fit into one row.
    """
    placeless = F.raise_error(F.lit("list elements without positions: fold with positions=True")).cast("bigint")
    page = F.floor(F.when(F.col("pos").isNull(), placeless).otherwise(F.col("pos")) / size)
    lists = (
        folded.where(F.col("in_list"))
        .groupBy(*KEY, page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("e"))
        .select(
            *KEY,
            "page",
            F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["value"]), ",", "null"), F.lit("]")).alias(
                "value"
            ),
        )
    )
    plain = folded.where(~F.col("in_list")).select(*KEY, F.lit(0).cast("bigint").alias("page"), "value")
    return lists.unionByName(plain)


def documents(
    folded: DataFrame, size: int = PAGE, paths_per_part: int = 4096, max_depth: int | None = None
) -> DataFrame:
    """Fold rows to documents `(db_id, part, page, doc)`, `doc` as JSON text.

    The document of an owner is the merge of its rows: objects by key, lists by
    concatenation in page order. Owners with at most `paths_per_part` paths and
    lists of at most `size` elements, nearly all, are one row. Larger ones are
    split by path hash and list page, so no group grows with the owner.
    """
    folded = cut_lineage(folded)  # read three times below
    values = pages(folded, size)
    one_per_path = folded.where(F.coalesce(F.col("pos"), F.lit(0)) == 0)
    parts = one_per_path.groupBy("db_id").agg(F.ceil(F.count("*") / paths_per_part).alias("n_parts"))
    wide = parts.where("n_parts > 1")
    rows = values.join(wide, "db_id", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("path"), F.col("n_parts")), F.lit(0))
    )
    return rebuild(rows, ["db_id", "part", "page"], max_depth)


__all__ = [
    "base_edits",
    "compact",
    "documents",
    "drop_na",
    "fold",
    "fold_writes",
    "is_flat",
    "last_values",
    "pages",
    "path_pairs",
    "settle",
    "spread",
]
