"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of the whole by its weight; a document is then taken
`target / size of its source` times. The whole part of that number is plain
repetition. Its fraction is rounded by the pivotal method: two documents of
similar size pass their fractions between them at random, so that one of them
becomes 0 or 1 and the other keeps the rest. The sum of the fractions never
changes, so the words taken stay close to the target, which independent draws
would not do.

Pairs are fought out in a tree: small groups of one source and size class
leave one open document each, these meet in larger groups, then across size
classes, until one document of each source is open. A group never holds more
than about `GROUP` units, whatever a source holds.

Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables, text

GROUP = 64
CLASSES = 4  # size classes per doubling
JOINT = 8  # size classes that meet in one group

UNIT = "struct<cls:int,h:bigint,doc_id:bigint,size:bigint,m:bigint,base:bigint,p:double>"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, NULL last, take the weights in turn. A target
    stops at `most` times its source; what is cut off is shared again by weight
    among the others until no target is above. An empty total gives targets 0.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = tables.written(
        tables.ranked(sizes, "source").select(
            "source", "source_size", weight.alias("w"), (F.col("source_size") * most).cast("double").alias("top")
        )
    )
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # the level only rises, and each round fills a source or ends
        above = F.col("w") * level >= F.col("top")
        seen = weighed.agg(
            F.sum(F.when(above, F.col("top")).otherwise(0.0)),
            F.sum(F.when(above, 0.0).otherwise(F.col("w"))),
            F.count(F.when(above, 1)),
        ).first()
        if seen[2] == full or not seen[1]:
            break
        full, level = seen[2], (total - (seen[0] or 0.0)) / seen[1]
    return weighed.select("source", "source_size", F.least("top", F.col("w") * level).alias("target"))


def _uniform(*columns: str) -> str:
    return f"(pmod(xxhash64({', '.join(columns)}), 9007199254740992L) / 9007199254740992D)"


def _fight(level: int) -> str:
    """Sequential pivots over one sorted group: `cur` stays open, `done` holds (unit, extra)."""
    made = "named_struct('cls', {0}.cls, 'h', {0}.h, 'doc_id', {0}.doc_id, 'size', {0}.size, 'm', {0}.m, 'base', {0}.base, 'p', {1})"
    cur, s = "acc.cur", "(acc.cur.p + x.p)"
    chance = _uniform("acc.cur.h", "x.h", "acc.cur.doc_id", "x.doc_id", f"{level}L")
    first = f"({chance} < CASE WHEN {s} < 1D THEN acc.cur.p / greatest({s}, 1e-300D) ELSE (1D - x.p) / (2D - {s}) END)"
    # below 1 the winner takes both fractions and the loser gets 0; else the winner gets 1 and the loser the rest
    stays = f"CASE WHEN {first} = ({s} < 1D) THEN {made.format('acc.cur', f'CASE WHEN {s} < 1D THEN {s} ELSE {s} - 1D END')} ELSE {made.format('x', f'CASE WHEN {s} < 1D THEN {s} ELSE {s} - 1D END')} END"
    ends = f"CASE WHEN {first} = ({s} < 1D) THEN {made.format('x', f'CAST({s} >= 1D AS double)')} ELSE {made.format('acc.cur', f'CAST({s} >= 1D AS double)')} END"
    step = f"IF({cur} IS NULL, named_struct('cur', x, 'done', acc.done), named_struct('cur', {stays}, 'done', concat(acc.done, array({ends}))))"
    return (
        f"aggregate(units, named_struct('cur', CAST(NULL AS {UNIT}), 'done', CAST(array() AS array<{UNIT}>)), "
        f"(acc, x) -> {step})"
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per row of `docs` (doc_id, source, size).

    Rows that agree in all three columns count as one unit of several rows, so
    repeated rows never gather in a group. Empty documents take no part in the
    rounding. Results depend on the rows alone, not on their order or placing.
    """
    units = tables.written(
        docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))
    )
    per_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    aims = tables.written(targets(per_source, weights, most))
    cls = F.floor(F.log2(F.col("size") + 1.0) * CLASSES).cast("int")
    classed = units.withColumn("cls", cls)
    groups = classed.groupBy("source", "cls").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    a = aims.withColumnRenamed("source", "aim_source")
    per_class = groups.join(a, F.col("source").eqNullSafe(F.col("aim_source"))).drop("aim_source")
    c = per_class.select(
        F.col("source").alias("c_source"), F.col("cls").alias("c_cls"), "groups", "source_size", "target"
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.col("m") * (F.col("rate") - F.floor("rate"))
    near = F.round(share)
    whole = F.when(F.abs(share - near) < 1e-9, near).otherwise(F.floor(share))
    start = tables.written(
        classed.join(c, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cls") == F.col("c_cls")))
        .withColumn("rate", rate)
        .select(
            "source",
            "source_size",
            "target",
            F.floor("rate").alias("whole"),
            "groups",
            "cls",
            F.xxhash64("doc_id", "size", F.lit(11)).alias("h"),
            "doc_id",
            "size",
            "m",
            F.when(F.col("size") > 0, whole).otherwise(0).cast("bigint").alias("base"),
            F.when(F.col("size") > 0, F.greatest(share - whole, F.lit(0.0))).otherwise(0.0).alias("p"),
        )
    )
    keys = ("source", "source_size", "target", "whole")
    unit = F.struct("cls", "h", "doc_id", "size", "m", "base", "p")
    settled = [start.where("p < 1e-9").select(*keys, F.col("doc_id"), "size", "m", "base", F.lit(0).alias("extra"))]
    g = F.pmod(F.xxhash64("h", F.lit(5)), F.col("groups")).alias("g")
    open_ = start.where("p >= 1e-9").select(*keys, F.col("cls").alias("k"), g, unit.alias("u"))
    most_groups = groups.agg(F.max("groups")).first()[0] or 1
    levels = 1
    while most_groups > 1:
        levels, most_groups = levels + 1, -(-most_groups // GROUP)
    for level in range(levels + 2):
        if level >= levels:  # first neighbouring size classes meet, then all of a source
            k = F.floor(F.col("k") / JOINT).cast("int") if level == levels else F.lit(0)
            open_ = open_.withColumn("k", k).withColumn("g", F.lit(0))
        elif level:
            open_ = open_.withColumn("g", F.floor(F.col("g") / GROUP))
        fought = tables.written(
            open_.groupBy(*keys, "k", "g")
            .agg(F.sort_array(F.collect_list("u")).alias("units"))
            .select(*keys, "k", "g", F.expr(_fight(level)).alias("r"))
        )
        settled.append(
            fought.select(*keys, F.explode("r.done").alias("u")).select(
                *keys, "u.doc_id", "u.size", "u.m", "u.base", F.col("u.p").cast("int").alias("extra")
            )
        )
        open_ = fought.select(*keys, "k", "g", F.col("r.cur").alias("u"))
    last = F.expr(_uniform("u.h", "u.doc_id", "97L")) < F.col("u.p")
    settled.append(open_.select(*keys, "u.doc_id", "u.size", "u.m", "u.base", last.cast("int").alias("extra")))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return (
        out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("m"))))
        .withColumn("copies", F.col("whole") + (F.col("i") <= F.col("base") + F.col("extra")).cast("int"))
        .select("doc_id", "source", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Copies of whole documents (doc_id, source, text): size in words, NULL text 0."""
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", text.n_words(F.col("text")).alias("size"))
    return copies(sized, weights, most)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, all its columns kept.

    Rows are told apart by a number given when the table is written, so equal
    and unnumbered documents need no key of their own.
    """
    row, times = tables.fresh(docs, "_row"), tables.fresh(docs, "_copies")
    numbered = tables.written(docs.withColumn(row, F.monotonically_increasing_id()))
    sized = numbered.select(F.col(row).alias("doc_id"), "source", text.n_words(F.col("text")).alias("size"))
    taken = copies(sized, weights, most).where("copies > 0")
    taken = taken.select(F.col("doc_id").alias(row), F.col("copies").cast("int").alias(times))
    return (
        numbered.join(taken, row)
        .withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times))))
        .select(*docs.columns)
    )
