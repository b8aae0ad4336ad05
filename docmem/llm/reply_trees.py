"""Chat formatting of reply trees.

Messages that answer each other form trees. Self-joins by powers of two find, for
every message, its 2nd, 4th, 8th ... ancestor; leaves climb to their root over these
jumps, which gives depth and score of each branch in a logarithm of the depth many
joins. Branches are ranked by score within their tree, and only the chosen ones are
laid out as rows, again by jumps: each join doubles what is known of a path. Their
texts are then fetched, marked and put together.

Only DataFrame and SQL functions are used.

Defined cases. A parent that is not in the tree, or NULL, makes a message a root.
Repeated ids count as one message (smallest parent and score, smallest role and
text). NULL ids and NULL trees are ids and trees like others, but nothing replies to
a NULL id. A NULL score counts 0, a NULL role or text is empty. Messages on or below
a cycle have no root and no path; `rootless` gives them. Of equally good branches the
smaller leaf id comes first. No messages: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

# Marks of the template: how a turn of a role begins and ends.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")  # any other role is written out

_CONTROL = r"(/?(?:s>|INST\]|SYS\]|ROLE\]|TURN\]))"
_TURN = (
    r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|\[SYS\].*?\[/SYS\]|\[ROLE\].*?\[/ROLE\].*?\[/TURN\]"
)
SALTS = 1024


def escaped(text: Column) -> Column:
    r"""A text without control strings: each gets one more backslash after its first character.

    `[INST]` becomes `[\INST]`, which becomes `[\\INST]`, so `unescaped` gives every text back.
    """
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, "$1$2$3")


def _parts(links: DataFrame) -> DataFrame:
    """`(node, parent, score)`, one row per id of a tree; `node` is a struct, equal to another even where NULL."""
    return (
        links.groupBy(F.struct(F.col("tree"), F.col("id")).alias("node"))
        .agg(F.min(F.struct(F.col("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
        .select("node", F.col("m.parent").alias("parent"), F.col("m.score").alias("score"))
    )


def jumps(parts: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Tables `(node, up, above)`: the 2^k-th ancestor for k = 0, 1, ..., and the sum of scores up to it.

    A message with fewer ancestors has no row, so most tables are small. The second
    result holds the messages that still have an ancestor after more steps than there
    are messages: those of cycles.
    """
    most = parts.count()
    ups = parts.select(F.col("node").alias("up"), F.col("score").alias("above"))
    step = (
        parts.where(F.col("parent").isNotNull())
        .select("node", F.struct(F.col("node.tree").alias("tree"), F.col("parent").alias("id")).alias("up"))
        .join(ups, "up")
        .select("node", "up", "above")
    )
    found: list[DataFrame] = []
    while True:
        step = written(step)
        if step.isEmpty():
            return found, None
        if 1 << len(found) > most:
            return found, step
        found.append(step)
        on = step.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("above").alias("more"))
        step = step.join(on, "up").select("node", F.col("far").alias("up"), (F.col("above") + F.col("more")).alias("above"))


def rootless(links: DataFrame) -> DataFrame:
    """`(tree, id)` of the messages on or below a cycle."""
    _, cyclic = jumps(written(_parts(links)))
    if cyclic is None:
        return links.select("tree", "id").limit(0)
    return cyclic.select("node.tree", "node.id")


def branches(parts: DataFrame, ladder: list[DataFrame], cyclic: DataFrame | None) -> DataFrame:
    """`(leaf, depth, score)` of every leaf; the score is the mean over its path."""
    leaves = parts
    if ladder:
        leaves = leaves.join(ladder[0].select(F.col("up").alias("node")), "node", "left_anti")
    if cyclic is not None:
        leaves = leaves.join(cyclic.select("node"), "node", "left_anti")
    at = leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("depth"), "score")
    for k in reversed(range(len(ladder))):
        met = F.col("up").isNotNull()
        at = at.join(ladder[k], "node", "left").select(
            "leaf",
            F.coalesce("up", "node").alias("node"),
            (F.col("depth") + F.when(met, 1 << k).otherwise(0)).alias("depth"),
            (F.col("score") + F.coalesce("above", F.lit(0.0))).alias("score"),
        )
    return at.select("leaf", "depth", (F.col("score") / (F.col("depth") + 1)).alias("score"))


def paths(links: DataFrame, keep: int = 1) -> DataFrame:
    """`(leaf, rank, score, place, node)`: the messages of the `keep` best branches of each tree, root first.

    `links` has `tree, id, parent, score`.
    """
    parts = written(_parts(links))
    ladder, cyclic = jumps(parts)
    best = Window.partitionBy("leaf.tree").orderBy(F.desc("score"), "leaf.id")
    chosen = (
        branches(parts, ladder, cyclic)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= keep)  # limits within each task before the shuffle
    )
    rows = chosen.select("leaf", "rank", "score", F.col("leaf").alias("node"), F.col("depth").alias("place"))
    for k in reversed(range(len(ladder))):
        # a message with less than 2^k above it needs no partner: such rows, those of a much
        # answered root among them, are spread out instead of meeting at their message
        far = F.col("place") >= (1 << k)
        dead = F.lit(1) + F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int")
        step = ladder[k].select("node", "up", F.lit(0).alias("salt"))
        here = F.struct(F.col("node"), F.col("place"))
        above = F.struct(F.col("up").alias("node"), (F.col("place") - F.lit(1 << k)).alias("place"))
        rows = (
            rows.withColumn("salt", F.when(far, F.lit(0)).otherwise(dead))
            .join(step, ["node", "salt"], "left")
            .select(
                "leaf",
                "rank",
                "score",
                F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("x"),
            )
            .select("leaf", "rank", "score", "x.node", "x.place")
        )
    return rows


def _marked(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """(begin, inside, end) of a turn."""
    begin = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    end = F.lit(OTHER[2])
    for name, (b, e) in MARKS.items():
        begin = F.when(role == name, F.lit(b)).otherwise(begin)
        end = F.when(role == name, F.lit(e)).otherwise(end)
    return begin, escaped(text), end


def conversations(links: DataFrame, texts: DataFrame, keep: int = 1) -> DataFrame:
    """Each chosen branch as one conversation: `(tree, leaf, rank, score, formatted, loss)`.

    `links` has `tree, id, parent, score`, `texts` has `tree, id, role, text`. `loss`
    lists what a model is trained on, the texts of assistants, as spans of `formatted`:
    `start` and `end` in code points, `first` and `bytes` in UTF-8.
    """
    one = Window.partitionBy("node").orderBy("role", "text")
    said = (
        texts.select(
            F.struct(F.col("tree"), F.col("id")).alias("node"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .withColumn("n", F.row_number().over(one))
        .where("n = 1")
        .drop("n")
    )
    begin, inside, end = _marked(F.col("role"), F.col("text"))
    turns = (
        paths(links, keep)
        .join(said, "node")
        .select("leaf", "rank", "score", "place", "role", begin.alias("b"), inside.alias("t"), end.alias("e"))
        .withColumn("piece", F.concat("b", "t", "e"))
        .select(
            "leaf",
            "rank",
            "score",
            "place",
            "piece",
            (F.col("role") == "assistant").alias("learn"),
            F.char_length("b").cast("bigint").alias("b"),
            F.char_length("t").cast("bigint").alias("t"),
            F.octet_length("b").cast("bigint").alias("bb"),
            F.octet_length("t").cast("bigint").alias("tb"),
        )
    )
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.withColumn("c0", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0))).withColumn(
        "b0", F.coalesce(F.sum(F.octet_length("piece")).over(before), F.lit(0))
    )
    span = F.struct(
        (F.col("c0") + F.col("b")).alias("start"),
        (F.col("c0") + F.col("b") + F.col("t")).alias("end"),
        (F.col("b0") + F.col("bb")).alias("first"),
        F.col("tb").alias("bytes"),
    )
    together = sums.groupBy("leaf", "rank", "score").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("turns"),
        F.array_sort(F.collect_list(F.when(F.col("learn"), span))).alias("loss"),
    )
    return together.select(
        F.col("leaf.tree").alias("tree"),
        F.col("leaf.id").alias("leaf"),
        "rank",
        "score",
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        "loss",
    )


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted conversation, `array<struct<role, text>>`."""

    def turn(t: Column) -> Column:
        role = unescaped(F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[/ROLE\](.*)\[/TURN\]$", 1))
        text = F.regexp_extract(t, r"(?s)^\[ROLE\](.*?)\[/ROLE\](.*)\[/TURN\]$", 2)
        for name, (b, e) in MARKS.items():
            mine = t.startswith(b)
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, F.substring(t, F.lit(len(b) + 1), F.char_length(t) - len(b) - len(e))).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    raw = formatted.cast("binary")
    # SUBSTRING of binary goes by bytes, so a span costs its own length
    return F.transform(
        loss,
        lambda x: unescaped(
            F.decode(F.substring(raw, (x["first"] + 1).cast("int"), x["bytes"].cast("int")), "UTF-8")
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader of `conversations` gets: turns, and text under the mask."""
    read = formatted.select("tree", "formatted", turns_of(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("learned"))
    told = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return read.select(
        "tree",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join("learned", "")).cast("bigint").alias("loss_chars"),
        F.sha2(F.array_join("learned", ""), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
