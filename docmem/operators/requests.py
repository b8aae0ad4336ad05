"""Read requests of many owners, answered together.

A request is a list of paths as text. SQL functions cut each path into steps, and a
document carries all paths asked of it through one walk: where paths go on alike they
share the way (a trie in suffixes: rows hold what is left of each path), and each
level of the walk takes every row one step further, whatever kind of step that is. The
walk is a chain of `explode` inside one stage; the one shuffle brings requests and
documents together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmem.functions.jsontext import let, variant_text
from docmem.functions.paths import READ_PATH, normalise_quotes
from docmem.operators.leaves import document_depth, is_container, list_items, object_entries

PATHS_PER_WALK = 256  # an owner who asks for more is answered in several walks

# Fixed patterns of the path text: one step, and the parts of each kind of step.
STEP = (
    r'\.\.?[A-Za-z_][A-Za-z0-9_-]*|\.`[^`]+`|\["[^"]+"\]|\[\?[^"\]]*(?:"[^"]*")?[^"\]]*\]|\[[^"\]?]*\]'
)
TEST = r'^\[\?\(?\s*(?:@\.)?([A-Za-z_][A-Za-z0-9_.]*)\s*(==?|!=|<=?|>=?|=~)\s*("[^"]*"|-?\d+(?:\.\d+)?)\s*\)?\]$'
SLICE = r"^\[(-?\d*):(-?\d*)\]$"
SUB = r"^\.`sub\(/((?:[^/\\]|\\.)*)/,\s*((?:[^)\\]|\\.)*)\)`$"
SPLIT = r"^\.`split\(\s*(.+?)\s*,\s*(-?\d+)\s*,\s*(-?\d+)\s*\)`$"


def _key_path(name: Column) -> Column:
    """`a.b` as the place `$["a"]["b"]`."""
    return F.concat(F.lit('$["'), F.replace(name, F.lit("."), F.lit('"]["')), F.lit('"]'))


def parsed(step: Column) -> Column:
    """What a step does, as a struct of plain values; equal steps give equal structs."""
    number = lambda s: F.when(s != "", s.cast("int"))
    part = lambda pattern, i: F.regexp_extract(step, pattern, i)
    quoted = step.startswith('["')
    kind = (
        F.when(step.startswith(".."), "below")
        .when(step.startswith(".`"), F.regexp_extract(step, r"^\.`([a-z]+)", 1))
        .when(step.startswith(".") | quoted, "field")
        .when(step == "[*]", "each")
        .when(step.startswith("[?"), "where")
        .when(step.rlike(SLICE), "slice")
        .when(step.rlike(r"^\[-?\d+\]$"), "index")
        .otherwise("order")
    )
    keys = F.transform(
        F.regexp_extract_all(step, F.lit(r"[\\/][A-Za-z_][A-Za-z0-9_]*"), F.lit(0)),
        lambda k: F.struct(F.substring(k, 2, 1 << 20).alias("name"), k.startswith("\\").alias("down")),
    )
    literal = part(TEST, 3)
    text = literal.startswith('"')
    name = (
        F.when(kind == "where", _key_path(part(TEST, 1)))
        .when(quoted, F.substring(step, 3, 1 << 20).substr(F.lit(1), F.length(step) - 4))
        .when(kind == "below", F.substring(step, 3, 1 << 20))
        .when(kind == "field", F.substring(step, 2, 1 << 20))
        .when(kind == "sub", part(SUB, 1))
        .when(kind == "split", part(SPLIT, 1))
    )
    # a pattern that is none matches nothing; found out here, once per path
    pattern = F.when(part(TEST, 2) == "=~", F.substring(literal, 2, 1 << 20).substr(F.lit(1), F.length(literal) - 2)).when(kind == "sub", name)
    broken = pattern.isNotNull() & F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNull()
    return F.struct(
        F.when(broken, "never").otherwise(kind).alias("kind"),
        name.alias("name"),
        F.when(kind == "where", part(TEST, 2)).alias("op"),
        F.when((kind == "where") & text, literal.substr(F.lit(2), F.length(literal) - 2))
        .when(kind == "where", literal)
        .when(kind == "sub", F.regexp_replace(part(SUB, 2), r"\\(\d)", r"\$$1"))
        .alias("literal"),
        F.when(kind == "where", text).alias("text"),
        number(F.when(kind == "slice", part(SLICE, 1)).when(kind == "index", F.regexp_extract(step, r"-?\d+", 0)).when(kind == "split", part(SPLIT, 2)).otherwise("")).alias("lo"),
        number(F.when(kind == "slice", part(SLICE, 2)).when(kind == "split", part(SPLIT, 3)).otherwise("")).alias("hi"),
        F.when(kind == "order", keys).alias("keys"),
    )


def steps(path: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalise_quotes(path), F.lit(STEP), F.lit(0)), parsed)


_NUMBER = "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def _passes(x: Column, s: Column) -> Column:
    """Does a list element pass the test of a step? A field of another type never does."""

    def test(a: Column, b: Column) -> Column:
        return (
            F.when(s["op"].isin("=", "=="), a == b)
            .when(s["op"] == "!=", a != b)
            .when(s["op"] == "<", a < b)
            .when(s["op"] == "<=", a <= b)
            .when(s["op"] == ">", a > b)
            .when(s["op"] == ">=", a >= b)
        )

    def ok(found: Column) -> Column:
        kind = F.schema_of_variant(found)
        text = F.when(s["text"] & (kind == "STRING"), F.try_variant_get(found, "$", "string"))
        number = F.when(~s["text"] & kind.rlike(_NUMBER), F.try_variant_get(found, "$", "double"))
        return (
            F.when(s["op"] == "=~", F.regexp_like(text, s["literal"]))
            .when(s["text"], test(text, s["literal"]))
            .otherwise(test(number, F.when(~s["text"], s["literal"].cast("double"))))
        )

    return F.coalesce(let(F.try_variant_get(x, s["name"], "variant"), ok), F.lit(False))


def _sorted(items: Column, s: Column) -> Column:
    """A list in the order of the step's keys; numbers before text, elements without a key last."""

    def keyed(x: Column) -> Column:
        def one(k: Column) -> Column:
            told = lambda v: F.struct(
                F.try_variant_get(v, "$", "double").alias("n"), F.try_variant_get(v, "$", "string").alias("t"), k["down"].alias("down")
            )
            return let(F.try_variant_get(x, F.concat(F.lit('$["'), k["name"], F.lit('"]')), "variant"), told)

        return F.transform(s["keys"], one)

    def compare(a: Column, b: Column) -> Column:
        def one(pair: Column) -> Column:
            x, y = pair["x"], pair["y"]
            up = (
                F.when(x["n"].isNotNull() & y["n"].isNotNull(), F.signum(x["n"] - y["n"]).cast("int"))
                .when(x["n"].isNotNull(), -1)
                .when(y["n"].isNotNull(), 1)
                .when(x["t"] < y["t"], -1)
                .when(x["t"] > y["t"], 1)
                .otherwise(0)
            )
            missing = x["t"].isNull().cast("int") - y["t"].isNull().cast("int")
            return F.when(missing != 0, missing).otherwise(F.when(x["down"], -up).otherwise(up))

        pairs = F.zip_with(a["k"], b["k"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        first = F.aggregate(pairs, F.lit(0), lambda acc, p: F.when(acc != 0, acc).otherwise(one(p)))
        return F.when(first != 0, first).otherwise(a["i"] - b["i"])

    order = F.array_sort(F.transform(items, lambda x, i: F.struct(keyed(x).alias("k"), i.alias("i"))), compare)
    return F.transform(order, lambda o: F.get(items, o["i"]))


def _children(ord_: Column, v: Column, items: Column, entries: Column, s: Column) -> Column:
    """`array<struct<ord, v, again>>`: the matches of a step at a place, `again` where the step goes on below.

    `items` and `entries` are those of `v`, opened before, as they are looked at often.
    """
    here = lambda x, again=False: F.struct(ord_.alias("ord"), x.alias("v"), F.lit(again).alias("again"))
    at = lambda i, x, again=False: F.struct(F.concat(ord_, F.array(i)).alias("ord"), x.alias("v"), F.lit(again).alias("again"))
    one = lambda x: F.filter(F.array(here(x)), lambda m: m["v"].isNotNull())
    many = lambda xs: F.transform(xs, lambda x, i: at(i, x))
    text = F.when(F.schema_of_variant(v) == "STRING", variant_text(v))

    n = F.size(items)
    bound = lambda b, none: F.when(b.isNull(), none).when(b < 0, F.greatest(n + b, F.lit(0))).otherwise(F.least(b, n))
    start = bound(s["lo"], F.lit(0))
    hit = F.transform(F.filter(entries, lambda e: e["key"] == s["name"]), lambda e: at(F.lit(-1), e["value"]))
    below = F.concat(
        F.coalesce(hit, F.array()),
        F.coalesce(F.filter(F.transform(entries, lambda e, i: at(i, e["value"], True)), lambda m: is_container(m["v"])), F.array()),
        F.coalesce(F.filter(F.transform(items, lambda x, i: at(i, x, True)), lambda m: is_container(m["v"])), F.array()),
    )
    length = F.coalesce(F.array_size(items), F.array_size(entries), F.length(text)).cast("variant")
    pieces = F.split(text, F.concat(F.lit(r"\Q"), s["name"], F.lit(r"\E")), F.when(s["hi"] < 0, F.lit(-1)).otherwise(s["hi"] + 1))
    keys = F.to_variant_object(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    found = (
        F.when(s["kind"] == "field", one(F.try_variant_get(v, F.concat(F.lit('$["'), s["name"], F.lit('"]')), "variant")))
        .when(s["kind"] == "each", many(items))
        .when(s["kind"] == "where", many(F.filter(items, lambda x: _passes(x, s))))
        .when(s["kind"] == "index", one(F.get(items, F.when(s["lo"] < 0, n + s["lo"]).otherwise(s["lo"]))))
        .when(s["kind"] == "slice", many(F.slice(items, start + 1, F.greatest(bound(s["hi"], n) - start, F.lit(0)))))
        .when(s["kind"] == "order", F.when(items.isNotNull(), F.array(here(F.to_variant_object(_sorted(items, s))))))
        .when(s["kind"] == "below", below)
        .when(s["kind"] == "len", one(length))
        .when(s["kind"] == "keys", one(keys))
        .when(s["kind"] == "this", F.array(here(v)))
        .when(s["kind"] == "sub", one(F.regexp_replace(text, s["name"], s["literal"]).cast("variant")))
        .when(s["kind"] == "split", one(F.try_element_at(pieces, s["lo"] + F.when(s["lo"] < 0, 0).otherwise(1)).cast("variant")))
    )
    return F.coalesce(found, F.array())


def _done(t: Column) -> Column:
    return F.size(t["rest"]) == 0


def _onwards(todo: Column, ord_: Column, v: Column) -> Column:
    """`array<struct<todo, ord, v>>`: the places one step further, and this one with the paths that end here.

    Paths with the same next step take it together, and all of them look at one opened value.
    """
    place = lambda todo, ord_, v: F.struct(todo.alias("todo"), ord_.alias("ord"), v.alias("v"))
    next_of = lambda t: F.get(t["rest"], F.lit(0))

    def way(step: Column, items: Column, entries: Column) -> Column:
        def taken(some: Column) -> Column:
            rest = F.transform(some, lambda t: F.struct(t["path"].alias("path"), F.slice(t["rest"], 2, 1 << 20).alias("rest")))
            met = _children(ord_, v, items, entries, step)
            return let(rest, lambda r: F.transform(met, lambda m: place(F.when(m["again"], some).otherwise(r), m["ord"], m["v"])))

        return let(F.filter(todo, lambda t: next_of(t) == step), taken)

    def ways(heads: Column) -> Column:
        some = lambda *kinds: F.exists(heads, lambda h: h["kind"].isin(*kinds))
        items = F.when(some("each", "where", "index", "slice", "order", "below", "len"), list_items(v))
        entries = F.when(some("below", "len"), object_entries(v))
        steps_ = lambda x: lambda y: F.flatten(F.transform(heads, lambda h: way(h, x, y)))
        return let(items, lambda x: let(entries, steps_(x)))

    heads = F.array_distinct(F.transform(F.filter(todo, lambda t: ~_done(t)), next_of))
    answered = F.when(F.exists(todo, _done), F.array(place(F.filter(todo, _done), ord_, v))).otherwise(F.array())
    return F.when(F.forall(todo, _done), F.array(place(todo, ord_, v))).otherwise(F.concat(answered, let(heads, ways)))


def asked_paths(requests: DataFrame) -> DataFrame:
    """`(db_id, path)` of each readable path that is asked for; `NA` asks for nothing."""
    asked = requests.select("db_id", F.explode("path_list").alias("path")).where(F.col("path") != "NA")
    return asked.where(normalise_quotes("path").rlike(READ_PATH)).distinct()


def refused_paths(requests: DataFrame) -> DataFrame:
    """`(db_id, path)` of requested paths that no form of path text allows (see `validate.check_requests`)."""
    asked = requests.select("db_id", F.explode("path_list").alias("path")).where(F.col("path") != "NA")
    return asked.where(~F.coalesce(normalise_quotes("path").rlike(READ_PATH), F.lit(False))).distinct()


def _per_owner(asked: DataFrame) -> DataFrame:
    """`(db_id, todo)`: the paths of an owner with their steps, at most some `PATHS_PER_WALK` in a row."""
    parts = asked.groupBy("db_id").agg(F.ceil(F.count("*") / PATHS_PER_WALK).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("path"), F.coalesce("parts", F.lit(1)))
    return (
        asked.join(parts, "db_id", "left")
        .select("db_id", part.alias("part"), F.struct("path", steps(F.col("path")).alias("rest")).alias("p"))
        .groupBy("db_id", "part")
        .agg(F.collect_list("p").alias("todo"))
        .select("db_id", "todo")
    )


def fetch_any(docs: DataFrame, requests: DataFrame, levels: int | None = None) -> DataFrame:
    """Answers `(db_id, path, ord, value)` of `requests(db_id, path_list)`, `ord` numbering the matches of a path from 0.

    Paths may hold keys, positions (also from the end), slices with open or negative
    bounds, wildcards, tests, sort steps, `..name` and the functions `len`, `keys`,
    `this`, `sub(/pattern/, text)` and `split(text, piece, at most)`. A path without a
    match gives no row, JSON null is a match, an unreadable one is left to
    `refused_paths`. `levels` bounds the walk; left open, it is the number of steps of
    the longest path, and the depth of the deepest document if any path has a `..name`.
    """
    asked = asked_paths(requests)
    if levels is None:
        n, down = asked.agg(
            F.max(F.size(F.regexp_extract_all(normalise_quotes("path"), F.lit(STEP), F.lit(0)))),
            F.max(F.instr("path", "..") > 0),
        ).first()
        levels = (n or 0) + (document_depth(docs) if down else 0)
    rows = (
        docs.select("db_id", "doc")
        .join(_per_owner(asked), "db_id")
        .select("db_id", "todo", F.array().cast("array<int>").alias("ord"), F.col("doc").alias("v"))
    )
    for _ in range(levels):
        rows = rows.select("db_id", F.explode(_onwards(F.col("todo"), F.col("ord"), F.col("v"))).alias("m")).select("db_id", "m.*")
    found = rows.select("db_id", "ord", "v", F.explode(F.filter("todo", _done)).alias("t")).select(
        "db_id", F.col("t.path").alias("path"), "ord", F.to_json("v").alias("value")
    )
    along = Window.partitionBy("db_id", "path").orderBy("ord")
    return found.select("db_id", "path", (F.row_number().over(along) - 1).cast("bigint").alias("ord"), "value")
