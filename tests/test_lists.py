"""Lists kept as rows: ranks and slices against Python lists, repeated subtrees, paths seen in a document."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docmem.operators import lists, nodes, schema

SLICES = [
    (None, None, 1), (2, 5, 1), (-3, None, 1), (None, -2, 1), (1, -1, 2), (None, None, -1), (-2, None, -2), (5, 1, -1),
    (100, None, 1), (None, 100, 3), (-100, 2, 1), (None, -100, -1), (3, 3, 1), (100, -100, -4),
]


@pytest.fixture(scope="module")
def held():
    """One list holds two thirds of all elements; values repeat."""
    return {"long": [(i * 37) % 50 for i in range(400)], "short": [3, 1, 2, 3], "one": [9]}


@pytest.fixture(scope="module")
def placed(spark, held):
    rows = [(k, pos, v) for k, vs in held.items() for pos, v in enumerate(vs)] + [(None, 0, 1)]
    df = spark.createDataFrame(rows, "name string, pos int, value int")
    return lists.ranked(df, ["name"], [F.desc("value"), F.asc("pos")]).cache()


def in_order(vs):
    return sorted(range(len(vs)), key=lambda i: (-vs[i], i))


def test_ranks_cross_ranges(placed, held):
    got = {(r["name"], r["rank"]): (r["pos"], r["size"]) for r in placed.collect()}
    assert got == {(k, n): (pos, len(vs)) for k, vs in held.items() for n, pos in enumerate(in_order(vs))}


def test_a_long_list_is_ranked_by_several_tasks(placed):
    plan = placed._jdf.queryExecution().toString()
    assert "_range" in plan  # numbered by range and list, never by the list alone


@pytest.mark.parametrize("start,stop,step", SLICES)
def test_slices_are_those_of_lists(placed, held, start, stop, step):
    rows = lists.sliced(placed, start, stop, step).select("name", "ord", "pos").collect()
    got = {(r["name"], r["ord"]): r["pos"] for r in rows}
    assert len(got) == len(rows)
    assert got == {(k, n): pos for k, vs in held.items() for n, pos in enumerate(in_order(vs)[start:stop:step])}


def test_positions(placed, held):
    got = {(r["name"], r["rank"]) for r in lists.at(placed, 0, -2, 399).collect()}
    assert got == {("long", 0), ("long", 398), ("long", 399), ("short", 0), ("short", 2), ("one", 0)}


def test_a_step_of_nothing_is_refused(placed):
    with pytest.raises(ValueError):
        lists.sliced(placed, step=0)


def test_empty_rows(spark):
    empty = spark.createDataFrame([], "name string, pos int")
    out = lists.ranked(empty, ["name"], [F.asc("pos")])
    assert out.columns == ["name", "pos", "size", "rank"] or set(out.columns) == {"name", "pos", "size", "rank"}
    assert out.count() == 0


DOCS = [
    {"a": {"x": 1, "y": [1, 2, {"z": "ž"}]}, "b": {"x": 2}},
    {"b": {"y": [1, 2, {"z": "ž"}], "x": 1}, "c": []},
    {"c": {"x": 2}, "d": {"x": 2}, "e": {}},
    {"only": {"y": [1, 2, {"z": "ž"}]}},
    [{"x": 2}, [[[[[[[[[[{"x": 2}, 5]]]]]]]]]]],
    7,
]


def expected_subtrees(docs):
    seen, docs_of, parents = Counter(), {}, []

    def walk(v, parent, i):
        if not isinstance(v, (dict, list)) or not v:
            return
        fp = hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        seen[fp] += 1
        docs_of.setdefault(fp, set()).add(i)
        parents.append((fp, parent))
        for x in v.values() if isinstance(v, dict) else v:
            walk(x, fp, i)

    for i, d in enumerate(docs):
        walk(d, None, i)
    tops = Counter(fp for fp, parent in parents if seen[fp] > 1 and seen[parent] <= 1)
    return {(fp, seen[fp], len(docs_of[fp]), n) for fp, n in tops.items()}


@pytest.mark.parametrize("depth", [None, 16])
def test_repeated_subtrees_are_maximal(spark, depth):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)], "db_id int, text string")
    docs = rows.select("db_id", F.parse_json("text").alias("doc"))
    got = nodes.duplicate_subtrees(nodes.subtrees(docs, depth)).collect()
    assert {(r.fp, r.n, r.n_docs, r.n_top) for r in got} == expected_subtrees(DOCS)
    assert len(got) == len(expected_subtrees(DOCS)) > 1


def test_too_little_depth_fails(spark):
    docs = spark.sql("SELECT 1 AS db_id, parse_json('{\"a\": [[1]]}') AS doc")
    for made in (nodes.subtrees(docs, 2), schema.seen_paths(docs, 2)):
        with pytest.raises(Exception, match="deeper than 2"):
            made.collect()


def test_paths_are_told_once_per_document(spark):
    texts = ['{"a": [{"k": 1}, {"k": "x"}, {"k": 2}, {}], "b c": {"d": null}}', '{"a": []}', "5", "{}", '{"a": [[1, 2], [3.5]]}', None]
    docs = spark.createDataFrame(list(enumerate(texts)), "db_id int, text string").select("db_id", F.parse_json("text").alias("doc"))
    got = {}
    for r in schema.seen_paths(docs).collect():
        assert len(r["seen"]) == len(set(r["seen"]))
        got[r["db_id"]] = {(s["path"], s["jtype"], s["leaf"]) for s in r["seen"]}
    assert got[0] == {
        ("$.a", "array", False), ("$.a[*]", "object", False), ("$.a[*]", "object", True), ("$.a[*].k", "integer", True),
        ("$.a[*].k", "string", True), ('$["b c"]', "object", False), ('$["b c"].d', "null", True),
    }
    assert got[1] == {("$.a", "array", True)}
    assert got[2] == {("$", "integer", True)} and got[3] == {("$", "object", True)}
    assert got[4] == {("$.a", "array", False), ("$.a[*]", "array", False), ("$.a[*][*]", "integer", True), ("$.a[*][*]", "number", True)}
    there = {r["path"]: r["n"] for r in schema.presence(docs.where("db_id < 5")).collect()}
    assert there == {"$": 2, "$.a": 3, "$.a[*]": 2, "$.a[*].k": 1, '$["b c"]': 1, '$["b c"].d': 1, "$.a[*][*]": 1}


def test_presence_shuffles_paths_only(spark):
    docs = spark.sql("SELECT id AS db_id, parse_json('{\"a\": 1}') AS doc FROM range(4)")
    plan = schema.presence(docs, max_depth=2)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange" in line]
    assert shuffles and not any("db_id" in line for line in shuffles)
