"""Path builders and path text on small documents."""

import json

import pytest
from pyspark.sql import functions as F

from docmem.functions import jsontext, paths
from docmem.operators import leaves as lv
from docmem.operators import reads

DOC = {
    "phones": [
        {"name": "adam", "number": "1", "price": 5},
        {"name": "Adam", "number": "2", "price": 12.5},
        {"name": "Jane Doe", "number": "3"},
        "stray",
    ],
    "user": {"name": "d", "tags": []},
    "events": ["x", None],
}


def found(spark, *steps, doc=DOC):
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"))
    m = paths.matches("doc", *steps)
    return [json.loads(x) for x in df.select(F.transform(m, lambda x: F.to_json(x)).alias("m")).first().m]


def test_fields_and_wildcards(spark):
    f, each = paths.field, paths.each
    assert found(spark, f("user"), f("name")) == ["d"]
    assert found(spark, f("phones"), each(), f("number")) == ["1", "2", "3"]
    assert found(spark, f("phones"), f("number")) == []
    assert found(spark, f("nothing"), f("x")) == []
    assert found(spark, f("events"), each()) == ["x", None]


def test_predicates(spark):
    def names(*tests):
        return [x["number"] for x in found(spark, paths.field("phones"), paths.where(*tests))]

    assert names(paths.eq("name", "adam")) == ["1"]
    assert names(paths.eq_any_case("name", "ADAM")) == ["1", "2"]
    assert names(paths.compare("price", ">", 5)) == ["2"]
    assert names(paths.compare("price", ">=", 5), paths.compare("price", "<", 12)) == ["1"]
    assert names(paths.compare("name", "!=", "adam")) == ["2", "3"]
    assert names(paths.compare("name", ">", 3)) == []  # other types do not match
    assert names(paths.regex("name", "jane doe")) == []  # case matters
    assert names(paths.regex("name", "Doe")) == ["3"]  # search, not full match


def test_sort_index_slice_functions(spark):
    doc = {"l": [{"a": 1, "b": 2}, {"a": 3, "b": 1}, {"a": 1, "b": 1}, {"b": 9}], "s": "a,b"}
    by = paths.order(("a", "bigint", True), ("b", "bigint", False))
    got = found(spark, paths.field("l"), by, paths.each(), doc=doc)
    assert got == [{"a": 3, "b": 1}, {"a": 1, "b": 1}, {"a": 1, "b": 2}, {"b": 9}]
    assert found(spark, paths.field("l"), paths.index(-1), doc=doc) == [{"b": 9}]
    assert found(spark, paths.field("l"), paths.index(7), doc=doc) == []
    assert found(spark, paths.field("l"), paths.part(1, 3), paths.field("b"), doc=doc) == [1, 1]
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.parse_json("t").alias("doc"))
    row = df.select(
        paths.length()(paths.matches("doc", paths.field("l"))).alias("n"),
        paths.split(",", 1)(paths.matches("doc", paths.field("s"))).alias("p"),
        paths.sub("[ab]", "-")(paths.matches("doc", paths.field("s"))).alias("r"),
    ).first()
    assert (row.n, row.p, row.r) == ([4], ["b"], ["-,-"])


def test_path_text(spark):
    rows = [
        ("$.a.b", ["$.a"], "$.a.b"),
        ('$.a["x.y"].c', ["$.a", '$.a["x.y"]'], "$.a.c"),
        ('$.phones[?name = "adam"].number', None, "$.phones.number"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    got = df.select(paths.prefixes_of("path").alias("up"), paths.simplify("path").alias("flat")).collect()
    assert [r.flat for r in got] == [r[2] for r in rows]
    assert [r.up for r in got][:2] == [r[1] for r in rows][:2]
    quoted = spark.createDataFrame([("$['a b'].x",), ("$.l[?n = 'it'].v",)], "p string")
    assert [r[0] for r in quoted.select(paths.normalise_quotes("p")).collect()] == ['$["a b"].x', '$.l[?n = "it"].v']


def test_is_json_takes_the_whole_text(spark):
    good = ["1", " 7 ", '"a"', "null", "[1,2]", '{"a":[1]}', "1.5e3", "true"]
    bad = ["plain words", "+420", "5 6", "5, 6", "5] x", '5,"e":0} x', "", "{", "NaN", '"a" b', "[1] [2]", "5}] x"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.select(jsontext.is_json("t")).collect()] == [True] * len(good) + [False] * len(bad)


def test_leaves_and_rebuild_are_inverse(spark):
    docs = [
        {"a": {"b": [1, {"c": None}], "d": {}}, "e": [], "f": 'q"uote', "odd key.x": {"é": 1.5}},
        {"only": True},
        {"n": None, "deep": {"a": {"b": {"c": {"d": "x"}}}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "db_id int, t string")
    df = df.select("db_id", F.parse_json("t").alias("doc"))
    rows = lv.leaves(df, enter_lists=False)
    back = {r.db_id: json.loads(r.doc) for r in lv.rebuild(rows, ["db_id"]).collect()}
    assert back == dict(enumerate(docs))
    every = {(r.path, r.jtype) for r in lv.leaves(df).where("db_id = 0").collect()}
    assert every == {
        ("$.a.b[0]", "integer"),
        ("$.a.b[1].c", "null"),
        ("$.a.d", "object"),
        ("$.e", "array"),
        ("$.f", "string"),
        ('$["odd key.x"]["é"]', "number"),
    }


def test_too_deep_fails_loudly(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1}}}')], "db_id int, t string")
    df = df.select("db_id", F.parse_json("t").alias("doc"))
    assert lv.leaves(df, max_depth=3).count() == 1
    try:
        lv.leaves(df, max_depth=2).collect()
    except Exception as e:
        assert "deeper than 2" in str(e)
    else:
        raise AssertionError("data was lost")


def test_any_depth(spark):
    def nest(n):
        doc = {"x": 1.50, "l": [[1, [2.25]], {}]}
        for i in range(n):
            doc = {"k": doc, "l": [doc["x"] if "x" in doc else i, [None, {"odd [key": '{[\\"'}]]} if i % 2 else {"d": doc}
        return doc

    docs = {1: nest(30), 2: {"a": 1}, 3: nest(9), 4: 5, 5: [], 6: nest(3)}
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs.items()], "db_id int, t string")
    df = df.select("db_id", F.parse_json("t").alias("doc")).unionByName(
        spark.sql("SELECT 7 AS db_id, CAST(NULL AS VARIANT) AS doc")
    )
    assert lv.document_depth(df) > 30
    rows = lv.leaves(df, enter_lists=False)
    back = {r.db_id: json.loads(r.doc) for r in lv.rebuild(rows.where("db_id < 7"), ["db_id"]).collect()}
    assert back == docs
    every = lv.leaves(df)

    def count(x):
        kids = x.values() if isinstance(x, dict) else x if isinstance(x, list) else []
        return sum(map(count, kids)) if kids else 1

    assert {r.db_id: r["count"] for r in every.where("db_id < 7").groupBy("db_id").count().collect()} == {
        i: count(d) for i, d in docs.items()
    }
    assert reads.descendants(df, "x").where("db_id = 1").first().path.count(".") > 25


def test_slices(spark):
    df = spark.createDataFrame([('{"l":[0,1,2,3,4]}',), ('{"l":[]}',), ('{"l":7}',)], "t string").select(F.parse_json("t").alias("doc"))
    for a, b in [(None, None), (1, 3), (-2, None), (None, -1), (-9, 2), (3, 1), (4, 99), (-1, -3), (7, 9)]:
        got = df.select(F.to_json(F.transform(paths.matches("doc", paths.field("l"), paths.part(a, b)), lambda x: F.to_json(x)))).collect()
        assert [json.loads(r[0]) for r in got] == [[str(x) for x in [0, 1, 2, 3, 4][a:b]], [], []]


def test_fetch_several_paths(spark):
    docs = spark.createDataFrame([(1, json.dumps(DOC))], "db_id int, t string").select(
        "db_id", F.parse_json("t").alias("doc")
    )
    asked = spark.createDataFrame([(1, ["$.user.name", "NA", "$.gone", "$.user.tags"])], "db_id int, path_list array<string>")
    got = {(r.path, r.value) for r in reads.fetch(docs, asked).collect()}
    assert got == {("$.user.name", '"d"'), ("$.user.tags", "[]")}


def test_deep_documents_take_one_explode_and_one_grouping(spark):
    text = '{"d":[' * 15 + '{"k":[[1,2.5],[]],"t":"x"}' + "]}" * 15
    df = spark.createDataFrame([(1, text), (2, "[]"), (3, None)], "db_id int, t string").select("db_id", F.try_parse_json("t").alias("doc"))
    rows = lv.leaves(df)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan
    at = "$" + ".d[0]" * 15
    assert {(r.db_id, r.path, r.value) for r in rows.collect()} == {
        (1, f"{at}.k[0][0]", "1"),
        (1, f"{at}.k[0][1]", "2.5"),
        (1, f"{at}.k[1]", "[]"),
        (1, f"{at}.t", '"x"'),
        (2, "$", "[]"),
        (3, "$", None),
    }
    back = lv.rebuild(rows, ["db_id"])
    assert back._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    assert {r.db_id: r.doc for r in back.collect()} == {1: text, 2: "[]", 3: None}


def test_deep_leaves_are_written_in_order(spark):
    at = "$" + ".d[0]" * 6
    rows = [(".l[10]", "2"), (".l[2]", "3"), (".l", "[]"), (".a.b", "1"), (".a", "{}"), (".a.c", None), ('["x\\"y"]', "4"), (".n[0]", None), (".e", "{}")]
    df = spark.createDataFrame([(1, at + p, v) for p, v in rows] + [(2, "$.u", "7")], "db_id int, path string, value string")
    inner = '{"a":{"b":1},"e":{},"l":[3,2],"n":[],"x\\"y":4}'
    assert {r.db_id: r.doc for r in lv.rebuild(df, ["db_id"]).collect()} == {1: '{"d":[' * 6 + inner + "]}" * 6, 2: '{"u":7}'}
    for clash in [(".a.b.c", "5"), (".a[0]", "5"), (".l", "{}"), (".l[*]", "5")]:
        more = spark.createDataFrame([(1, at + clash[0], clash[1])], df.schema)
        with pytest.raises(Exception, match="same place"):
            lv.rebuild(df.unionByName(more), ["db_id"]).collect()


def test_both_walks_find_the_same_leaves(spark):
    """The walk to each document's own depth against the chain of a given depth, on all kinds of values and sizes."""
    typed = """to_variant_object(named_struct('d', 1.50BD, 'w', 12345678901234567890.25BD, 'f', CAST(1.5 AS FLOAT), 'e', 1e300D,
        'day', DATE'2024-01-02', 't', TIMESTAMP'2024-01-02 03:04:05', 'n', TIMESTAMP_NTZ'2024-01-02 03:04:05', 'b', X'00FF', 'y', true,
        'i1', 5Y, 'i2', 500S, 'i4', 70000, 'i8', 5000000000L, 'none', CAST(NULL AS INT), 's', 'x', 'long', repeat('é', 99),
        'l', array(named_struct('a', 1), named_struct('a', NULL))))"""
    odd = {"a.b": 1, "[0]": {}, 'q"z': [], "back\\slash": [[]], "": {"é": None}, "line\n": 1, "two\nlines": {"-x": 0, "_y-1": 2}}
    wide = {f"k{i}": {"v": [i, "t" * (i % 90)]} for i in range(400)}
    texts = [odd, wide, [list(range(300))], [{"x": "y" * 70000}, 1], 5, "t", None, [], {}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(texts)], "db_id int, t string")
    df = df.select("db_id", F.parse_json("t").alias("doc"))
    df = df.unionByName(spark.sql(f"SELECT 100 AS db_id, {typed} AS doc UNION ALL SELECT 101, CAST(NULL AS VARIANT)"))

    def rows(**options):
        return sorted(map(str, lv.leaves(df, **options).collect()))

    for enter in (True, False):
        assert rows(enter_lists=enter) == rows(enter_lists=enter, max_depth=5)
    rooted = lv.explode_leaves(df.where("db_id IN (4, 8)"), root=F.when(F.col("db_id") == 4, "$.r"))
    assert {(r.db_id, r.path) for r in rooted.collect()} == {(4, "$.r"), (8, None)}


def test_a_walk_opens_each_container_once(monkeypatch):
    from docmem.functions import kernels

    depth = 200
    # one field "k" of one list each: offsets of two bytes
    value, metadata = b"\x0c\x07", b"\x01\x01\x00\x01k"
    for i in range(depth):
        n = len(value)
        head = b"\x07\x01" if i % 2 else b"\x06\x01\x00"
        value = head + (0).to_bytes(2, "little") + n.to_bytes(2, "little") + value
    opened, inside = [], kernels._inside
    monkeypatch.setattr(kernels, "_inside", lambda *x: opened.append(x[1]) or inside(*x))
    assert kernels.leaves_of(value, metadata, "$", True) == [("$" + "[0].k" * (depth // 2), b"\x0c\x07")]
    assert len(opened) == len(set(opened)) == depth


def test_rebuild_of_odd_keys_and_repeated_leaves(spark):
    """Deep documents are written like shallow ones, which are closed level by level."""
    deep = ".d[0]" * 6
    rows = [('["q\\"z"]', "1"), ('["tab\tand\x01"]', "2"), ('["é.[0]"][2]', "3"), ('["é.[0]"][10]', "4"), ("[\"\"]", "{}"), (".p.q", "5"), (".p.q", "6"), (".-1", "7"), (".s[0].t", None)]
    long = spark.createDataFrame([(1, "$" + deep + p, v) for p, v in rows], "db_id int, path string, value string")
    short = spark.createDataFrame([(1, "$" + p, v) for p, v in rows], "db_id int, path string, value string")
    want = lv.rebuild(short, ["db_id"], max_depth=4).first().doc
    assert lv.rebuild(long, ["db_id"]).first().doc == '{"d":[' * 6 + want + "]}" * 6
