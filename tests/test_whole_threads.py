"""Rows that once gave silently wrong results."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docmem.functions import jsontext
from docmem.functions import paths as p
from docmem.operators import convo, extract, fold, leaves, reads, requests, schema, tables
from docmem.sources import keyed


def test_pairs_and_context_of_a_long_thread(spark):
    rows = [(1, 0, "system", "be kind")]
    for i in range(260):
        rows += [(1, 2 * i + 1, "user", f"q{i}"), (1, 2 * i + 2, "assistant", f"a{i}")]
    rows += [(2, 0, "user", "alone")]
    df = spark.createDataFrame(rows, "thread_id int, turn bigint, role string, content string")
    pairs = {(r.thread_id, r.pos): (r.question, r.answer) for r in convo.qa_pairs(df).collect()}
    assert pairs == {(1, i): (f"q{i}", f"a{i}") for i in range(260)}
    assert {r.thread_id: r.ok for r in convo.qa_counts(df).collect()} == {1: True, 2: False}
    context = {r.turn: r.context for r in convo.previous_context(df.where("thread_id = 1")).collect()}
    said = [r[3] for r in rows[:-1]]
    assert all(context[t] == convo.CONTEXT_SEPARATOR.join(said[:t]) for t in (0, 1, 255, 256, 257, 512, 520))


def test_deep_paths_are_not_split(spark):
    log = spark.createDataFrame([(1, "$.a.b.c.d.e.f.g.h.i", "1"), (1, "$.x", "2")], "db_id int, path string, value string")
    with pytest.raises(PySparkException):
        leaves.rebuild(log, ["db_id"], max_depth=8).collect()
    assert [r.doc for r in leaves.rebuild(log, ["db_id"]).collect()] == ['{"a":{"b":{"c":{"d":{"e":{"f":{"g":{"h":{"i":1}}}}}}}},"x":2}']


def test_kind_of_indented_json(spark):
    df = spark.createDataFrame([("\n[1]",), ("\t {}",), (" 1",)], "t string")
    assert [r[0] for r in df.select(jsontext.text_kind("t")).collect()] == ["list", "object", "scalar"]
    edits = spark.createDataFrame([(1, 1, "$.a", "\n[1]"), (1, 2, "$.a", "2")], "db_id int, seq bigint, path string, data string")
    assert sorted(r.value for r in fold.fold(edits).collect()) == ["1", "2"]


def test_mismatched_types_never_match(spark):
    df = spark.sql("""SELECT parse_json('{"l":[{"v":35,"i":1},{"v":"35","i":2},{"v":{"x":3},"i":3},{"v":true,"i":4}]}') AS doc""")

    def hits(test):
        found = p.matches("doc", p.field("l"), p.where(test), p.field("i"))
        return [int(x) for x in df.select(p.texts()(found)).first()[0]]

    assert hits(p.eq("v", "35")) == [2] and hits(p.eq("v", 35)) == [1]
    assert hits(p.regex("v", "3")) == [2] and hits(p.compare("v", ">", 3)) == [1] and hits(p.eq("v", True)) == [4]


def test_requests_of_several_places_do_not_end_the_job(spark):
    docs = spark.sql("""SELECT 1 AS db_id, parse_json('{"a":[{"n":1}],"b c":2}') AS doc""")
    asked = spark.createDataFrame([(1, ["$.a[0].n", '$["b c"]', "$.a[*].n", "$..n", "$.a[?n > 0].n", "NA"])], "db_id int, path_list array<string>")
    assert {r.path: r.value for r in reads.fetch(docs, asked).collect()} == {"$.a[0].n": "1", '$["b c"]': "2"}
    every = {(r.path, r.ord): r.value for r in requests.fetch_any(docs, asked).collect()}
    assert every == {("$.a[0].n", 0): "1", ('$["b c"]', 0): "2", ("$.a[*].n", 0): "1", ("$..n", 0): "1", ("$.a[?n > 0].n", 0): "1"}
    hyphen = spark.sql("""SELECT 1 AS db_id, array('$.a-b', '$.a.c-d[0]') AS path_list""")
    docs = spark.sql("""SELECT 1 AS db_id, parse_json('{"a-b":1,"a":{"c-d":[2]}}') AS doc""")
    assert {r.path: r.value for r in reads.fetch(docs, hyphen).collect()} == {"$.a-b": "1", "$.a.c-d[0]": "2"}
    found = reads.descendants(spark.sql("""SELECT 1 AS db_id, parse_json('{"f":{"f":[1],"q.f":2},"g":[{"f":3}]}') AS doc"""), "f")
    assert {r.path: r.t for r in found.select("path", F.to_json("v").alias("t")).collect()} == {"$.f": '{"f":[1],"q.f":2}', "$.f.f": "[1]", "$.g[0].f": "3"}


def test_containers_in_profiles(spark):
    docs = spark.sql("""SELECT 1 AS db_id, parse_json('{"u":"x","l":[1]}') AS doc
    UNION ALL SELECT 2, parse_json('{"u":{"a":1},"l":[{"b":2},{"b":3}]}')""")
    prof = schema.profile(docs, containers=True)
    assert {r.path: (r.n, r.types) for r in schema.conflicts(prof).collect()} == {"$.u": (2, ["object", "string"]), "$.l[*]": (2, ["integer", "object"])}
    ratio = {r.path: r.ratio for r in schema.presence(docs).collect()}
    assert ratio["$.l"] == 1 and ratio["$.u"] == 1 and ratio["$.u.a"] == 0.5
    old, new = (schema.profile(docs.where(f"db_id = {i}"), containers=True) for i in (1, 2))
    assert {r.path: r.change for r in schema.drift(old, new).collect()}["$.u"] == "retyped"
    notes = spark.createDataFrame([(1, "$.u", "one"), (2, "$.u.a", "two")], "db_id int, path string, description string")
    told = schema.with_descriptions(schema.profile(docs, by=("db_id",)), notes).where("description IS NOT NULL").collect()
    assert {(r.db_id, r.path, r.description) for r in told} == {(1, "$.u", "one"), (2, "$.u.a", "two")}


def test_small_mends(spark):
    ids = spark.sql("SELECT 'a/b' AS x, 'c' AS y UNION ALL SELECT 'a', 'b/c' UNION ALL SELECT 'a', NULL UNION ALL SELECT NULL, 'a'")
    assert keyed.create(ids, "users", "x", "y").select("uid").distinct().count() == 4
    base = spark.createDataFrame([(1, "a")], "id int, name string")
    patches = spark.createDataFrame([(1, "c", 2), (1, "b", 1)], "id int, name string, seq int")
    assert [r.name for r in tables.patch_rows(base, patches, "id", {"name": F.lit(True)}, order="seq").collect()] == ["c"]
    assert {r.table_name for r in tables.dump({"t": base, "sqlite_master": base, "system.users": base}).collect()} == {"t"}
    text = "Eva lives in San Francisco, her last name is Moko\u0161. She likes ice cream."
    log = extract.extract_log(spark.createDataFrame([(1, 5, text)], "db_id int, seq bigint, text string"))
    got = {r.path: r.data for r in log.collect()}
    assert got["$.places"] == '["San Francisco"]' and got["$.last_names"] == '["Moko\u0161"]' and got["$.likes"] == '["ice cream"]'
    assert log.select("db_id", "seq").distinct().count() == log.count()


def test_bad_vectors_are_set_aside(spark):
    from docmem.operators import vectors

    rows = [(0, 1, [1.0, 0.0]), (0, 2, None), (0, 3, [1.0]), (0, 4, [float("nan"), 1.0]), (0, 5, [1.0, None]), (0, 6, [0.6, 0.8])]
    c = spark.createDataFrame(rows, "uid int, vec_id bigint, vector array<double>")
    q = spark.createDataFrame([(0, 9, [1.0, 0.0]), (0, 10, None)], "uid int, query_id bigint, vector array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in vectors.top_k(c, q, 3).sort("rank").collect()] == [(9, 1, 1.0), (9, 6, 0.6)]
    assert {r.vec_id for r in vectors.unusable(c, 2).collect()} == {2, 3, 4, 5}


def test_no_value_is_lost_in_a_rebuild(spark):
    clash = spark.createDataFrame([(1, "$.a", "1"), (1, "$.a.b", "2")], "db_id int, path string, value string")
    with pytest.raises(PySparkException):
        leaves.rebuild(clash, ["db_id"]).collect()
    edits = spark.createDataFrame([(1, 1, "$.a", "[1,2,3]")], "db_id int, seq bigint, path string, data string")
    with pytest.raises(PySparkException):
        fold.documents(fold.fold(edits, positions=False)).collect()
    assert [r.doc for r in fold.documents(fold.fold(edits)).collect()] == ['{"a":[1,2,3]}']
    docs = spark.sql("""SELECT 1 AS db_id, parse_json('{"a\\\\nb":{"q\\\\"z":1}}') AS doc""")
    rows = leaves.leaves(docs).select("db_id", "path", "value")
    assert [r.doc for r in leaves.rebuild(rows, ["db_id"]).collect()] == ['{"a\\nb":{"q\\"z":1}}']


def test_spellings_of_a_path_are_one_path(spark):
    from docmem.operators import validate

    rows = [(1, 1, "$.a", "1"), (1, 2, "$['a']", "2"), (1, 3, '$["a"]', "3"), (1, 4, "$['a b']", "4")]
    checked = validate.check_edits(spark.createDataFrame(rows, "db_id int, seq bigint, path string, data string"))
    assert [r.path for r in checked.sort("seq").collect()] == ["$.a", "$.a", "$.a", '$["a b"]']


def test_compressed_schema_keeps_alternatives(spark):
    docs = spark.sql("""SELECT 1 AS db_id, parse_json('{"u":"x","l":[1]}') AS doc
    UNION ALL SELECT 2, parse_json('{"u":{"a":1},"l":[{"b":2}]}')""")
    assert schema.compress(schema.profile(docs)).first().schema == '{"l":[["integer",{"b":"integer"}]],"u":["string",{"a":"integer"}]}'
