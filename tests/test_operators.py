"""Schemas, nodes, checks, conversations, chunks, vectors, tables, extraction."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmem.operators import chunks, convo, extract, nodes, schema, tables, validate, vectors


def docs(spark, *items):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(items)], "db_id int, t string")
    return df.select("db_id", F.parse_json("t").alias("doc"))


def types(prof):
    return {r.path: list(r.types) for r in prof.collect()}


def test_profile_merges_types_and_drift(spark):
    a = docs(spark, {"year": 2010, "v": 1, "x": [{"k": 1}, {"k": "s"}], "type": "t", "e": []})
    b = docs(spark, {"year": "2010", "v": 1.5, "x": [{"k": 1}], "new": {}})
    both = schema.profile(a.unionByName(b))
    assert types(both) == {
        "$.year": ["integer", "string"],
        "$.v": ["number"],
        "$.x[*].k": ["integer", "string"],
        "$.type": ["string"],
        "$.e": ["array"],
        "$.new": ["object"],
    }
    assert {r.path for r in schema.conflicts(both).collect()} == {"$.year", "$.x[*].k"}
    change = {r.path: r.change for r in schema.drift(schema.profile(a), schema.profile(b)).collect()}
    assert change == {
        "$.year": "retyped",
        "$.v": "retyped",
        "$.x[*].k": "retyped",
        "$.type": "removed",
        "$.e": "removed",
        "$.new": "added",
    }
    text = schema.compress(schema.profile(a)).first().schema
    # a field called "type" hides nothing
    assert json.loads(text) == {
        "year": "integer",
        "v": "integer",
        "x": [{"k": ["integer", "string"]}],
        "type": "string",
        "e": "array",
    }


def python_nodes(obj, parent=""):
    """A direct recursive walk."""

    def scalars(o):
        return {k: v for k, v in o.items() if not isinstance(v, dict | list)}

    out = []
    if isinstance(obj, dict):
        if scalars(obj):
            out.append((parent or "root", scalars(obj)))
        for k, v in obj.items():
            if isinstance(v, dict | list):
                out += python_nodes(v, f"{parent}.{k}" if parent else k)
    elif isinstance(obj, list):
        for i, item in enumerate(obj):
            if isinstance(item, dict):
                text = ", ".join(f"{k}: {v}" for k, v in scalars(item).items())
                out += python_nodes(item, f"{parent}[{i}] ({text[:50]})")
    return out


def test_tree_nodes_keep_written_order(spark):
    doc = {
        "zeta": 1,
        "alpha": {"t": True, "n": None, "s": "x", "more": [{"b": 2, "a": "y" * 80, "inner": {"q": 1.5}}, "scalar", {}]},
        "list": [1, 2],
        "hollow": {"deep": {"v": "end"}},
    }
    df = spark.createDataFrame([(1, json.dumps(doc))], "db_id int, doc string")
    got = [(r.path, json.loads(r.node)) for r in nodes.tree_nodes(df).collect()]
    assert sorted(got, key=str) == sorted(python_nodes(doc), key=str)
    twice = df.unionAll(spark.createDataFrame([(2, '{"w":{"v":"end"}}')], "db_id int, doc string"))
    dup = nodes.duplicates(nodes.tree_nodes(twice)).collect()
    assert [(r.n, r.n_docs) for r in dup] == [(2, 2)]


def test_checks_split_edits(spark):
    rows = [
        (1, "$.a.b", "1", None),
        (2, "NA", "{}", None),
        (3, "$.a b", "1", "path"),
        (4, "$.a", "plain words", "data"),
        (5, "$['a b']", '"x"', None),
        (6, "$.l[?n = 'x'].v", "2", None),
        (7, "$", "{}", "path"),
        (8, None, "1", "path"),
        (9, "$.a", None, "data"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "seq int, path string, data string")
    got = {r.seq: r.fault for r in validate.check_edits(df).collect()}
    assert got == {r[0]: r[3] for r in rows}
    asked = spark.createDataFrame(
        [(1, ["$.a", "$.b[*].c"]), (2, []), (3, ["$.a", "oops"]), (4, ['$.p[?x =~ "a.*"][\\d,/e]'])],
        "i int, path_list array<string>",
    )
    assert {r.i: r.ok for r in validate.check_requests(asked).collect()} == {1: True, 2: True, 3: False, 4: True}
    qa = spark.createDataFrame([(["q"], ["a"]), (["q"], [])], "question array<string>, answers array<string>")
    assert [r.ok for r in validate.check_qa(qa).collect()] == [True, False]


def test_threads_in_pages(spark):
    rows = [(1, t, "tool" if t % 4 == 3 else "user", f"m{t}") for t in range(10)]
    df = convo.with_visibility(spark.createDataFrame(rows, "thread_id int, turn bigint, role string, content string"))
    threads = convo.export(convo.assemble(df, size=4)).sort("page").collect()
    assert [[m.content for m in t.messages] for t in threads] == [["m0", "m1", "m2"], ["m4", "m5", "m6"], ["m8", "m9"]]
    for size in (4, 256):
        before = {r.turn: r.context for r in convo.previous_context(df, size=size).collect()}
        assert before == {t: "\n  ".join(f"m{i}" for i in range(t)) for t in range(10)}
    assert convo.last_message(df).first().content == "m9"
    seeded = convo.seed_system_turn(df, "be kind").where("role = 'system'").collect()
    assert [(r.thread_id, r.turn, r.content) for r in seeded] == [(1, -1, "be kind")]


def test_deltas_calls_and_prompts(spark):
    frames = [(1, 0, "assistant", None), (1, 2, None, "lo"), (1, 1, None, "hel"), (1, 3, None, None)]
    df = spark.createDataFrame(frames, "id int, pos int, role string, content string")
    assert convo.concat_deltas(df, ["id"]).first().text == "hello"
    calls = spark.createDataFrame([(1, "save"), (2, "what")], "id int, name string")
    tools = spark.createDataFrame([("save", "update")], "name string, handler string")
    assert {r.id: r.handler for r in convo.route_calls(calls, tools).collect()} == {1: "update", 2: None}
    text = spark.range(1).select(convo.render("a {x} b {y}", x=F.lit("{y}"), y=F.lit(2))).first()[0]
    assert text == "a {y} b 2"


def test_chunks(spark):
    sets = spark.createDataFrame([(1, ["q1", "q2"], ["a1", "a2"]), (2, [], [])], "i int, question array<string>, answers array<string>")
    assert [r.content for r in chunks.qa_chunks(sets, ["i"]).sort("pos").collect()] == ["q1\na1", "q2\na2"]
    texts = spark.createDataFrame([("u", 1, "a\n \nb"), ("u", 2, "a"), ("v", 3, "a")], "uid string, text_id bigint, text string")
    ids = ("text_id", "line")
    kept = chunks.ingest(chunks.stamp(chunks.sentence_chunks(texts)), ids)
    stored = kept.collect()
    assert all(r.metadata["uid"] == r.uid for r in stored)
    later = chunks.sentence_chunks(texts.unionAll(spark.createDataFrame([("v", 4, "b")], texts.schema)))
    assert [(r.uid, r.content) for r in chunks.ingest(chunks.stamp(later), ids, into=kept).collect()] == [("v", "b")]
    assert sorted((r.uid, r.content, r.copies) for r in stored) == [("u", "a", 2), ("u", "b", 1), ("v", "a", 1)]


@pytest.mark.parametrize("layout", ["broadcast", "grid"])
def test_top_k_equals_brute_force(spark, monkeypatch, layout):
    if layout == "grid":
        monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 2)
        monkeypatch.setattr(vectors, "GROUP_ROWS", 40)
    rng = np.random.default_rng(5)
    # one tenant holds most of the vectors; equal vectors tie
    cand = [("hot" if i % 5 else f"t{i % 3}", i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(400)]
    quer = [(("hot", "t0", "t1", "none")[i % 4], 1000 + i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(100)]
    c = spark.createDataFrame(cand, "uid string, vec_id bigint, vector array<double>").repartition(6)
    q = spark.createDataFrame(quer, "uid string, query_id bigint, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in vectors.top_k(c, q, 3).collect()}

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / n), 6) if n else 0.0

    want = {}
    for uid, qid, qv in quer:
        scored = sorted((-cosine(qv, v), i) for u, i, v in cand if u == uid)
        for rank, (s, i) in enumerate(scored[:3], 1):
            want[qid, rank] = (i, pytest.approx(-s + 0.0, abs=1e-6))
    assert got.keys() == want.keys()
    assert all(want[k] == got[k] for k in want)


def test_patch_split_and_dump(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "id int, name string, n int")
    patch = spark.createDataFrame([(1, None, 10, True), (2, "B", 20, False)], "id int, name string, n int, set_name boolean")
    out = tables.patch_rows(base, patch, "id", {"name": F.col("p.set_name"), "n": F.lit(True)})
    assert sorted(tuple(r) for r in out.collect()) == [(1, None, 10), (2, "b", 20), (3, "c", 3)]
    cells = tables.split_into_tables(docs(spark, {"people": [{"n": "x", "at": {"z": 1}}, {"n": "y"}], "v": 3}))
    people = tables.table_of(cells, "people", ["n", "at.z"]).sort("item").collect()
    assert [(r.db_id, r.item, r.n, r["at.z"]) for r in people] == [(0, 0, '"x"', "1"), (0, 1, '"y"', None)]
    rows = {(r.table_name, r.row) for r in tables.dump({"t": base.where("id = 1")}).collect()}
    assert rows == {("t", '{"id":1,"name":"a","n":1}')}
    listed = tables.listing({"t": base}, {"t": "id"}).collect()
    assert [(r.column_name, r.type, r.pk, r.filled) for r in listed] == [
        ("id", "int", True, 3),
        ("name", "string", False, 3),
        ("n", "int", False, 3),
    ]
    lost = tables.orphans(spark.createDataFrame([(1, 9), (2, 1)], "c int, id2 int"), base, "id2", "id").collect()
    assert [r.c for r in lost] == [1]


def test_extract_edits(spark):
    text = (
        'call +420 123 456 or 602-777-8888, mail a.b@x-y.example.com; see https://e.org/p?q=1 on 2024-03-09. '
        'My last name is Moon. Eve lives in Brno, likes tea, her birthday is 3 May.'
    )
    df = spark.createDataFrame([(1, text), (2, "nothing")], "db_id int, text string")
    got = {}
    for r in extract.extract_edits(df).sort("ord").collect():
        got.setdefault(r.path, []).append(json.loads(r.data))
    assert got["$.emails"] == ["a.b@x-y.example.com"]
    assert got["$.links"] == ["https://e.org/p?q=1"]
    assert got["$.dates"] == ["2024-03-09"]
    assert got["$.last_names"] == ["Moon"]
    assert got["$.places"] == ["Brno"]
    assert got["$.likes"] == ["tea"]
    assert got["$.birthdays"] == ["3 May"]
    assert "602-777-8888" in got["$.phones"]


def test_same_numbers_on_any_layout(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 3), i, f"c{rng.randint(0, 5)}") for i in range(200)]
    df = spark.createDataFrame(rows, "uid int, chunk_id bigint, content string")
    one = sorted(tuple(r) for r in chunks.ingest(df.coalesce(1)).collect())
    many = sorted(tuple(r) for r in chunks.ingest(df.repartition(7)).collect())
    assert one == many
