"""The fold against a plain sequential replay in Python."""

import json
import random

import pytest

from docmem.operators import fold as fo

SCHEMA = "db_id string, seq bigint, path string, data string"


def replay(edits):
    """One owner's edits, applied one after another to a dict."""
    doc = {}
    for _, path, data in sorted(edits):
        keys = path.split(".")[1:]
        at, fits = doc, True
        trail = []
        for k in keys[:-1]:
            if not isinstance(at, dict):
                fits = False
                break
            if k not in at:
                trail.append((at, k))
                at[k] = {}
            at = at[k]
        if not fits or not isinstance(at, dict):
            continue
        value, last = json.loads(data), keys[-1]
        if isinstance(at.get(last), list):
            at[last] += value if isinstance(value, list) else [value]
        else:
            at[last] = value
    return doc


def docs_of(spark, rows, **options):
    log = spark.createDataFrame(rows, SCHEMA)
    out = fo.documents(fo.fold(log, **options)).collect()
    return {r.db_id: json.loads(r.doc) for r in out}


def test_append_extend_create_overwrite(spark):
    rows = [
        ("a", 1, "$.phones", "[]"),
        ("a", 2, "$.phones", '{"name": "adam"}'),
        ("a", 3, "$.phones", '["x", ["y"], null]'),
        ("a", 4, "$.user.name", '"D"'),
        ("a", 5, "$.user.name", '"David"'),
        ("a", 6, "NA", "{}"),
        ("b", 1, "$.tags", "1"),
        ("b", 2, "$.tags", "[2]"),
        ("b", 3, "$.tags", "3"),
        ("c", 1, "$.none", "[]"),
        ("c", 2, "$.gone", "null"),
        ("c", 3, "$.hollow", "{}"),
    ]
    assert docs_of(spark, rows) == {
        "a": {"phones": [{"name": "adam"}, "x", ["y"], None], "user": {"name": "David"}},
        "b": {"tags": [2, 3]},
        "c": {"none": [], "gone": None, "hollow": {}},
    }


def test_object_overwrite_replaces_the_whole_subtree(spark):
    rows = [
        ("a", 1, "$.user.last_name", '"M"'),
        ("a", 2, "$.user", '{"name": "D", "tags": ["x"]}'),
        ("a", 3, "$.user.tags", '"y"'),
        ("a", 4, "$.user.city.zip", "1"),
        ("b", 1, "$.user", "5"),
        ("b", 2, "$.user.name", '"lost"'),
        ("c", 1, "$.user", "[1]"),
        ("c", 2, "$.user", '{"k": 1}'),
        ("c", 3, "$.user.k", "2"),
    ]
    assert docs_of(spark, rows) == {
        "a": {"user": {"name": "D", "tags": ["x", "y"], "city": {"zip": 1}}},
        "b": {"user": 5},
        "c": {"user": [1, {"k": 1}]},
    }


def _random_value(rng, depth=0):
    pick = rng.random()
    if pick < 0.25 and depth < 3:
        return {k: _random_value(rng, depth + 1) for k in rng.sample("abc", rng.randint(0, 2))}
    if pick < 0.5:
        return [rng.choice([1, "s", None, {"a": 1}]) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 2.5, "text", None, True, "it's"])


@pytest.mark.parametrize("segment", [3, 1 << 20])
def test_random_logs_equal_sequential_replay(spark, monkeypatch, segment):
    monkeypatch.setattr(fo, "SEGMENT", segment)
    rng = random.Random(7)
    rows = []
    for owner in range(250):
        for seq in range(rng.randint(1, 14)):
            path = "$." + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 3)))
            rows.append((str(owner), seq, path, json.dumps(_random_value(rng))))
    want = {}
    for o in {r[0] for r in rows}:
        want[o] = replay([r[1:] for r in rows if r[0] == o])
    got = docs_of(spark, rows)
    wrong = {o: (want[o], got.get(o)) for o in want if want[o] != got.get(o)}
    assert not wrong, list(wrong.items())[:2]


def test_positions_and_pages(spark, monkeypatch):
    monkeypatch.setattr(fo, "SEGMENT", 4)
    rows = [("a", i, "$.l", json.dumps([i, -i] if i % 3 == 0 else i)) for i in range(0, 40)]
    log = spark.createDataFrame(rows, SCHEMA)
    folded = fo.fold(log, nested=False)
    got = [json.loads(r.value) for r in folded.sort("pos").collect()]
    want = [x for i in range(40) for x in ([i, -i] if i % 3 == 0 else [i])]
    assert got == want
    assert [r.pos for r in folded.sort("pos").collect()] == list(range(len(want)))
    parts = fo.pages(folded, size=7).sort("page").collect()
    assert [x for p in parts for x in json.loads(p.value)] == want


def test_fold_onto_base(spark):
    base = spark.createDataFrame(
        [("a", '{"l": [1], "o": {"x": 1, "y": {"z": []}}}')], "db_id string, doc string"
    ).selectExpr("db_id", "parse_json(doc) doc")
    log = spark.createDataFrame(
        [("a", 0, "$.l", "2"), ("a", 1, "$.o.y.z", '"q"'), ("a", 2, "$.n", "true")], SCHEMA
    )
    out = fo.documents(fo.fold(fo.base_edits(base).unionByName(log))).collect()
    assert json.loads(out[0].doc) == {"l": [1, 2], "o": {"x": 1, "y": {"z": ["q"]}}, "n": True}
