"""Element edits of every form against a sequential replay."""

import json
import random
import re

from pyspark.sql import functions as F

from docmem.operators import fold as fo
from docmem.operators import matching, validate
from docmem.operators import sequenced as sq

SCHEMA = "db_id string, seq bigint, path string, data string"
ELEMENT = re.compile(r'^\$\.(\w+)\[(\*|-?\d+|\?\(?\s*(?:@\.)?(\w+) (==?|!=|<=?|>=?) ("[^"]*"|-?[\d.]+)\)?)\]((?:\.\w+)*)$')


def number(x):
    return isinstance(x, int | float) and not isinstance(x, bool)


def selects(x, field, op, literal):
    if not isinstance(x, dict) or field not in x:
        return False
    v, c = x[field], json.loads(literal)
    if not (number(v) and number(c) or isinstance(v, str) and isinstance(c, str)):
        return False
    return {"=": v == c, "==": v == c, "!=": v != c, "<": v < c, "<=": v <= c, ">": v > c, ">=": v >= c}[op]


def put(x, keys, data):
    """`x` with `data` at the place; `...` stands for a missing value."""
    if not keys:
        if isinstance(x, list):
            return x + (data if isinstance(data, list) else [data])
        return data
    if x is ...:
        x = {}
    if isinstance(x, dict):
        return {**x, keys[0]: put(x.get(keys[0], ...), keys[1:], data)}
    return x


def replay(edits):
    lists = {}
    for _, path, text in sorted(edits):
        data = json.loads(text)
        m = ELEMENT.match(path)
        if not m:
            lists[path[2:]] = put(lists.get(path[2:], ...), [], data)
            continue
        name, selector, field, op, literal, target = m.groups()
        found = lists.get(name)
        if not isinstance(found, list):
            continue
        if selector == "*":
            hit = range(len(found))
        elif field:
            hit = [i for i, x in enumerate(found) if selects(x, field, op, literal)]
        else:
            i = int(selector) + (len(found) if selector.startswith("-") else 0)
            hit = [i] if 0 <= i < len(found) else []
        for i in hit:
            found[i] = put(found[i], [k for k in target.split(".") if k], json.loads(text))
    return lists


def check(spark, rows, **options):
    want = {o: replay([r[1:] for r in rows if r[0] == o]) for o in {r[0] for r in rows}}
    want = {o: d for o, d in want.items() if d}
    df = spark.createDataFrame(rows, SCHEMA)
    assert validate.quarantine(validate.check_edits(df)).count() == 0
    out = fo.documents(matching.replay(df, **options)).collect()
    got = {r.db_id: json.loads(r.doc) for r in out}
    wrong = {o: (want.get(o), got.get(o)) for o in want.keys() | got.keys() if want.get(o) != got.get(o)}
    assert not wrong, list(wrong.items())[:2]


def test_examples(spark):
    rows = [
        ("a", 1, "$.phones", '[{"name": "adam", "price": 5}, {"name": "eve", "price": 20, "addr": {"zip": 1}}]'),
        ("a", 2, "$.phones[0].number", "42"),
        ("a", 3, "$.phones[?price > 10].x", "true"),
        ("a", 4, '$.phones[?name = "eve"].addr.city', '"Brno"'),
        ("a", 5, '$.phones[?(@.name == "adam")]', '{"name": "bob"}'),
        ("a", 6, '$.phones[?name = "bob"].name', '"eve"'),  # changes what the next one selects
        ("a", 7, '$.phones[?name = "eve"].seen', "7"),
        ("a", 8, "$.phones", '{"name": "late"}'),
        ("a", 9, "$.phones[-1].last", "1"),
        ("a", 10, "$.phones[9].none", "1"),
        ("b", 1, "$.l", '[{"k": 1}, 2, [3]]'),  # another owner, simple updates only
        ("b", 2, "$.l[?k = 1].v", "2"),
        ("c", 1, "$.l", "[1, [2], null]"),
        ("c", 2, "$.l[*]", "9"),
    ]
    check(spark, rows, nested=False)


def log(r, owners, dependent):
    rows = []
    for o in range(owners):
        n = r.randint(3, 22)
        for seq in range(n):
            name = r.choice("lm")
            if r.random() < 0.4:
                x = {"id": r.choice([0, 1, 2.5, -3, 1024, "1"]), "who": r.choice(["x", "y", "", "žž"])}
                if r.random() < 0.3:
                    x["tags"] = r.choice([[], [0], {"a": [1]}, None])
                x = r.choice([x, x, x, 5, [1]])
                rows.append((f"o{o}", seq, f"$.{name}", json.dumps([x] if r.random() < 0.7 else x)))
                continue
            selector = r.choice(
                ["*", "0", "-1", "2", "?id = 1", "?id >= 1", "?id < 2", "?id != 0", '?who = "x"', '?who > "x"', '?(@.who == "y")', "?id = 2.5", '?who <= "x"']
            )
            target = r.choice(["", ".tags", ".tags.a", ".note", ".a.b.c"] + [".id", ".who", ".who"] * dependent)
            data = r.choice([5, "x", ["t", None], {"k": [1]}, {"id": 1, "who": "y"}, None, 1, "y"])
            rows.append((f"o{o}", seq, f"$.{name}[{selector}]{target}", json.dumps(data)))
    return rows


def test_random_logs_equal_a_sequential_replay(spark):
    plain = [("p" + o, *rest) for o, *rest in log(random.Random(6), 40, 0)]
    check(spark, log(random.Random(5), 100, 1) + plain, nested=False)


def test_long_lists_count_from_the_end_in_segments(spark, monkeypatch):
    monkeypatch.setattr(sq, "SEGMENT", 4)
    rows = [("a", i, "$.l", f'{"[" if i == 0 else ""}{{"i": {i}}}{"]" if i == 0 else ""}') for i in range(0, 40, 2)]
    rows += [("a", i, f"$.l[-{1 + i % 5}].hit", str(i)) for i in range(1, 40, 2)]
    check(spark, rows, nested=False)


def test_superseded_updates_do_not_travel(spark):
    rows = [("a", 0, "$.l", "[" + ",".join(f'{{"p": {i}}}' for i in range(50)) + "]")]
    rows += [("a", i, "$.l[?p > 10].x", str(i)) for i in range(1, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    updates = sq.element_edits(df)
    elements = fo.fold(df.where("seq = 0"), nested=False)
    assert sq._shrunk(elements, updates, updates.limit(0)).count() == 1
    out = sq.replay_lists(elements, updates)
    assert out.where(F.col("value").contains('"x":299')).count() == 39


def test_long_tables_are_not_broadcast(spark):
    """Files that pack well say little of the memory that a table takes; the log, its elements and updates never pass through the driver."""
    rows = [("a", i, "$.l", f'[{{"k":{i},"s":"new"}}]') for i in range(0, 40, 2)]
    rows += [("a", i, '$.l[?s = "new"].s', '"seen"') for i in (11, 21)] + [("a", 31, '$.l[?s = "seen"].s', '"done"')]
    edits = spark.createDataFrame(rows, SCHEMA)
    updates = sq.element_edits(edits)
    out = sq.replay_lists(fo.fold(edits.where("path = '$.l'"), nested=False), updates)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    got = {json.loads(r.value)["k"]: json.loads(r.value)["s"] for r in out.collect()}
    assert got == {i: "done" if i < 21 else "new" for i in range(0, 40, 2)}
