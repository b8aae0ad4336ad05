"""Set-based reads against a walk in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docmem.operators import requests as rq
from docmem.operators import validate

STEP = re.compile(r'\.\.([\w-]+)|\.`([^`]+)`|\.([\w-]+)|\["([^"]+)"\]|\[(\?[^"\]]*(?:"[^"]*")?[^"\]]*)\]|\[([^"\]?]*)\]')


def kind(x):
    return "b" if isinstance(x, bool) else "n" if isinstance(x, int | float) else "s" if isinstance(x, str) else "o"


def condition_of(step):
    field, op, lit = re.match(r'\?\(?\s*(?:@\.)?([\w.]+)\s*(==?|!=|<=?|>=?|=~)\s*("[^"]*"|-?[\d.]+)', step).groups()
    lit = json.loads(lit)

    def ok(x):
        for k in field.split("."):
            if not isinstance(x, dict) or k not in x:
                return False
            x = x[k]
        if kind(x) != kind(lit):
            return False
        return {"=": x == lit, "==": x == lit, "!=": x != lit, "=~": op == "=~" and bool(re.search(str(lit), str(x)))}.get(op) or (
            op in ("<", "<=", ">", ">=") and {"<": x < lit, "<=": x <= lit, ">": x > lit, ">=": x >= lit}[op]
        )

    return ok


def below(x, name):
    if isinstance(x, dict):
        if name in x:
            yield x[name]
        for k in sorted(x):
            yield from below(x[k], name)
    elif isinstance(x, list):
        for y in x:
            yield from below(y, name)


def sort_key(x, names):
    def one(name):
        v = x.get(name) if isinstance(x, dict) else None
        return v

    return [one(n) for n in names]


def walk(doc, path):
    found = [doc]
    for m in STEP.finditer(path):
        down, fn, plain, quoted, test, brackets = m.groups()
        out = []
        for x in found:
            if down:
                out += below(x, down)
            elif fn:
                if fn == "len" and isinstance(x, list | dict | str):
                    out.append(len(x))
                elif fn == "keys" and isinstance(x, dict):
                    out.append(sorted(x))
                elif fn == "this":
                    out.append(x)
                elif fn.startswith("sub(") and isinstance(x, str):
                    p, r = re.match(r"sub\(/(.*)/,\s*(.*)\)", fn).groups()
                    out.append(re.sub(p, r, x))
                elif fn.startswith("split(") and isinstance(x, str):
                    c, i, n = re.match(r"split\((.+), (-?\d+), (-?\d+)\)", fn).groups()
                    pieces = x.split(c, int(n))
                    if -len(pieces) <= int(i) < len(pieces):
                        out.append(pieces[int(i)])
            elif plain or quoted:
                if isinstance(x, dict) and (plain or quoted) in x:
                    out.append(x[plain or quoted])
            elif not isinstance(x, list):
                continue
            elif test:
                out += filter(condition_of(test), x)
            elif brackets == "*":
                out += x
            elif ":" in brackets:
                a, b = brackets.split(":")
                out += x[int(a) if a else None : int(b) if b else None]
            elif brackets[0] in "\\/":
                keys = [(k.strip()[1:], k.strip()[0] == "\\") for k in brackets.split(",")]
                y = list(x)
                for name, desc in reversed(keys):
                    has = [z for z in y if isinstance(z, dict) and name in z]
                    y = sorted(has, key=lambda z: (z[name] if not isinstance(z[name], str) else 0, str(z[name]) if isinstance(z[name], str) else ""), reverse=False) if not desc else [
                        z for _, z in sorted(enumerate(has), key=lambda e: (e[1][name], -e[0]), reverse=True)
                    ]
                    y += [z for z in x if z not in has]
                out.append(y)
            else:
                i = int(brackets)
                if -len(x) <= i < len(x):
                    out.append(x[i])
        found = out
    return found


DOC = {
    "phones": [
        {"name": "adam", "number": 1, "price": 20.5, "tags": ["a", "b"], "at": {"city": "Brno"}},
        {"name": "eve", "number": 2, "price": 5, "at": {"city": "Praha"}},
        {"name": "it's", "number": "3", "price": 99},
        7,
        None,
    ],
    "a-b": {"x y": {"number": [0, {"number": 8}]}},
    "s": "one,two,three",
    "empty": [],
    "deep": {"name": {"name": {"name": "x"}}},
    "flag": True,
}
PATHS = [
    "$", "$.phones", "$.phones[*]", "$.phones[*].number", "$.phones[0]", "$.phones[-1]", "$.phones[9]", "$.phones[1:]", "$.phones[:-3].name",
    "$.phones[-3:2]", "$.phones[:]", '$.phones[?name = "adam"].number', '$.phones[?(@.price >= 20)].name', "$.phones[?price < 50].price",
    '$.phones[?name =~ "^(a|e)"].name', '$.phones[?name != "eve"]', '$.phones[?at.city == "Brno"].name', "$.phones[?number > 1]", '$.phones[?number = "3"].name',
    "$.phones[0:3][?price > 1]", "$.a-b", '$.a-b["x y"].number[1].number', "$..number", "$..name", "$.deep..name", "$..at..city", "$..nothing", "$.phones.`len`",
    "$.s.`len`", "$.deep.`keys`", "$.s.`split(,, 1, -1)`", "$.s.`split(,, -1, 1)`", "$.s.`split(,, 5, -1)`", "$.s.`sub(/o(.)/, \\1-)`", "$.flag.`len`", "$.flag",
    "$.empty[*]", "$.empty", "$.gone.x", "$.phones[*].tags[*]", "$.phones[*].tags[0]", "$.phones[0].`this`.name", "$.s[0]",
]


@pytest.fixture
def docs(spark):
    rows = [(1, json.dumps(DOC)), (2, "[]"), (3, "5"), (4, json.dumps({"phones": {"name": "adam"}}))]
    return spark.createDataFrame(rows, "db_id int, t string").select("db_id", F.parse_json("t").alias("doc"))


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.ord):
        out.setdefault((r.db_id, r.path), []).append(json.loads(r.value))
    return out


def test_every_form(spark, docs):
    source = {1: DOC, 2: [], 3: 5, 4: {"phones": {"name": "adam"}}}
    asked = spark.createDataFrame([(i, PATHS + ["NA"]) for i in source] + [(1, PATHS[:3]), (9, PATHS)], "db_id int, path_list array<string>")
    assert validate.check_requests(asked).where("NOT ok").count() == 0
    want = {(i, p): w for i, d in source.items() for p in PATHS if (w := walk(d, p))}
    got = answers(rq.fetch_any(docs, asked))
    wrong = {k: (want.get(k), got.get(k)) for k in want.keys() | got.keys() if want.get(k) != got.get(k)}
    assert not wrong, wrong
    assert rq.fetch_any(docs, asked.limit(0)).count() == 0 and rq.refused_paths(asked).count() == 0


def test_sorting(spark):
    r = random.Random(2)
    items = [{"p": r.choice([1, 2.5, 3]), "q": r.choice("abc"), "i": i} for i in range(30)] + [{"q": "a", "i": 30}, 4]
    docs = spark.createDataFrame([(1, json.dumps({"l": items}))], "db_id int, t string").select("db_id", F.parse_json("t").alias("doc"))
    asked = spark.createDataFrame([(1, ["$.l[\\p,/q][*].i", "$.l[/q][*].i", "$.l[\\q][0:3].i", "$.l[/p]"])], "db_id int, path_list array<string>")
    got = answers(rq.fetch_any(docs, asked))
    whole = sorted(items[:30], key=lambda x: (-x["p"], x["q"]))
    assert got[1, "$.l[\\p,/q][*].i"] == [x["i"] for x in whole] + [30]
    assert got[1, "$.l[/q][*].i"] == [x["i"] for x in sorted(items[:31], key=lambda x: x["q"])]
    assert got[1, "$.l[\\q][0:3].i"] == [x["i"] for x in sorted(items[:31], key=lambda x: -ord(x["q"]))][:3]
    assert len(got[1, "$.l[/p]"]) == 1 and got[1, "$.l[/p]"][0][-1] == 4


def test_odd_requests_harm_nobody(spark, docs, monkeypatch):
    monkeypatch.setattr(rq, "PATHS_PER_WALK", 3)
    bad = ["$.phones[?name", "$..", "no path", '$.phones[?name =~ "("].name', "$.s.`sub(/[/, x)`", "$.s.`sorted`", None]
    asked = spark.createDataFrame([(1, bad + ["$.s", *PATHS[:12]]), (3, None)], "db_id int, path_list array<string>")
    got = answers(rq.fetch_any(docs, asked))
    assert got[1, "$.s"] == [DOC["s"]] and len(got) == 1 + sum(bool(walk(DOC, p)) for p in PATHS[:12])
    assert {r.path for r in rq.refused_paths(asked).collect()} == {"$.phones[?name", "$..", "no path", "$.s.`sorted`"}


def test_a_level_is_one_explode_and_opens_a_value_once(spark):
    """Each level moves rows once, however many paths part there, and a sorted list is not opened for each element."""
    rows = [(1, json.dumps({"a": [{"x": (7 * i) % 50, "t": f"t{i % 3}", "b": {"x": i}} for i in range(300)], "x": [], "n": None}))]
    docs = spark.createDataFrame(rows, "db_id long, text string").select("db_id", F.parse_json("text").alias("doc"))
    paths = ["$.a[*].x", "$.a[\\x,/t][0:3].x", "$.a[-1].t", "$..x", "$.a", "$.a.`len`", "$.n"]
    asked = spark.createDataFrame([(1, paths)], "db_id long, path_list array<string>")
    out = rq.fetch_any(docs, asked, 5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    walk = [x for x in plan.splitlines() if "Generate explode" in x and "path_list" not in x]
    assert len(walk) == 5 + 1
    got = {}
    for r in out.orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append(json.loads(r.value))
    doc = json.loads(rows[0][1])
    ranked = sorted(doc["a"], key=lambda e: (-e["x"], e["t"]))
    assert got["$.a[*].x"] == [e["x"] for e in doc["a"]]
    assert got["$.a[\\x,/t][0:3].x"] == [e["x"] for e in ranked[:3]]
    assert got["$.a[-1].t"] == [doc["a"][-1]["t"]]
    below = [[]] + [v for e in doc["a"] for v in (e["x"], e["b"]["x"])]
    assert sorted(map(json.dumps, got["$..x"])) == sorted(map(json.dumps, below))
    assert got["$.a"] == [doc["a"]] and got["$.a.`len`"] == [300] and got["$.n"] == [None]
