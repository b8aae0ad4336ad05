"""Edits of list elements against a sequential replay."""

import json
import random
import re

from docmem.operators import fold as fo
from docmem.operators import matching

SCHEMA = "db_id string, seq bigint, path string, data string"


def replay(edits):
    """Lists of one owner; element edits touch the elements present at that time."""
    lists = {}
    for _, path, data in sorted(edits):
        value = json.loads(data)
        m = re.match(r'^\$\.(\w+)\[(?:\*|\?(\w+) = ("[^"]*"|\d+))\]\.(\w+)$', path)
        if not m:
            name = path[2:]
            if isinstance(lists.get(name), list):
                lists[name] += value if isinstance(value, list) else [value]
            else:
                lists[name] = value
            continue
        name, field, literal, target = m.groups()
        if not isinstance(lists.get(name), list):
            continue
        for element in lists[name]:
            if not isinstance(element, dict):
                continue
            if field and (field not in element or element[field] != json.loads(literal)):
                continue
            if isinstance(element.get(target), list):
                element[target] += value if isinstance(value, list) else [value]
            else:
                element[target] = json.loads(data)
    return lists


def test_update_matching_example(spark):
    rows = [
        ("a", 1, "$.phones", '[{"name": "adam", "number": 1}, {"name": "eve"}]'),
        ("a", 2, '$.phones[?name = "adam"].prefix', '"+420"'),
        ("a", 3, "$.phones", '{"name": "adam", "number": 2}'),
    ]
    out = fo.documents(matching.replay(spark.createDataFrame(rows, SCHEMA), nested=False)).collect()
    assert json.loads(out[0].doc) == {
        "phones": [
            {"name": "adam", "number": 1, "prefix": "+420"},
            {"name": "eve"},
            {"name": "adam", "number": 2},
        ]
    }


def test_random_element_edits_equal_sequential_replay(spark):
    rng = random.Random(3)
    rows = []
    for owner in range(120):
        for seq in range(rng.randint(2, 16)):
            name = rng.choice(["l", "m"])
            pick = rng.random()
            if pick < 0.5:
                element = {"id": rng.randint(0, 2), "who": rng.choice(["x", "it's"])}
                if rng.random() < 0.3:
                    element["tags"] = []
                data = [element] if rng.random() < 0.7 else element
                rows.append((str(owner), seq, f"$.{name}", json.dumps(data)))
            elif pick < 0.8:
                where = rng.choice(["?id = 1", '?who = "x"', '?who = "it\'s"', "?id = 2"])
                target = rng.choice(["tags", "note"])
                data = rng.choice([5, "s", ["t", None], {"k": [1]}])
                rows.append((str(owner), seq, f"$.{name}[{where}].{target}", json.dumps(data)))
            else:
                rows.append((str(owner), seq, f"$.{name}[*].tags", json.dumps(rng.choice([1, ["a", "b"]]))))
    want = {o: replay([r[1:] for r in rows if r[0] == o]) for o in {r[0] for r in rows}}
    want = {o: d for o, d in want.items() if d}
    out = fo.documents(matching.replay(spark.createDataFrame(rows, SCHEMA), nested=True)).collect()
    got = {r.db_id: json.loads(r.doc) for r in out}
    wrong = {o: (want.get(o), got.get(o)) for o in want.keys() | got.keys() if want.get(o) != got.get(o)}
    assert not wrong, list(wrong.items())[:2]
