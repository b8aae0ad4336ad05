"""Reply trees, turn repair, fill-in-middle: against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docmem.llm import fill_in_middle, queries, reply_trees, turn_repair

from conftest import text

CONTROL = ["</s>", "[INST]", r"[\INST]", r"<\\/s>", "[/INST] [INST] x", "[ROLE]", "[/TURN]", "<s>", "<", "[", r"[\\", "a</s", " [/INST]", "", " ", "é🙂</s>\n[SYS]"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- reply trees -----------------------------------------------------------------


def forest(r, trees=12):
    """(tree, id, parent, role, text, score) with wide, deep and broken trees."""
    rows = []
    for t in range(trees):
        n = r.randint(1, 40)
        for i in range(n):
            parent = None if i == 0 or r.random() < 0.03 else (i - 1 if t % 3 == 0 else r.randrange(i))
            rows.append((t, i, parent, r.choice(["user", "assistant", "system", "tool", None]), r.choice([*CONTROL, None, text(r, 5)]), r.choice([0.0, 1.0, 2.5, None])))
    rows += [(50, 1, 2, "user", "a", 1.0), (50, 2, 1, "user", "b", 1.0), (50, 3, 2, "user", "c", 9.0)]  # a cycle and a reply to it
    rows += [(51, 1, 99, "user", "orphan", 1.0), (None, None, None, "user", "no id", 1.0), (52, 7, 7, "user", "own parent", 1.0)]
    rows += [(53, 0, None, "user", "same", 1.0)] * 3 + [(53, 1, 0, "assistant", "b", None), (53, 1, 0, "assistant", "a", None)]
    return rows


def chosen(rows, keep):
    """{(tree, leaf): (rank, score, turns)} by walking up from every leaf."""
    one = {}
    for t, i, p, role, said, s in rows:
        a = one.setdefault((t, i), [(p is not None, p or 0, s or 0.0), (role or "", said or "")])
        a[0] = min(a[0], (p is not None, p or 0, s or 0.0))
        a[1] = min(a[1], (role or "", said or ""))
    up = {k: (k[0], v[0][1]) for k, v in one.items() if v[0][0] and (k[0], v[0][1]) in one}
    found = defaultdict(list)
    for leaf in one.keys() - set(up.values()):
        path, k = [leaf], leaf
        while k in up and len(path) <= len(one):
            path.append(k := up[k])
        if len(path) <= len(one):
            found[leaf[0]].append((-sum(one[k][0][2] for k in path) / len(path), leaf[1], [one[k][1] for k in reversed(path)]))
    return {(t, x[1]): (i + 1, -x[0], x[2]) for t, v in found.items() for i, x in enumerate(sorted(v, key=lambda x: x[:2])[:keep])}


@pytest.mark.parametrize("keep", [1, 3])
def test_trees(spark, keep):
    rows = forest(random.Random(keep))
    kinds = "tree bigint, id bigint, parent bigint, role string, text string, score double, node string, leaf int, place int"
    df = spark.createDataFrame([(*x, "c", 1, 2) for x in rows], kinds).repartition(3)
    got = {
        (x.tree, x.leaf): x
        for x in reply_trees.conversations(df, df, keep)
        .withColumn("turns", reply_trees.turns_of(F.col("formatted")))
        .withColumn("learned", reply_trees.learned(F.col("formatted"), F.col("loss")))
        .collect()
    }
    want = chosen(rows, keep)
    assert got.keys() == want.keys()
    for k, (rank, score, turns) in want.items():
        x = got[k]
        assert x["rank"] == rank and abs(x.score - score) < 1e-9
        assert [(t.role, t.text) for t in x.turns] == turns
        assert x.learned == [s for role, s in turns if role == "assistant"]
        assert len(x.loss) == len(x.learned)
        for span in x.loss:
            assert x.formatted.encode()[span["first"] : span["first"] + span["bytes"]].decode() == x.formatted[span["start"] : span["end"]]
    assert {(x.tree, x.id) for x in reply_trees.rootless(df).collect()} == {(50, 1), (50, 2), (50, 3), (52, 7)}
    assert reply_trees.conversations(df.limit(0), df.limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    r = random.Random(1)
    parts = ["<", "[", "\\", "/", "s>", "INST]", "SYS]", "ROLE]", "TURN]", " ", "x", "\n"]
    rows = [("".join(r.choices(parts, k=r.randint(0, 9))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "t string").withColumn("e", reply_trees.escaped(F.col("t")))
    assert df.where(reply_trees.unescaped(F.col("e")) != F.col("t")).count() == 0
    assert df.where(F.col("e").rlike(r"</?s>|\[/?(INST|SYS|ROLE|TURN)\]")).count() == 0
    assert df.select("e").distinct().count() == df.select("t").distinct().count()


@pytest.fixture
def chats(spark, tmp_path):
    """A folder with a table of odd conversations."""

    def store(rows):
        at = tmp_path / f"c{len(list(tmp_path.iterdir()))}"
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, row int, tree string")
        df.repartition(3).write.parquet(str(at / "conversations.parquet"))
        return str(at)

    return store


def odd_chats(r, convs=60):
    rows = []
    for c in [None, *range(convs)]:
        turns = list(range(r.choice([1, 2, 5, 8, 90 if c == 3 else 4])))
        for t in turns:
            role = r.choice(["system", "user", "assistant", "tool", None, ""]) if r.random() < 0.15 else ("user", "assistant")[t % 2]
            said = r.choice([*CONTROL, None]) if r.random() < 0.2 else f"Said {r.randint(0, 9)}{r.choice(['.', '!', '', '? '])}"
            rows.append((c, None if r.random() < 0.03 else t, role, said, 1, "x"))
    return rows + rows[:3] + [rows[-1]] * 2


def test_chat_query(spark, chats):
    rows = odd_chats(random.Random(3))
    got = {x.conv_id: x for x in queries.QUERIES["op11_reply_trees"](spark, chats(rows)).collect()}
    by = defaultdict(list)
    for c, t, role, said, *_ in rows:
        by[c].append((t, role, said))
    by[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == by.keys()
    for c, turns in by.items():
        x = got[c]
        assert x.n_turns == len(turns)
        assert x.loss_chars == sum(len(s or "") for _, role, s in turns if role == "assistant")
        keys = [(t is not None, t or 0, role is not None, role or "") for t, role, _ in turns]
        if len(set(keys)) == len(keys):
            turns = [turns[i] for i in sorted(range(len(turns)), key=keys.__getitem__)]
            assert x.turns_sha256 == sha("".join(f"{role or ''}\n{s or ''}\n" for _, role, s in turns))
            assert x.loss_sha256 == sha("".join(s or "" for _, role, s in turns if role == "assistant"))
    assert [x.conv_id for x in queries.QUERIES["op11_reply_trees"](spark, chats([])).collect()] == [-1]


# --- turn repair -----------------------------------------------------------------


def best_repair(letters, faults):
    """(cost, audit) by trying every edit, one row at a time, on every prefix length of the target."""
    n = len(letters)
    ends = []
    for system in (False, True):
        target = ("s" if system else "") + "ua" * (n + 3)
        now = {0: (0, "")}

        def put(d, j, cost, audit):
            if j not in d or (cost, audit) < d[j]:
                d[j] = (cost, audit)

        def inserts(d):
            for j in range(len(target)):
                if j in d and target[j] != "s":
                    put(d, j + 1, d[j][0] + 2, d[j][1] + "I")
            return d

        now = inserts(now)
        for c, f in zip(letters, faults):
            then = {}
            for j, (cost, audit) in now.items():
                put(then, j, cost + 3, audit + "D")
                if f not in (1, 2) and j < len(target):
                    if c == target[j]:
                        put(then, j + 1, cost + (f == 3), audit + "K")
                    if target[j] != "s":
                        if c != target[j]:
                            put(then, j + 1, cost + 2 + (f == 3), audit + "R")
            now = inserts(then)
        ends += [v for j, v in now.items() if (j % 2 == 0 if not system else j % 2 == 1 and j > 1)]
    return min(ends)


def test_repairs_are_cheapest(spark):
    r = random.Random(7)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8] * 60 + [20, 33, 70, 150]:
        letters = "".join(r.choice("uuuaaas?") if r.random() < 0.4 else "ua"[i % 2] for i in range(n))
        faults = bytes(r.choice([0, 0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert turn_repair.cheapest(letters.encode(), faults) == best_repair(letters, faults), (letters, faults)


def test_long_repair_uses_kept_rows():
    r = random.Random(8)
    letters = "".join("ua"[i % 2] for i in range(6000) if r.random() > 0.02)
    faults = bytes(r.choices([0, 1, 3], [90, 3, 3], k=len(letters)))
    cost, audit = turn_repair.cheapest(letters.encode(), faults)
    out = [c for c, e in zip(letters, audit.replace("I", "")) if e == "K"]
    assert len(audit.replace("I", "")) == len(letters) and len(out) > 5000
    price = {"D": 3, "R": 2, "I": 2, "K": 0}
    stays = [e for e in audit if e != "I"]
    assert cost == sum(price[e] for e in audit) + sum(f == 3 and e != "D" for f, e in zip(faults, stays))


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, said, *_ in rows:
        out[c]  # noqa: B018
        role, said = (" " if x is None else x for x in (role, said))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        said = "" if k == 1 else re.sub("[.!?]", "", said) if k == 2 else said
        out[c] += [(t, "user" if k == 4 else role, said)] * (2 if k == 3 else 1)
    return out


def want_report(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha256) of one conversation, rows in order."""
    seen, faults = set(), []
    for _, role, said in rows:
        bare = said.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, said) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, said))
    letters = "".join(role[:1] if role[:1] in ("s", "u", "a") else "?" for _, role, _ in rows)
    cost, audit = best_repair(letters, faults) if rows else (0, "")
    turns = [t for t, *_ in rows if t is not None]
    done, it = [], iter(rows)
    odd = sum(e != "D" for e in audit) % 2
    for e in audit:
        p = len(done)
        own = "system" if p < odd else ("user", "assistant")[(p - odd) % 2]
        if e == "I":
            done.append(f"{own}:")
            continue
        _, role, said = next(it)
        if e != "D":
            done.append(f"{role if e == 'K' else own}:{said}")
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(done))


def test_repair_query(spark, chats):
    rows = odd_chats(random.Random(4))
    got = {x.conv_id: x for x in queries.QUERIES["op12_turn_repair"](spark, chats(rows)).collect()}
    by = damaged(rows)
    assert got.keys() == by.keys()
    for c, said in by.items():
        keys = {(t, role, s) for t, role, s in said}
        if len({t for t, *_ in keys}) < len(keys):
            continue  # different rows of one turn: any fixed order will do
        said.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        x = got[c]
        assert (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit, x.repaired_sha256) == want_report(said), c
    assert queries.QUERIES["op12_turn_repair"](spark, chats([])).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 1, "user", "Still there?"), (2, 0, "system", "Be kind."), (3, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    audited = turn_repair.audits(df)
    got = [(x.conv_id, x.place, x.edit, x.role, x.text) for x in turn_repair.repaired(df, audited).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Still there?")]
    assert {x.conv_id: (x.cost, x.audit) for x in audited.collect()} == {1: (5, "KRD"), 2: (3, "D"), 3: (3, "D")}


# --- fill in the middle ----------------------------------------------------------


def fim(doc_id, s):
    s = s or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", s)
    n = len(units)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, e = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "plain" if not s or any(x in s for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
    out = {"plain": s, "psm": f"<P>{p}<S>{e}<M>{m}", "spm": f"<S>{e}<P>{p}<M>{m}"}[form]
    sizes = (None, None) if form == "plain" else (len(p), len(m))
    return (doc_id, n, form, *sizes, out, s)


def test_fill_in_middle(spark, documents, empty):
    r = random.Random(9)
    odd = [(1000 + i, x, "c") for i, x in enumerate(["x <P> y", "<S>", " ", "\n\n a", "a ", "é🙂 ü", text(r, 20000), "w" * 300_000, "a\x1cb c\x85d"] * 8)]
    docs = documents.select("doc_id", "text", "row").unionByName(spark.createDataFrame(odd, "doc_id bigint, text string, row string"))
    want = [fim(x.doc_id, x.text) for x in docs.collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[-1])
    placed = fill_in_middle.pieces(docs)
    got = [tuple(x) for x in fill_in_middle.digests(placed).collect()]
    full = [(*x[:5], sha(x[5]), sha(x[6])) for x in want]
    assert sorted(got, key=key) == sorted(full, key=key)
    texts = [tuple(x) for x in fill_in_middle.outputs(placed).collect()]
    assert sorted(texts, key=key) == sorted((x[:6] for x in want), key=key)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert fill_in_middle.digests(fill_in_middle.pieces(empty)).count() == 0


def test_long_texts_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "UNITS", 7)
    r = random.Random(10)
    rows = [(i, text(r, r.randint(1, 200))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    placed = fill_in_middle.pieces(df)
    assert placed.count() > 300
    got = sorted(tuple(x) for x in fill_in_middle.digests(placed).collect())
    assert got == sorted((*x[:5], sha(x[5]), sha(x[6])) for x in (fim(*y) for y in rows))
