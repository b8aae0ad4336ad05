"""Line dedup, Jaccard join, neighbours, components and the pipeline: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmem.llm import ann, graph, jaccard_join, line_dedup
from docmem.llm.text import WORD


def roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(90)]
    want = roots(700, edges)
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: want[x] for a, b in edges if a != b for x in (a, b)}


def sets(text):
    w = WORD.findall((text or "").encode().lower().decode())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y)


def brute(rows):
    s = [sets(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(s)) for j in range(i) if linked(s[i], s[j])]
    return s, roots(len(s), pairs)


def test_jaccard_join(spark, documents, empty):
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    s, root = brute(rows)
    ids = {}
    for (d, _), x in zip(rows, root):
        if d is not None:
            ids[x] = min(d, ids.get(x, d))
    key = lambda v: (v[0] is None, v[0] or 0, v[1], v[2] is None, v[2] or 0)
    want = sorted(((d, len(x), ids.get(r) if x else d) for (d, _), x, r in zip(rows, s, root)), key=key)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(documents).collect()), key=key)
    assert got == want
    assert jaccard_join.join(empty).count() == 0
    kept = jaccard_join.one_of_each(documents)
    assert kept.columns == documents.columns
    assert kept.count() == len({r for x, r in zip(s, root) if x}) + sum(not x for x in s)


def test_jaccard_chains_and_thresholds(spark, monkeypatch):
    """Chains of copies of copies, more than one round of pivots, and pairs just at the threshold."""
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    r = random.Random(3)
    rows = []
    for g in range(3):
        words = [f"w{r.randrange(10**6)}" for _ in range(60)]
        for i in range(25):
            words = words[:]
            words[r.randrange(60)] = f"w{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    for n in (1, 2, 4, 5, 8, 9, 10, 14):
        words = [f"v{n}x{j}" for j in range(n)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "more"]))]
    _, root = brute(rows)
    got = {x.doc_id: x.component_id for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == dict(enumerate(root))


def test_links_of_near_copies_are_no_pairs(spark):
    """A group of near copies is joined by about as many links as it has members."""
    sets_ = [np.array([*range(40), 1000 + i], np.uint64) for i in range(120)]
    rows = [(0, i, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets_)]
    points = spark.createDataFrame(rows, "part bigint, cls bigint, n bigint, x binary")
    found = [(x.a, x.b) for x in jaccard_join.links(points).collect()]
    assert roots(120, found) == [0] * 120
    assert len(found) < 2 * 120
    r = np.random.default_rng(4)
    for _ in range(50):
        link = r.random((30, 12)) < 0.08
        less = jaccard_join.joining(link)
        assert not (less & ~link).any() and less.sum() < 42
        assert roots(42, [(12 + i, j) for i, j in np.argwhere(less)]) == roots(42, [(12 + i, j) for i, j in np.argwhere(link)])


def test_jaccard_short_texts(spark):
    """Texts of few shingles, all of which may fall outside the sample, and the same with one word more."""
    rows = []
    for n in (8, 9, 10):
        for i in range(100):
            words = [f"v{n}x{i}x{j}" for j in range(n)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words, "more"]))]
    got = {x.doc_id: x.component_id for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(rows))}


def test_line_links(spark, documents):
    r = random.Random(2)
    base = [" ".join(f"word{r.randrange(5000)}" for _ in range(25)) for _ in range(30)]
    near = []
    for t in base:
        for _ in range(3):
            words = t.split()
            words[r.randrange(25)] = "changed"
            near.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate([*base, *near, "tiny", "a b"])]
    got = {tuple(sorted((x.a, x.b))) for x in line_dedup.links(spark.createDataFrame(rows, "node bigint, text string")).collect()}
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if line_dedup.similar(rows[i][1], rows[j][1])]
    assert {(j, i) for i, j in pairs} >= got
    assert roots(len(rows), got) == roots(len(rows), pairs)


def edited_lines(seed):
    """Five random trees and a chain of 200 lines, each a copy of another line with one word changed."""
    r = random.Random(seed)
    word = lambda: f"word{r.randrange(10**5)}"
    out = []
    for family in range(6):
        lines = [[word() for _ in range(25)]]
        while len(lines) < 200:
            words = list(lines[-1] if family == 5 else r.choice(lines))
            words[r.randrange(25)] = word()
            lines.append(words)
        out += [" ".join(x) for x in lines]
    r.shuffle(out)
    return out


def same_parts(got, want):
    return len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("group", [16384, 20])
def test_line_links_of_edited_lines(spark, monkeypatch, group):
    """Components are those of brute force, in one task and over rounds."""
    monkeypatch.setattr(line_dedup, "GROUP", group, raising=False)
    texts = edited_lines(1)
    got = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").coalesce(1)
    got = [(x.a, x.b) for x in line_dedup.links(got).collect()]
    shingles = [{t[i : i + line_dedup.SHINGLE] for i in range(len(t) - line_dedup.SHINGLE + 1)} for t in texts]
    pairs = [(i, j) for i, x in enumerate(shingles) for j, y in enumerate(shingles[:i]) if 100 * len(x & y) >= line_dedup.SIMILAR * len(x | y)]
    assert set(got) | {(b, a) for a, b in got} <= {*pairs, *((j, i) for i, j in pairs)}
    assert same_parts(roots(len(texts), got), roots(len(texts), pairs))


def test_typos_and_outer_blanks(spark):
    """A line of 60 characters with one wrong is a copy, and so is a line with other blanks around it."""
    r = random.Random(6)
    base = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(100)]
    typo = [t[:30] + "#" + t[31:] for t in base]
    rows = list(enumerate([*base, *typo]))
    got = {tuple(sorted((x.a, x.b))) for x in line_dedup.links(spark.createDataFrame(rows, "node bigint, text string")).collect()}
    assert got == {(i, 100 + i) for i in range(100)}
    docs = spark.createDataFrame([(0, 1, "ab\n\t \n\x0b\r\n"), (1, 2, " ab\r"), (2, 3, "\t ab \x0c\x0b "), (3, 4, "\r\n")], "uid bigint, doc_id bigint, text string")
    assert sorted((x.uid, x.line, x.text) for x in line_dedup.lines(docs).collect()) == [(0, 0, "ab"), (1, 0, "ab"), (2, 0, "ab")]


def test_line_dedup(spark, tmp_path, empty):
    docs = [
        (2, "The same line of text, again and again.\nonly here", 0),
        (1, "the same line of text, again and again.\n\nanother of its own", 0),
        (3, "The same line of text, again and again!", 0),
        (4, None, 0),
        (5, " \n", 0),
        (None, "only here\nnull id", 0),
    ]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(docs, "doc_id bigint, text string, _uid int").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    out = line_dedup.without_duplicates(df)
    assert out.columns == df.columns
    got = {x.doc_id: x.text for x in out.collect()}
    assert got == {1: docs[1][1], 2: "only here", 4: None, 5: " \n", None: "null id"}
    told = {x.doc_id: (x.n_lines, x.removed) for x in line_dedup.report(df).collect()}
    assert told == {1: (3, []), 2: (2, [0]), 3: (1, [0]), 4: (0, []), 5: (2, []), None: (2, [0])}
    assert line_dedup.report(empty).count() == 0 and line_dedup.without_duplicates(empty).count() == 0


def test_neighbours(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((3000, 64))
    v[50:60] = v[0] + 0.05 * r.standard_normal((10, 64))
    v[100:140] = v[99]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(5000, None), (5001, [0.0] * 64), (5002, [float("nan")] * 64), (5003, [1.0, None]), (5004, [2.0, 1.0]), (None, v[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for x in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(got) == set(range(0, 3000, 50))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = np.round(unit @ unit[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5]
        found.sort()
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(score - unit[i] @ unit[q]) < 1e-12 for _, i, score in found)
        hit += len({i for _, i, _ in found} & set(want.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    ties = [i for _, i, _ in sorted(got[100])]
    assert ties == [99, 101, 102, 103, 104]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    in_passes = ann.nearest(df, F.col("vec_id") % 50 == 0, pass_bytes=10_000)
    assert sorted(map(str, in_passes.collect())) == sorted(map(str, ann.nearest(df, F.col("vec_id") % 50 == 0).collect()))


def test_neighbours_in_narrow_windows(spark):
    """Recall where windows are really a 64th of a curve, and vectors have no structure at all."""
    r = np.random.default_rng(9)
    v = r.standard_normal((20000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    got = {}
    for x in ann.nearest(df.repartition(4), F.col("vec_id") % 200 == 0).collect():
        got.setdefault(x.query_id, set()).add(x.vec_id)
    w = v.astype(float)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    hit = 0
    for q, found in got.items():
        s = w @ w[q]
        s[q] = -9
        hit += len(found & set(np.argsort(-s)[:5].tolist()))
    assert len(got) == 100 and hit >= 0.9 * 5 * len(got)


def test_repeated_and_huge_vectors(spark):
    rows = [(1, [1.0, 0.0])] + [(2, [1.0, 0.1])] * 40 + [(i, [1.0, float(i)]) for i in range(3, 9)]
    rows += [(20, [1e200, 1e200]), (21, [1e-200, 2e-200]), (0, [1.0, 0.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted(ann.nearest(df, F.col("vec_id") == 1).collect(), key=lambda x: x["rank"])
    want = sorted(((-np.cos(np.arctan(t)), i) for i, t in [(0, 0), (2, 0.1), (20, 1), (21, 2), (3, 3)]))
    assert [x.vec_id for x in got] == [i for _, i in want]
    assert np.allclose([x.score for x in got], [-s for s, _ in want], atol=1e-12)
    assert len({x.vec_id for x in ann.nearest(df, F.col("vec_id") == 0).collect()}) == 5


def test_pipeline(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    labels = documents.select("doc_id", F.when(F.length("text") > 100, 1).otherwise(0).alias("quality"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "source mix", "best-fit packing"]
    docs = documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        if i < 4:
            assert docs.columns == documents.columns
    assert docs.count() > 0
    by = docs.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert by.where("n > 4096").count() == 0


@pytest.mark.parametrize("pairs", [64, 3])
def test_groups_of_lines_by_sets(monkeypatch, pairs):
    """Groups of all sizes, by pairs and by turns, join what brute force joins; a filled-up line is not one that ends in NULs."""
    monkeypatch.setattr(line_dedup, "PAIRS", pairs)
    r = random.Random(9)
    lines = edited_lines(3)[:150] + ["ab", "ab\x00\x00\x00", "abc", "", "x" * 5, "x" * 400, "é" * 70 + "\U0001f600 end"]
    for n in (1, 2, 3, 5, 12, 40, len(lines)):
        texts = r.sample(lines, n)
        got = line_dedup.forest(*line_dedup.shingle_sets(texts))
        want = [(i, j) for i in range(n) for j in range(i) if line_dedup.similar(texts[i], texts[j])]
        assert {tuple(sorted(x)) for x in got} <= {(j, i) for i, j in want}
        assert same_parts(roots(n, got), roots(n, want))
        assert len(got) == n - len(set(roots(n, got)))  # no two pairs join the same


def test_group_of_equal_turns_is_cheap():
    """Hundreds of long lines that are all similar to the first are compared once each, not with one another."""
    base = " ".join(f"word{i}" for i in range(120))
    own, sketch = line_dedup.shingle_sets([f"{base} {i:04d}" for i in range(400)])
    got = line_dedup.forest(own, sketch)
    assert len(got) == 399 and {p for _, p in got} == {0}


def test_groups_part_at_gaps_of_size(spark, tmp_path):
    """Lines too different in size for any link leave a group, or part it; chains of near sizes stay whole."""
    texts = ["a" * 5 + "".join(chr(200 + i) for i in range(n)) for n in (100, 104, 110, 115, 400)]
    size = line_dedup.keys_and_sizes(texts)[1].astype(int)
    assert size[4] - size[3] >= line_dedup.GAP > size[3] - size[0]
    rows = [(1, 2, 40, 42), (1, 3, 40, 46), (1, 4, 40, 90), (1, 5, 40, 91), (6, 7, 10, 60), (8, 9, 10, 12)]
    path = str(tmp_path / "pairs")
    spark.createDataFrame(rows, "leader bigint, node bigint, leader_size smallint, size smallint").write.parquet(path)
    paired = line_dedup.tables.written(spark.read.parquet(path))
    got = {}
    for x in line_dedup.groups_by_size(paired).collect():
        got.setdefault(x.leader, set()).add(x.node)
    assert sorted(map(sorted, got.values())) == [[1, 2, 3], [4, 5], [8, 9]]
    for a in range(1, 400, 7):  # sizes of classes that leave a gap are never similar
        for b in range(a, 600, 11):
            near = [int(min(line_dedup.STEPS * line_dedup.np.log(x), 255)) for x in (a, b)]
            assert near[1] - near[0] < line_dedup.GAP or 100 * a < line_dedup.SIMILAR * b
