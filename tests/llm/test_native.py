"""URL filters, mixing, shards: against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from docmem.llm import hilbert, mixing, queries, sharding, tables, url_filters
from docmem.llm.text import WORD


def test_urls(spark):
    urls = [
        ("http://WWW.Example.com/en/1?x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/9#t", "m.example.com", "/en/9", "example.com/en/", "block"),
        ("https://notexample.com/en/9", "notexample.com", "/en/9", "com/", "allow"),
        ("https://example.com", "example.com", "", None, "allow"),
        ("x://b.net/es/1", "b.net", "/es/1", "net/es/", "block"),
        ("x://b.net/en/1", "b.net", "/en/1", None, "allow"),
        ("http://ads-x.net/1", "ads-x.net", "/1", None, "block"),
        ("nothing", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http://a://b/c?d", "a:", "//b/c", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {x.page_id: x for x in url_filters.judge(pages, F.col("host").rlike("^ads")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)


def test_cascade_is_exact(spark):
    keys = spark.range(20000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("on"))
    out = url_filters.mark_listed(keys, "key", F.col("on"))
    assert out.where("listed <> on").count() == 0
    two = url_filters.mark_listed(keys, "key", F.col("on"), parts=3)
    assert two.where("listed <> on").count() == 0
    assert url_filters.mark_listed(keys.limit(0), "key", F.col("on")).count() == 0
    nothing = url_filters.mark_listed(keys.union(spark.sql("SELECT NULL, true")), "key", F.lit(False))
    assert nothing.where("listed").count() == 0


def test_a_list_of_keys_decides(spark, tmp_path):
    rows = [(0, "http://a.org/1"), (1, "http://b.org/1"), (1, "http://b.org/1"), (2, "http://b.com/1"), (3, None), (4, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    block = spark.createDataFrame([("b.org",), ("b.org",), ("b.com",), ("elsewhere.net",), (None,)], "host string")
    got = sorted((x.page_id, x.rule, x.verdict, x.listed) for x in url_filters.judge(pages, block).collect())
    want = [(0, None, "allow", False), (1, None, "block", True), (1, None, "block", True), (2, "com/", "allow", True), (3, None, "allow", False), (4, None, "allow", False)]
    assert got == want
    none = url_filters.judge(pages, block.limit(0))
    assert none.where("verdict = 'block'").count() == 0 and none.count() == len(rows)
    pages.limit(0).write.parquet(str(tmp_path / "p"))
    assert url_filters.judge(spark.read.parquet(str(tmp_path / "p")), block).count() == 0
    clash = spark.createDataFrame([("k", 1, 2, "old")], "key string, _h1 int, _H2 int, listed string")
    marked = url_filters.mark_listed(clash, "key", block.select(F.lit("k").alias("x"))).first()
    assert (marked["_h1"], marked["_H2"], marked["listed"]) == (1, 2, True)


def want_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(spark, documents, empty):
    rows = documents.select("doc_id", "text", "source").collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for x in rows:
        sizes[x.source] += size(x.text)
    want = want_targets(sizes)
    got = mixing.mix(documents).collect()
    assert len(got) == len(rows)
    assert Counter((x.doc_id, x.source, x.size) for x in got) == Counter((x.doc_id, x.source, size(x.text)) for x in rows)
    taken = defaultdict(int)
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source]) and x.source_size == sizes[x.source]
        assert 0 <= x.copies <= 3
        taken[x.source] += x.copies * x.size
    assert sum(taken.values()) > 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(documents.repartition(5)).collect()))
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mix_is_close_and_unbiased(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), (F.col("id") * 37 % 300 + 1).alias("size")
    )
    by = mixing.copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("g")).collect()
    for x in by:
        assert abs(x.t - x.g) < 0.005 * x.g


def test_hilbert_steps_to_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        points = np.stack(np.meshgrid(*[np.arange(side)] * dims), -1).reshape(-1, dims)
        key = hilbert.index_array(points, bits, hilbert.steps(dims))
        walk = points[np.argsort(key)]
        assert sorted(key) == list(range(side**dims))
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rows = [tuple(map(int, p)) for p in np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = df.select("*", hilbert.index_column([F.col("a"), F.col("b"), F.col("c")], 3).alias("k")).collect()
    want = hilbert.index_array(np.array([x[:3] for x in got]), 3, hilbert.steps(3))
    assert [x.k for x in got] == list(want)


def test_shards(spark, documents, empty):
    docs = documents.select("doc_id", "source", F.octet_length("text").alias("size"))
    got = sharding.shards(docs, ["source", "size"], 16, ("doc_id",)).collect()
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shards(empty.select("source", "doc_id"), ["source"], 16).count() == 0


def test_text_levels_compare_whole_values(spark):
    rows = [(i, f"https://a-long-common-beginning/{i % 8}") for i in range(800)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id bigint, source string")
    level = {x.source: x.curve for x in sharding.curve(df, ["source"], 3).collect()}
    names = sorted(s for s in level if s)
    assert len({level[s] for s in names}) >= 7
    assert [level[s] for s in names] == sorted(level[s] for s in names)  # in one dimension the curve is the order
    assert level[None] <= level[""] <= level[names[0]]


def test_shards_keep_clashing_columns(spark):
    rows = [(i, f"s{i % 3}", 7, "r", 1, 2, 3, 4, "c") for i in range(40)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, source string, total int, rank string, _tie int, _part int, _n int, _before int, curve string")
    got = sharding.shards(df, ["source"], 16, ("doc_id",))
    assert set(got.columns) == {*df.columns, "shard", "slot"}
    rows = got.collect()
    assert len(rows) == 80 and {(x.total, x["rank"], x._tie, x._part, x._n, x._before) for x in rows} == {(7, "r", 1, 2, 3, 4)}
    assert sorted(x.slot for x in rows if x.shard == 3) == list(range(5))


def test_shard_query_against_plain_python(spark, documents, tmp_path):
    documents.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op5_hilbert_shards"](spark, str(tmp_path)).collect()
    want = Counter()
    for x in documents.collect():
        data = (x.text or "").encode()
        want[(x.doc_id, len(data) + 1, zlib.crc32(data))] += 1
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == want
    by = defaultdict(list)
    for x in got:
        assert x.law == "rows" and x.grown_shard is None
        by[x.shard].append(x)
    counts = [len(by[s]) for s in range(16)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    along = [x.curve for s in range(16) for x in sorted(by[s], key=lambda x: x.slot)]
    assert along == sorted(along)


def test_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("w"))
    got = {x.v: x["rank"] for x in tables.ranked(df, "w", "v").collect()}
    assert got == {v: v for v in range(1000)}
