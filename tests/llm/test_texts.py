"""Host rules, packing, classifier, suffix tree: against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docmem.llm import host_rules, packing, quality, queries, suffix_tree
from docmem.llm.text import WORD


def metrics(t):
    words = WORD.findall(t or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for v in windows.values() if len(v) > 1 for i in v for j in range(5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in t or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


TEXTS = [None, "", " ", "a b c d e f a b c d e", "x " * 40, "a\n\na\n \nb\na", "#1 <b> && | a", "a\u00a0b c\x1cd e", "p q r s t " * 3 + "z"]


@pytest.mark.parametrize("t", TEXTS)
def test_metrics(t):
    assert host_rules.measure(t) == metrics(t)


def test_hosts(spark, documents, empty):
    got = host_rules.judge(documents).collect()
    want = Counter((x.doc_id, metrics(x.text)) for x in documents.collect())
    assert Counter((x.doc_id, (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)) for x in got) == want
    for x in got:
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words)
        assert not (x.kept and x.base_failed)
    assert host_rules.judge(empty).count() == 0


def test_bad_host_loses_its_good_documents(spark):
    rows = [(i, "short", "bad") for i in range(300)] + [(1000 + i, " ".join(f"w{i}x{j}" for j in range(20)), "bad") for i in range(5)]
    rows += [(2000 + i, " ".join(f"v{i}x{j}" for j in range(20)), f"good{i % 9}") for i in range(300)] + [(3000, "one", "single")]
    got = {x.doc_id: x for x in host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[1000 + i].kept for i in range(5)) and all(got[2000 + i].kept for i in range(300))
    assert got[3000].host_kept  # one document does not condemn a host


def test_a_host_far_above_the_others_loses_its_documents(spark):
    """Its rate stays below one half; the others are alike."""
    full = lambda k: " ".join(f"w{k}x{j}" for j in range(20))
    rows = [(h * 1000 + i, "short" if i % 50 == h % 7 else full(h * 1000 + i), f"h{h}") for h in range(15) for i in range(200)]
    rows += [(90000 + i, "short" if i % 10 < 3 else full(90000 + i), "worse") for i in range(200)]
    rows += [(95000 + i, "short" if i < 2 else full(95000 + i), "few") for i in range(4)]
    got = host_rules.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    kept = {s: {x.host_kept for x in got if x.source == s} for s in {x.source for x in got}}
    assert kept.pop("worse") == {False}
    assert all(v == {True} for v in kept.values())
    assert not any(x.kept for x in got if x.source == "worse")


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_host_rules"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want


def test_word_ids_are_those_of_the_whole_text():
    words = packing.WordIds()
    texts = ["Hello, World! it's e\u0301t\u00e9 \u03a3\u03a3 \u0130 3.14 <|endoftext|> a<|endoftext|>b <|x", "x\u00a0y\u2003z \x1c q\x85r", "", "don't we'll 'S", "\u4e2d\u6587 \U0001f600 \u00aa\u00b5 A.B,c\u00b2"]
    for t, ids in zip(texts, words.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.whole.encode(t, add_special_tokens=False).ids


def test_parts_are_those_of_the_whole_text(monkeypatch):
    """Texts of Latin letters and ASCII, with every sign, mark and digit in many orders, also with hardly any memory."""
    r = random.Random(8)
    words = packing.WordIds()
    signs = [chr(c) for c in range(33, 127)] + [chr(c) for c in range(0xC0, 0x100)] + ["'s", "'S", "'ll", "'LL", "'re", "''", "<|endoftext|>", "<|", "the", "\u00d7", "12"]
    blanks = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "  "]
    texts = ["".join(r.choice(signs if r.random() < 0.8 else blanks) for _ in range(r.randint(0, 60))) for _ in range(800)]
    for most in (packing.CACHED, 3000):
        monkeypatch.setattr(packing, "CACHED", most)
        for i in range(0, len(texts), 50):
            for t, ids in zip(texts[i : i + 50], words.texts(texts[i : i + 50])):
                assert np.frombuffer(ids, "<u4").tolist() == words.whole.encode(t, add_special_tokens=False).ids, t


def test_frequent_words_are_not_forgotten(monkeypatch):
    """New words push out those that nothing asks for any more, so that frequent ones are cut up once."""
    monkeypatch.setattr(packing, "CACHED", 2 * 40 * packing.WORD_BYTES)
    words = packing.WordIds()
    model, asked = words.whole.model, []

    class Counted:
        def tokenize(self, shown):
            asked.append(shown)
            return model.tokenize(shown)

    words.model = Counted()
    if hasattr(words.parts, "model"):
        words.parts.model = words.model
    for i in range(20):
        fresh = " ".join("q" + "abcdefghij"[j % 10] * (1 + j // 10) + "klmnopqrstuvwxyzabcd"[i] for j in range(30))
        words.texts([f"every one of these, {fresh}"])
    assert asked.count("every") == asked.count("these") == 1


def test_packing(spark, documents, empty):
    length = 256
    pieces = packing.tokenize(documents, length=length)
    placed = packing.pack(pieces, length, open_bins=8, per_task=20).collect()
    docs = documents.select("doc_id", "text").collect()
    whole = packing.WordIds().whole
    want = Counter()
    for x in docs:
        ids = [*whole.encode(x.text or "", add_special_tokens=False).ids, 1]
        for i in range(0, len(ids), length):
            want[(x.doc_id, i // length, i, tuple(ids[i : i + length]))] += 1
    assert Counter((x.doc_id, x.piece, x.start, tuple(np.frombuffer(x.ids, "<u4").tolist())) for x in placed) == want
    by = defaultdict(list)
    for x in placed:
        assert x.length == len(x.ids) // 4
        by[x.sequence_id].append((x.offset, x.length))
    for v in by.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= length
    assert len(by) <= 1.15 * math.ceil(sum(x.length for x in placed) / length) + 1
    assert packing.pack(packing.tokenize(empty)).count() == 0
    joined = packing.sequences(documents.limit(20), length=length).collect()
    assert all(len(x.ids) <= 4 * length for x in joined)


def test_open_bins_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.add(s) for s in (6, 7, 5, 3, 5)] == [(0, 0), (1, 0), (2, 0), (0, 6), (2, 5)]
    assert bins.closed == {1, 2}


def test_classifier(spark, documents, empty):
    labels = documents.select("doc_id", F.when(F.length("text") > 300, 1).otherwise(0).alias("quality"))
    got = quality.classify(documents, labels).collect()
    held = [x for x in got if x.held_out]
    truth = {x.doc_id: int(len(x.text or "") > 300) for x in documents.collect()}
    assert len(got) == documents.count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got if x.doc_id is not None)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) >= 0.9
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(documents, labels.limit(0)).collect()
    assert {x.score for x in none} == {0.5}
    kept = quality.keep_good(documents, labels)
    assert kept.columns == documents.columns and 0 < kept.count() < documents.count()


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.uniform(-1, 1, (3000, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality.fit(x[:2000], y[:2000], n_pairs=2)
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_suffix_tree(spark, documents, empty):
    got = suffix_tree.score(documents).collect()
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [[*WORD.findall((t or "").encode().lower().decode()), None] for _, t in rows]
    seen = Counter(w for (d, _), ws in zip(rows, tokens) if not out(d) for w in ws)
    n, v = sum(seen.values()), len(seen)
    want = sorted(
        (d is None, d or 0, out(d), len(ws), sum(seen[w] > 0 for w in ws), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in ws), 6))
        for (d, _), ws in zip(rows, tokens)
    )
    assert sorted((x.doc_id is None, x.doc_id or 0, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert suffix_tree.score(empty).count() == 0


def brute_force_scores(rows, weight):
    """Scores of (doc_id, text) by a suffix tree in dictionaries, walked symbol by symbol."""
    depth, least = suffix_tree.DEPTH, suffix_tree.LEAST
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = {d: [*WORD.findall((t or "").encode().lower().decode()), None] for d, t in rows}
    symbols = {d: ["^"] * depth + [*" ".join(ws[:-1]), "$"] for d, ws in tokens.items()}
    after = defaultdict(Counter)
    for d, s in symbols.items():
        for i in range(depth, len(s)) if not out(d) else ():
            for level in range(depth + 1):
                after[tuple(s[i - level : i])][s[i]] += 1
    kinds, total = len(after[()]), sum(after[()].values())

    def kept(context):
        seen = after.get(context, {})
        of, k = sum(seen.values()), len(seen)
        if not context or of < least:
            return not context
        up = after[context[1:]]
        g = 2 * sum(n * math.log(n / of * sum(up.values()) / up[x]) for x, n in seen.items())
        return g > (k - 1) + 4 * math.sqrt(2 * (k - 1)) + 10

    tree = {c: kept(c) for c in list(after)}

    def p(context, x):
        if not context:
            return (after[()].get(x, 0) + kinds / suffix_tree.SYMBOLS) / (total + kinds)
        below = p(context[1:], x)
        if not tree.get(context):
            return below
        seen = after[context]
        of, k = sum(seen.values()), len(seen)
        return (seen.get(x, 0) + k * below) / (of + k)

    words = Counter(w for d, ws in tokens.items() if not out(d) for w in ws)
    n, v = sum(words.values()), len(words)
    scores = {}
    for d, ws in tokens.items():
        s, at, score = symbols[d], depth, 0.0
        for i, w in enumerate(ws):
            size = 1 if w is None else len(w) + (i + 2 < len(ws))
            spelt = math.prod(p(tuple(s[j - depth : j]), s[j]) for j in range(at, at + size))
            at += size
            score += math.log10(weight * (words[w] + 1) / (n + v + 1) + (1 - weight) * spelt)
        scores[d] = score
    return scores, sum(c != () and t for c, t in tree.items())


@pytest.mark.parametrize("run", [1 << 12, suffix_tree.RUN])
def test_scores_equal_a_tree_in_memory(spark, monkeypatch, run):
    draw = np.random.default_rng(5)
    names = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta-eta", "日本", "a", "theta\u00a0iota"]
    texts = [" ".join(draw.choice(names, int(draw.integers(0, 60)))) for _ in range(150)]
    texts += [None, "", " \n", "unseen Ж words", "x" * 5000, texts[3], texts[3]]
    rows = list(enumerate(texts))
    monkeypatch.setattr(suffix_tree, "RUN", run)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want, contexts = brute_force_scores(rows, suffix_tree.WEIGHT)
    assert contexts > 20
    assert len(got) == len(rows) and any(x.held_out for x in got)
    for x in got:
        assert x.score == pytest.approx(want[x.doc_id], abs=1e-9, rel=1e-9)


def test_nothing_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:5]
    got = suffix_tree.score(spark.createDataFrame([(i, "ab c") for i in held], "doc_id bigint, text string")).collect()
    assert len(got) == 5 and all(x.n_known == 0 and x.train_tokens == 0 and math.isfinite(x.score) for x in got)


def test_tree_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "abab abba abab ba" * (i % 3 + 1)) for i in range(40)], "doc_id bigint, text string")
    counts = suffix_tree.corpus_counts(docs)
    alphabet = [ord("a"), ord("b"), 32, suffix_tree.END]
    asked, grams = [], {}
    for context in ("ab ab", "bbbbb", "zzzab"):
        for s in (*alphabet, ord("q")):
            g = [s, *map(ord, reversed(context))]
            high, low = (sum(x << (suffix_tree.FIELD * i) for i, x in enumerate(part)) for part in (g[3:], g[:3]))
            grams[context, s] = (high, low)
            asked.append((1, high, low, 0))
    more = spark.createDataFrame(asked, counts.select("kind", "high", "low", "n").schema)
    both = counts.select("kind", "high", "low", "n").unionByName(more).groupBy("kind", "high", "low").agg(F.sum("n").alias("n"))
    assert sum(x.where("kept").select("high", F.shiftright("low", suffix_tree.FIELD)).distinct().count() for x in suffix_tree.levels(both)[1:]) > 3
    p = {(x.high, x.low): 10**x.p for x in suffix_tree.probabilities(both).collect()}
    for context in ("ab ab", "bbbbb", "zzzab"):
        got = [p[grams[context, s]] for s in (*alphabet, ord("q"))]
        total = sum(got[:4]) + got[4] * (suffix_tree.SYMBOLS - 4)
        assert total <= 1.0000001 and total > 0.6


def test_contexts_stay_in_a_large_corpus(spark):
    docs = spark.createDataFrame([(i, "abab abba abab ba" * (i % 3 + 1)) for i in range(12)], "doc_id bigint, text string")
    counts = suffix_tree.corpus_counts(docs)
    z = sum(ord("z") << (suffix_tree.FIELD * i) for i in range(3))
    more = spark.createDataFrame([(1, z, z, 10**9)], "kind tinyint, high bigint, low bigint, n bigint")
    kept = []
    for c in (counts, counts.unionByName(more)):
        # the suffix of a single symbol is the whole corpus, which changes
        found = suffix_tree.levels(c)
        kept.append(
            {(n, x.high, x.low >> suffix_tree.FIELD) for n in range(2, suffix_tree.DEPTH + 1) for x in found[n].where("kept").collect()}
        )
    assert kept[0] and kept[0] <= kept[1]
