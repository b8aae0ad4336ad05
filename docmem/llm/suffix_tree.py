"""Language-model scoring with a probabilistic suffix tree.

Symbols are the characters of a text's lower-cased words, one blank between
words, and an end. A context of up to `DEPTH` symbols is kept if it occurs
`LEAST` times, whatever the size of the corpus, and if what follows it differs from what follows
its suffix: twice its divergence, a chi-square number when nothing differs, must
be beyond chance. The distribution of a kept context is smoothed towards that of
its longest kept suffix by the number of different symbols seen after it. A text
is scored symbol by symbol from the longest kept suffix of what came before;
contexts run on over word ends. The probability of a word by the tree is mixed
with that of the unigram base, which knows whole words, as the last smoothing.

Counts cover all training texts. The counting, the divergence tests and the smoothing are
joins in Spark over the distinct grams of all texts: one that only held-out texts have is
carried with count 0 and so gets what the contexts above it leave to unseen symbols. No task
holds the tree. Texts come in runs of some `RUN` bytes, whose distinct grams ask the bucket
of their hash for their probabilities; the answers meet the run again, which is scored with
no more than its own grams.

The unigram base needs the exact count of every word of the corpus, which no
bound holds. Words of at least `HEAVY` of all tokens (at most `1 / HEAVY` of
them) are broadcast with their counts. All others travel to the bucket of their hash, are
counted there, and send their part of each text's sum back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, tables
from .text import give_back, lower_words, text_runs

DEPTH = 5
LEAST = 4
HEAVY = 1e-6
WEIGHT = 0.3  # of the unigram base in the mixture
FLUSH = 1_000_000  # counts a task holds, some 24 MB, and the copies of a merge

RUN = 32 << 20  # bytes of text that are scored together, or one longer text

KEPT = 50_000  # word hashes a task remembers, some 10 MB

START, END = 0x110000, 0x110001  # beyond the last code point
SYMBOLS = 0x110002
FIELD = 21  # bits per symbol; a gram of six is two numbers of three symbols
MASK = (1 << FIELD) - 1


def held_out(doc_id: Column) -> Column:
    """Texts that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def symbols(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, each after `DEPTH` starts and with its end, and the number of symbols of each."""
    out, sizes = [], np.zeros(len(words), np.int64)
    lead, end = np.full(DEPTH, START, np.int32), np.array([END], np.int32)
    for i, w in enumerate(words):
        s = np.frombuffer(b" ".join(w).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<i4")
        out += (lead, s, end)
        sizes[i] = len(s) + 1
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes


def ends(sizes: np.ndarray) -> np.ndarray:
    """Places of the scored symbols in what `symbols` gives."""
    first = np.cumsum(sizes + DEPTH) - sizes
    return np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def keys_of(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of `DEPTH` + 1 symbols that ends at each scored symbol, in order: (high, low)."""
    s, sizes = symbols(words)
    at = ends(sizes)
    return _joined([s[at - i].astype(np.int64) for i in (3, 4, 5)]), _joined([s[at - i].astype(np.int64) for i in (0, 1, 2)])


def grams(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of `DEPTH` + 1 symbols of the texts: (high, low, count)."""
    s, sizes = symbols(words)
    if not len(s):
        return (np.zeros(0, np.int64),) * 3
    at = ends(sizes)
    seen = np.flatnonzero(np.bincount(s, minlength=SYMBOLS))
    bits = max(1, int(len(seen) - 1).bit_length())
    if bits * (DEPTH + 1) <= 63:  # the symbols of the batch, numbered anew, fit one number
        number = np.zeros(SYMBOLS, np.int64)
        number[seen] = np.arange(len(seen))
        t = number[s]
        key = np.zeros(len(at), np.int64)
        for i in range(DEPTH, -1, -1):
            key = (key << bits) | t[at - i]
        key, n = np.unique(key, return_counts=True)
        part = [seen[(key >> (bits * i)) & ((1 << bits) - 1)].astype(np.int64) for i in range(DEPTH + 1)]
    else:
        wide = np.stack([s[at - i].astype(np.int64) for i in range(DEPTH + 1)])
        low, high = _joined(wide[:3]), _joined(wide[3:])
        order = np.lexsort((low, high))
        low, high = low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        return high[first], low[first], np.diff(np.append(first, len(low)))
    return _joined(part[3:]), _joined(part[:3]), n


def _joined(parts) -> np.ndarray:
    """Symbols, newest first, as one number with the newest in the lowest bits."""
    out = np.zeros(len(parts[0]), np.int64)
    for i, p in enumerate(parts):
        out |= p << (FIELD * i)
    return out


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def hashed(words: list[list[bytes]], table: WordHash) -> np.ndarray:
    total = sum(map(len, words))
    if len(table) > KEPT:
        table.clear()
    return np.fromiter((table[w] for ws in words for w in ws), np.uint64, total)


ENDING = 1  # stands for the end among the word hashes


def corpus_counts(train: DataFrame) -> DataFrame:
    """(kind, high, low, n): exact counts of words (kind 0, hash in low) and grams (kind 1) of the texts.

    Texts with `held_out`, if there is such a column, give their grams with count 0.
    """
    held = F.col("held_out") if "held_out" in train.columns else F.lit(False)

    def run(batches):
        table = WordHash()

        def rows(kind, high, low, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), kind, np.int8)), pa.array(high), pa.array(low), pa.array(n.astype(np.int64))],
                names=["kind", "high", "low", "n"],
            )

        held: list[tuple[np.ndarray, ...]] = []
        held_words: list[tuple[np.ndarray, np.ndarray]] = []

        def joined(parts):
            high, low, n = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((low, high))
            high, low, n = high[order], low[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            return high[first], low[first], np.add.reduceat(n, first)

        def send(final):
            nonlocal held, held_words
            if held and (final or sum(len(h[0]) for h in held) > FLUSH):
                held = [joined(held)]
                if final or 2 * len(held[0][0]) > FLUSH:
                    yield rows(1, *held.pop())
            if held_words and (final or sum(len(h[0]) for h in held_words) > FLUSH):
                w, n = (np.concatenate(c) for c in zip(*held_words))
                w, at = np.unique(w, return_inverse=True)
                held_words = [(w, np.bincount(at, n).astype(np.int64))]
                if final or 2 * len(w) > FLUSH:
                    w, n = held_words.pop()
                    yield rows(0, np.zeros(len(w), np.int64), w.view(np.int64), n)

        for b in batches:
            unread = b.column("held").to_pylist()
            for lo, texts in text_runs(b.column("text")):
                words = [lower_words(t) for t in texts]
                kept = [w for w, u in zip(words, unread[lo:]) if not u]
                if kept:
                    h = np.append(hashed(kept, table), np.full(len(kept), ENDING, np.uint64))
                    held_words.append(np.unique(h, return_counts=True))
                    held.append(grams(kept))
                if len(kept) < len(words):
                    high, low, n = grams([w for w, u in zip(words, unread[lo:]) if u])
                    held.append((high, low, np.zeros_like(n)))
                yield from send(False)
        yield from send(True)

    made = train.select("text", held.alias("held")).mapInArrow(run, "kind tinyint, high bigint, low bigint, n bigint")
    return tables.written(made.groupBy("kind", "high", "low").agg(F.sum("n").alias("n")))


def _newest(level: int) -> tuple[Column, Column]:
    """The newest `level` + 1 symbols of (high, low)."""
    if level >= 3:
        return F.col("high").bitwiseAND((1 << (FIELD * (level - 2))) - 1), F.col("low")
    return F.lit(0).cast("bigint"), F.col("low").bitwiseAND((1 << (FIELD * (level + 1))) - 1)


def levels(counts: DataFrame) -> list[DataFrame]:
    """For each length of context: (high, low, n, of, k, kept, p) of its grams, those of count 0 included.

    `n` counts the gram and `of` its context, `k` is the number of symbols seen after the
    context, `kept` tells whether the context is in the tree and `p` is the gram's probability.
    """
    by_level = {DEPTH: counts.where("kind = 1").select("high", "low", "n")}
    for level in range(DEPTH - 1, -1, -1):
        high, low = _newest(level)
        by_level[level] = tables.written(
            by_level[level + 1].groupBy(high.alias("high"), low.alias("low")).agg(F.sum("n").alias("n"))
        )
    root = by_level[0].agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    total, kinds = float(root[0] or 0), float(root[1])
    # what the seen symbols leave is shared by all others
    p = (F.col("n") + kinds / SYMBOLS) / (total + kinds) if kinds else F.lit(1.0 / SYMBOLS)
    out = [
        tables.written(
            by_level[0].select("high", "low", "n", F.lit(total).alias("of"), F.lit(kinds).alias("k"), F.lit(True).alias("kept"), p.alias("p"))
        )
    ]
    for level in range(1, DEPTH + 1):
        ph, pl = _newest(level - 1)
        parent = out[-1].select(
            F.col("high").alias("ph"), F.col("low").alias("pl"), F.when(F.col("n") > 0, F.col("of") / F.col("n")).alias("share"), F.col("p").alias("pp")
        )
        joined = by_level[level].withColumns({"ph": ph, "pl": pl}).join(parent, ["ph", "pl"])
        # sum n log(n / of * share), with the size of the context taken out of the sum: one window serves all
        context = Window.partitionBy("high", F.shiftright("low", FIELD))
        term = F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") * F.col("share")))
        joined = joined.withColumns(
            {
                "of": F.sum("n").over(context).cast("double"),
                "k": F.count_if(F.col("n") > 0).over(context).cast("double"),
                "t": F.sum(term).over(context),
            }
        )
        joined = joined.withColumn("g", 2 * (F.col("t") - F.when(F.col("of") > 0, F.col("of") * F.log("of"))))
        chance = (F.col("k") - 1) + 4 * F.sqrt(2.0 * (F.col("k") - 1)) + 10
        kept = (F.col("of") >= LEAST) & F.coalesce(F.col("g") > chance, F.lit(False))
        smooth = (F.col("n") + F.col("k") * F.col("pp")) / (F.col("of") + F.col("k"))
        out.append(
            tables.written(
                joined.withColumn("kept", kept).select("high", "low", "n", "of", "k", "kept", F.when(F.col("kept"), smooth).otherwise(F.col("pp")).alias("p"))
            )
        )
    tables.discard(*list(by_level.values())[1:])
    return out


def probabilities(counts: DataFrame) -> DataFrame:
    """(high, low, p): log10 probability of the newest symbol of each gram after the others."""
    found = levels(counts)
    tables.discard(*found[:-1])
    return found[-1].select("high", "low", F.log10("p").alias("p"))


class Lookup:
    """Open addressing over 64-bit keys; lookups work on whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << int(64 - self.shift)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == 0
            self.keys[at[left[free]]] = keys[left[free]]  # of several the last stays
            got = self.keys[at[left]] == keys[left]
            self.values[at[left[got]]] = values[left[got]]
            left = left[~got]
            at[left] = (at[left] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value)."""
        at = self._home(keys)
        there = self.keys[at]
        found = there == keys
        left = np.flatnonzero(~found & (there != 0))
        mask = len(self.keys) - 1
        while len(left):
            at[left] = (at[left] + 1) & mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            found[left[hit]] = True
            left = left[~hit & (there != 0)]
        return found, self.values[at]


class Answers:
    """Probabilities of the grams of a run, by a hash that tells them all apart."""

    def __init__(self, high: np.ndarray, low: np.ndarray, p: np.ndarray):
        order = np.lexsort((low, high))
        high, low, p = high[order], low[order], p[order]
        first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))[: len(high)]
        high, low, p = high[first], low[first], p[first]
        draw = np.random.default_rng(1)
        while True:
            self.factors = draw.integers(1, 2**63, 2, np.int64).astype(np.uint64) | np.uint64(1)
            keys = self._key(high, low)
            if len(np.unique(keys)) == len(keys):
                break
        self.table = Lookup(keys, p)

    @classmethod
    def of(cls, found: list[bytes]) -> Answers:
        parts = [blocks.unsqueezed(b, ["<i8", "<i8", "<f8"]) for b in found] or [[np.zeros(0, np.int64)] * 2 + [np.zeros(0)]]
        return cls(*(np.concatenate(x) for x in zip(*parts)))

    def _key(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = high.astype(np.uint64) * self.factors[0] + low.astype(np.uint64) * self.factors[1]
            return (key ^ (key >> np.uint64(32))) | np.uint64(1 << 63)  # 0 marks a free place

    def log10s(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        found, p = self.table.find(self._key(high, low))
        if not found.all():
            raise ValueError("grams without an answer")
        return p


def token_starts(s: np.ndarray) -> np.ndarray:
    """Which symbols begin a token: the first of a word, and the end. A blank belongs to the word before it."""
    before = np.concatenate([[START], s[:-1]])
    return ((before == 32) | (before == START) | (s == END)) & (s != START)


def mixed(base: np.ndarray, tree: np.ndarray, weight: float) -> np.ndarray:
    """log10 of the two models' probabilities of a token, mixed by weight."""
    return np.log10(weight * np.power(10.0, base) + (1 - weight) * np.power(10.0, tree))


def run_of(size: int, count: int, cores: int) -> Column:
    """The run of a row: neighbours of one scan task, some `RUN` bytes of them, at most four times that.

    It is a function of the row's id and size alone. Texts far above the mean size have
    runs of their own, of fewer rows. Small inputs are cut finer, to have work for all cores.
    """
    most = min(RUN, max(1 << 20, size // (2 * cores)))
    mean = max(1, size // max(1, count))
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    part, place = F.shiftright("uid", 33), F.col("uid").bitwiseAND((1 << 33) - 1)
    kind, rows = F.lit(-1), F.lit(1)
    for i in range(5, -1, -1):
        fits = length <= 4 * mean * 16**i
        kind = F.when(fits, i).otherwise(kind)
        rows = F.when(fits, max(1, most // mean // 16**i)).otherwise(rows)
    return F.concat_ws(".", part, kind, F.floor(place / rows).cast("bigint"))


def asked(rows: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(run, block): the probabilities of the grams of each run of `rows`, packed as (high, low, p).

    Every gram of the texts is among `known`, each once.
    """
    buckets = blocks.buckets_for(2 * size)
    both = rows.select("run", "text", F.lit(None).cast("bigint").alias("high"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("double").alias("p")).unionByName(
        known.select(F.lit(None).cast("string").alias("run"), F.lit(None).cast("string").alias("text"), "high", "low", "p")
    )

    def dealt_out(run, arrays):
        high, low = arrays[0], arrays[1]
        with np.errstate(over="ignore"):
            mix = (high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (low.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            bucket = ((mix >> np.uint64(29)) % np.uint64(buckets)).astype(np.int64)
        for to, at in blocks.by_bucket(bucket) if len(high) else ():
            yield to, run, blocks.squeezed([a[at] for a in arrays])

    def of_texts(b):
        runs = np.asarray(b.column("run").to_pylist(), object)
        for run in dict.fromkeys(runs):
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for _, texts in text_runs(b.column("text").take(pa.array(np.flatnonzero(runs == run)))):
                held.append(grams([lower_words(t) for t in texts])[:2])
            high, low = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            yield from dealt_out(run, (high[first], low[first]))

    def send(batches):
        for b in batches:
            if not b.num_rows:
                continue
            if b.column("run")[0].as_py() is None:
                high, low, p = (b.column(c).to_numpy() for c in ("high", "low", "p"))
                order = np.lexsort((low, high))
                made = dealt_out(None, (high[order], low[order], p[order]))
            else:
                made = of_texts(b)
            for bucket, run, block in made:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int32()), pa.array([run], pa.string()), pa.array([block], pa.binary())],
                    names=["bucket", "run", "block"],
                )

    def answer(group: pa.Table) -> pa.Table:
        runs, found = group.column("run").to_pylist(), group.column("block").to_pylist()
        told = Answers.of([x for r, x in zip(runs, found) if r is None])
        out = []
        for run, block in zip(runs, found):
            if run is not None:
                high, low = blocks.unsqueezed(block, ["<i8", "<i8"])
                out.append((run, blocks.squeezed([high, low, told.log10s(high, low)])))
        give_back()
        return pa.table(
            [pa.array([r for r, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["run", "block"]
        )

    sent = both.mapInArrow(send, "bucket int, run string, block binary")
    return sent.groupBy("bucket").applyInArrow(answer, "run string, block binary")


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
# a text's sums: its row, what they are, doc_id, held out, tokens, known tokens, base, score
SUMS = ["<i8"] * 6 + ["<f8"] * 2
NAMELESS, PART = 1, 2  # a text without doc_id; the part of a text from rare words


def score(docs: DataFrame, heavy: float = HEAVY, weight: float = WEIGHT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of documents (doc_id, text).

    A token's probability is a mixture of the tree's (product over its symbols) and
    of the unigram base. NULL, empty and blank texts are an end alone. A NULL doc_id
    is not held out. Repeated rows are learned and scored as often as they occur.
    `docs` must be a plain read of stored tables, whose rows come in the same order
    each time.
    """
    rows = tables.dealt(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("bigint").alias("doc_id"),
            held_out(F.col("doc_id")).alias("held_out"),
            F.col("text").cast("string").alias("text"),
        )
    )
    spark = docs.sparkSession
    size, texts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    rows = rows.withColumn("run", run_of(size, texts, int(spark.sparkContext.defaultParallelism)))
    counts = corpus_counts(rows)
    n, v = counts.where("kind = 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    n = int(n or 0)
    per_token = float(np.log10(n + v + 1))
    # at most 1 / heavy words
    common = counts.where("kind = 0").where(F.col("n") >= max(1.0, heavy * n)).select("low", "n").toArrow().to_pandas()
    keys, values = common["low"].to_numpy(np.int64).view(np.uint64), np.log10(common["n"].to_numpy(float) + 1)
    sent = spark.sparkContext.broadcast(Lookup(keys, values))
    buckets = blocks.buckets_for(size * 0.6)

    def cut(batch: pa.Table, answers: Answers):
        """Sums of common words go to a bucket of texts, rare words to the bucket of their hash."""
        table = WordHash()
        known = sent.value
        for b in batch.to_batches():
            uids = b.column("uid").to_numpy()
            names = b.column("doc_id").to_pylist()
            held = np.asarray(b.column("held_out").to_pylist(), np.int64)
            for lo, texts in text_runs(b.column("text")):
                words = [lower_words(t) for t in texts]
                m = len(words)
                sizes = np.array([len(w) + 1 for w in words])
                h = hashed([[*w, b"\n"] for w in words], table)
                h[np.cumsum(sizes) - 1] = ENDING
                hit, value = known.find(h)
                s, lengths = symbols(words)
                token = np.cumsum(token_starts(s)[ends(lengths)]) - 1
                by_tree = np.bincount(token, answers.log10s(*keys_of(words)), len(h))
                doc = blocks.spans(sizes)
                base = value[hit] - per_token
                yield buckets + int(uids[lo]) % buckets, blocks.packed(
                    [
                        uids[lo : lo + m],
                        np.array([x is None for x in names[lo : lo + m]], np.int64),
                        np.array([x or 0 for x in names[lo : lo + m]], np.int64),
                        held[lo : lo + m],
                        sizes,
                        np.bincount(doc, hit, m).astype(np.int64),
                        np.bincount(doc[hit], base, m),
                        np.bincount(doc[hit], mixed(base, by_tree[hit], weight), m),
                    ]
                )
                rare = ~hit
                h, owners, by_tree = h[rare], (doc + lo)[rare], by_tree[rare]
                for bucket, at in blocks.by_bucket((h % np.uint64(buckets)).astype(np.int64)) if len(h) else ():
                    owner, per = np.unique(owners[at], return_counts=True)
                    yield bucket, blocks.packed([uids[owner] * 2 + held[owner], per.astype("<u4"), h[at], by_tree[at]])

    def meet(texts: pa.Table, answered: pa.Table) -> pa.Table:
        answers = Answers.of(answered.column("block").to_pylist())
        made = list(cut(texts, answers))
        give_back()
        return pa.table(
            [pa.array([b for b, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["bucket", "block"]
        )

    def merge(bucket, found):
        """Sums of texts pass on as they are; rare words give one block of sums per text."""
        if bucket >= buckets:
            return pa.table({"block": pa.array(found, pa.binary())})
        uid, per, h, by_tree = blocks.gathered(found, ["<i8", "<u4", "<u8", "<f8"])
        doc = blocks.spans(per)
        name, number = np.unique(h, return_inverse=True)
        c = np.bincount(number, uid[doc] % 2 == 0, len(name))[number]
        base = np.log10(c + 1) - per_token
        owner, at = np.unique(uid[doc] // 2, return_inverse=True)
        zero = np.zeros(len(owner), np.int64)
        sums = [
            owner,
            zero + PART,
            zero,
            zero,
            zero,
            np.bincount(at, c > 0).astype(np.int64),
            np.bincount(at, base),
            np.bincount(at, mixed(base, by_tree.astype(float), weight)),
        ]
        return pa.table({"block": pa.array([blocks.packed(sums)], pa.binary())})

    def deal(batches):
        for b in batches:
            for block in b.column("block").to_pylist():
                arrays = blocks.unpacked(block, SUMS)
                for bucket, at in blocks.by_bucket(arrays[0] % buckets):
                    yield bucket, blocks.packed([x[at] for x in arrays])

    def total(_, found):
        uid, what, name, held, size, known, base, mix = blocks.gathered(found, SUMS)
        owner, at = np.unique(uid, return_inverse=True)
        own = np.flatnonzero(what != PART)
        first = np.zeros(len(owner), np.int64)
        first[at[own]] = own
        return pa.table(
            [
                pa.array(name[first], mask=what[first] == NAMELESS),
                pa.array(held[first] == 1),
                pa.array(size[first]),
                pa.array(np.bincount(at, known).astype(np.int64)),
                pa.array(np.bincount(at, base)),
                pa.array(np.bincount(at, mix)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    def meet_words(group: pa.Table) -> pa.Table:
        out = merge(group.column("bucket")[0].as_py(), group.column("block").to_pylist())
        give_back()
        return out

    answered = asked(rows, probabilities(counts), size)
    cuts = rows.groupBy("run").cogroup(answered.groupBy("run")).applyInArrow(meet, "bucket int, block binary")
    parts = cuts.groupBy("bucket").applyInArrow(meet_words, "block binary")
    done = blocks.exchange(parts, deal, total, RESULT)
    return done.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
