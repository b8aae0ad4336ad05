"""URL filters: explicit rules, and lists held as a cascade of Bloom filters.

A Bloom filter of the listed keys also passes some others. A cascade mends that
for a known universe: level 1 holds the listed keys, level 2 those others that
level 1 passes, level 3 the listed keys that level 2 passes, and so on until a
level passes nothing wrong. The first level that does not hold a key then gives
the exact answer, and no join with the list is needed.

The universe is the set of all keys of the corpus, so answers are exact for
every row of it. A level is made in Spark as words of bits (`bit_or` combines on
the map side) and its size is known before anything is collected: `BITS` per
key. `MAX_BYTES` bounds what is sent to executors; larger lists are
split by key hash into several cascades that are applied one after another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

BITS = 10
HASHES = 4
MAX_BYTES = 64 << 20
WORD = 60  # bits kept per word, so that words stay positive

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without `://`."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{rest}"))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit places of keys in a level: double hashing, moved by the level's number."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    mix = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    with np.errstate(over="ignore"):
        base, step = (h1 ^ mix) * np.uint64(0xBF58476D1CE4E5B9), h2 * (mix | np.uint64(1))
        base ^= base >> np.uint64(29)
        step ^= step >> np.uint64(31)
        return np.stack([(base + np.uint64(i) * (step | np.uint64(1))) % np.uint64(bits) for i in range(HASHES)])


def holds(words: np.ndarray, bits: int, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for p in places(h1, h2, level, bits):
        p = p.astype(np.int64)
        out &= (words[p // WORD] >> (p % WORD)) & 1 == 1
    return out


class Cascade:
    """Levels of one list: (number of bits, words)."""

    def __init__(self, levels: list[tuple[int, np.ndarray]]):
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: the first level without the key decides."""
        out = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for level, (bits, words) in enumerate(self.levels):
            if not len(open_):
                break
            held = holds(words, bits, level, h1[open_], h2[open_])
            out[open_[~held]] = level % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _level(spark, keys: DataFrame, level: int, bits: int) -> np.ndarray:
    def spread(batches):
        for b in batches:
            p = places(b["h1"].to_numpy(), b["h2"].to_numpy(), level, bits).ravel().astype(np.int64)
            yield pd.DataFrame({"word": p // WORD, "bit": np.int64(1) << (p % WORD)})

    made = keys.select("h1", "h2").mapInPandas(spread, "word bigint, bit bigint")
    rows = made.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow().to_pandas()  # at most bits / WORD rows
    words = np.zeros(bits // WORD + 1, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words


def cascade(keys: DataFrame, flag: str = "listed") -> Cascade:
    """A cascade from distinct keys (h1, h2, listed): the whole universe of the corpus."""
    spark = keys.sparkSession
    levels: list[tuple[int, np.ndarray]] = []
    inside, outside = keys.where(F.col(flag)), keys.where(~F.col(flag))
    while True:
        n = inside.count()
        if not n and levels:
            return Cascade(levels)
        bits = max(64, n * BITS)
        if bits // 8 > MAX_BYTES:
            raise ValueError(f"{n} keys need more than {MAX_BYTES} bytes in one cascade: raise `parts`")
        level = len(levels)
        words = _level(spark, inside, level, bits)
        levels.append((bits, words))
        if not n:
            return Cascade(levels)
        passed = _filter(outside, level, bits, words)
        inside, outside = tables.written(passed), inside


def _filter(keys: DataFrame, level: int, bits: int, words: np.ndarray) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(words)

    def keep(batches):
        for b in batches:
            yield b[holds(sent.value, bits, level, b["h1"].to_numpy(), b["h2"].to_numpy())]

    return keys.mapInPandas(keep, keys.schema)


def hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a key; together they tell all keys apart."""
    return F.xxhash64(key, F.lit(1)), F.xxhash64(F.lit(2), key)


def _member(made):
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(Cascade(made.value).listed(a.to_numpy(), b.to_numpy()))

    return F.pandas_udf(member, "boolean")


def mark_listed(rows: DataFrame, key: str, listed: Column | DataFrame, parts: int | None = None) -> DataFrame:
    """Add `listed` to each row: is its key on the list?

    The list is a table of keys (its first column), or a condition that holds in some row
    of the key. NULL keys are never listed; listed keys that no row has change nothing.
    Repeated rows and keys count once. A column `listed` of the rows is replaced, all others
    stay. `parts` is the number of cascades; by default as many as keep each below `MAX_BYTES`.
    """
    rows = rows.drop("listed") if isinstance(listed, DataFrame) else rows
    h1, h2 = hashes(F.col(key).cast("string"))
    on = F.lit(False) if isinstance(listed, DataFrame) else F.coalesce(listed, F.lit(False))
    known = rows.where(F.col(key).isNotNull()).select(
        h1.alias("h1"), h2.alias("h2"), on.alias("listed"), F.lit(True).alias("present")
    )
    if isinstance(listed, DataFrame):
        name = listed.columns[0]
        l1, l2 = hashes(F.col(name).cast("string"))
        known = known.unionByName(
            listed.where(F.col(name).isNotNull()).select(
                l1.alias("h1"), l2.alias("h2"), F.lit(True).alias("listed"), F.lit(False).alias("present")
            )
        )
    universe = tables.written(
        known.groupBy("h1", "h2")
        .agg(F.bool_or("listed").alias("listed"), F.bool_or("present").alias("present"))
        .where("present")
        .drop("present")
    )
    if parts is None:
        parts = 1 + universe.where("listed").count() * BITS // (8 * MAX_BYTES // 2)
    one, two = tables.fresh(rows, "_h1"), tables.fresh(rows, "_h2")
    out = rows.withColumns({one: h1, two: h2}).withColumn("listed", F.lit(False))
    for part in range(parts):
        mine = F.pmod(F.col("h1"), F.lit(parts)) == part
        made = rows.sparkSession.sparkContext.broadcast(cascade(universe.where(mine)).levels)
        here = F.pmod(F.col(one), F.lit(parts)) == part
        out = out.withColumn("listed", F.when(here, _member(made)(one, two)).otherwise(F.col("listed")))
    return out.withColumn("listed", F.col("listed") & F.col(key).isNotNull()).drop(one, two)


def judge(
    pages: DataFrame, listed: Column | DataFrame, rules: tuple[tuple[str, str], ...] = RULES
) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page (page_id, url).

    `listed` is the block list: a table of hosts, or a condition on `host` and `path`.
    The longest fitting rule decides; without one a listed host is blocked and any
    other url allowed. NULL urls and urls without a host are allowed.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = read.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    marked = mark_listed(ruled, "host", listed)
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "listed"
    )
