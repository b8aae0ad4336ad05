"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance is a metric. A join around pivots needs distances below 1:
texts that share nothing are all at distance 1, where pivots say nothing. So the
space is first cut into the parts in which distances can be small at all:

1. Equal sets become one point (a class).
2. A class can be linked only if at least four fifths of its shingles occur in
   other classes. Lone shingles are counted by exchanging packed hashes; a sample of
   the shingles by hash is enough, with the bound moved so that no link is lost.
3. What is left is joined by prefixes: with shingles in the order of their
   frequency, linked sets share one of their `missing` + 1 rarest. Classes that share
   one are put into one part; parts are unions of such groups.

Inside a part, pivots create Voronoi regions: each point goes to the nearest
pivot, and all points within the threshold of a pivot are linked to it. Parts
whose points are not all in one component go on: points outside the largest
component become the next pivots, and each is sent only to the regions whose
distances to their pivot the triangle inequality allows. A point that has been a
pivot has all its links, so a part is done when all points outside its largest
component have been pivots. Nothing is compared twice, no pairs within a
component are listed, and a part of any size is split over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, graph, tables
from .suffix_tree import WordHash
from .text import lower_words, text_runs

WORDS = 5
PER_CENT = 80
PIVOTS = 1024  # of a part and round, at most
PIVOT_SHINGLES = 1 << 20  # of these together, beyond the first 16
SLOT_BYTES = 8 << 20
SAMPLE = np.uint64(2)  # one of so many shingles by hash is sent to find lone ones
KEPT = 50_000  # word hashes a task remembers, some 10 MB
SENT = 1_000_000  # numbers that are broadcast at most


def missing(n):
    """Shingles of a set of n that a linked set may lack: |x & y| >= 0.8 |x or y| >= 0.8 n."""
    return n - (n * PER_CENT + 99) // 100


def shingles(words: list[bytes], table: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word windows; fewer words are one shingle as a whole."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = (out ^ h[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, set, row): size and digest of the set of each row of docs (doc_id, text)."""

    def run(batches):
        table = WordHash()
        for b in batches:
            n, key = [], []
            for _, texts in text_runs(b.column("text")):
                if len(table) > KEPT:
                    table.clear()
                for text in texts:
                    x = shingles(lower_words(text), table)
                    n.append(len(x))
                    key.append(digest(x))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary())],
                names=["doc_id", "text_hash", "n", "set"],
            )

    made = docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, set binary")
    return tables.written(made.withColumn("row", F.monotonically_increasing_id()))


def lone_counts(docs: DataFrame, total: int) -> DataFrame:
    """(set, sampled, lone): of each set, how many sampled shingles there are and how many occur in no other set.

    Shingles travel as five bytes of their hash, or more when there are very many;
    a chance agreement only makes a shingle count as shared.
    """
    bytes_ = min(8, max(5, -(-(max(total, 1).bit_length() + 6) // 8)))
    n = blocks.buckets_for(total * bytes_ // int(SAMPLE))

    def cut(batches):
        table = WordHash()
        for texts in (texts for b in batches for _, texts in text_runs(b.column("text"))):
            if len(table) > KEPT:
                table.clear()
            done: set[bytes] = set()
            keys, sizes, values = [], [], []
            for text in texts:
                x = shingles(lower_words(text), table)
                key = digest(x)
                if len(x) and key not in done:
                    done.add(key)
                    x = x[x % SAMPLE == 0] // SAMPLE
                    keys.append(key)
                    sizes.append(len(x))
                    values.append(x)
            if not keys:
                continue
            x, doc = np.concatenate(values), blocks.spans(np.array(sizes))
            key = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
            for bucket, at in blocks.by_bucket((x % np.uint64(n)).astype(np.int64)):
                owner, per = np.unique(doc[at], return_counts=True)
                cut_x = (x[at] // np.uint64(n)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :bytes_]
                yield bucket, blocks.packed([key[owner].ravel(), per.astype("<u4"), cut_x.ravel()])

    def merge(bucket, found):
        key, per, raw = blocks.gathered(found, ["<u8", "<u4", "u1"])
        wide = np.zeros((len(raw) // bytes_, 8), np.uint8)
        wide[:, :bytes_] = raw.reshape(-1, bytes_)
        x = wide.view("<u8").ravel()
        # the same set may come from several runs of texts: its shingles are the same each time
        key = key.reshape(-1, 2)
        _, first, same = np.unique(key, axis=0, return_index=True, return_inverse=True)
        owner = blocks.spans(per)
        keep = first[same.ravel()][owner] == owner
        x, owner = x[keep], owner[keep]
        _, number, times = np.unique(x, return_inverse=True, return_counts=True)
        lone = np.bincount(owner, times[number] == 1, len(key))[first].astype(np.int32)
        count = np.bincount(owner, minlength=len(key))[first].astype(np.int32)
        flat = np.ascontiguousarray(key[first])
        return pa.table(
            {"block": pa.array([blocks.packed([flat.ravel(), count, lone])], pa.binary())}
        )

    def again(batches):
        for b in batches:
            for block in b.column("block").to_pylist():
                key, count, lone = blocks.unpacked(block, ["<u8", "<i4", "<i4"])
                key = key.reshape(-1, 2)
                for bucket, at in blocks.by_bucket((key[:, 0] % np.uint64(n)).astype(np.int64)):
                    yield bucket, blocks.packed([key[at].ravel(), count[at], lone[at]])

    def total_up(_, found):
        key, count, lone = blocks.gathered(found, ["<u8", "<i4", "<i4"])
        name, at = np.unique(key.reshape(-1, 2), axis=0, return_inverse=True)
        at = at.ravel()
        flat = np.ascontiguousarray(name).tobytes()
        return pa.table(
            {
                "set": pa.array([flat[16 * i : 16 * i + 16] for i in range(len(name))], pa.binary()),
                "sampled": np.bincount(at, count).astype(np.int64),
                "lone": np.bincount(at, lone).astype(np.int64),
            }
        )

    parts = blocks.exchange(docs.select("text"), cut, merge, "block binary")
    return blocks.exchange(parts, again, total_up, "set binary, sampled bigint, lone bigint")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, n, x): the shingles (packed) of the classes in `wanted` (cls, set, text_hash)."""

    def run(batches):
        table = WordHash()
        for texts in (texts for b in batches for _, texts in text_runs(b.column("text"))):
            if len(table) > KEPT:
                table.clear()
            done: set[bytes] = set()
            keys, sets = [], []
            for text in texts:
                x = shingles(lower_words(text), table)
                key = digest(x)
                if key not in done:
                    done.add(key)
                    keys.append(key)
                    sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set", "x"])

    hashes = wanted.select("text_hash").distinct()
    hashes = F.broadcast(hashes) if wanted.count() <= SENT else hashes  # a number per row; more are joined by hash
    made = docs.join(hashes, "text_hash").select("text").mapInArrow(run, "set binary, x binary")
    return (
        made.join(wanted.select("set", "cls"), "set")
        .groupBy("cls")
        .agg(F.first("x").alias("x"))
        .select("cls", (F.length("x") / 8).cast("bigint").alias("n"), "x")
    )


def prefix_edges(sets: DataFrame) -> DataFrame:
    """(a, b): classes that share one of their rarest shingles, as stars around the smallest class."""
    size = sets.agg(F.sum(F.length("x"))).first()[0] or 0
    n = blocks.buckets_for(size * 2)

    def cut(batches):
        for b in batches:
            cls = b.column("cls").to_numpy()
            sets_ = [np.frombuffer(x, "<u8") for x in b.column("x").to_pylist()]
            if not sets_:
                continue
            x, owner = np.concatenate(sets_), blocks.spans(np.array([len(s) for s in sets_]))
            for bucket, at in blocks.by_bucket((x % np.uint64(n)).astype(np.int64)):
                who, per = np.unique(owner[at], return_counts=True)
                yield bucket, blocks.packed([cls[who], per.astype("<u4"), x[at]])

    def count(_, found):
        cls, per, x = blocks.gathered(found, ["<i8", "<u4", "<u8"])
        _, number, times = np.unique(x, return_inverse=True, return_counts=True)
        shared = times[number] > 1
        owner = blocks.spans(per)
        return pa.table(
            {"block": pa.array([blocks.packed([cls[owner[shared]], x[shared], times[number][shared].astype("<u4")])], pa.binary())}
        )

    def send(batches):
        for b in batches:
            for block in b.column("block").to_pylist():
                cls, x, times = blocks.unpacked(block, ["<i8", "<u8", "<u4"])
                for bucket, at in blocks.by_bucket(cls % n):
                    yield bucket, blocks.packed([cls[at], x[at], times[at]])

    def prefix(_, found):
        cls, x, times = blocks.gathered(found, ["<i8", "<u8", "<u4"])
        order = np.lexsort((x, times, cls))
        cls, x = cls[order], x[order]
        name, first, shared = np.unique(cls, return_index=True, return_counts=True)
        return pa.table({"cls": cls, "x": x.view(np.int64), "place": np.arange(len(cls)) - np.repeat(first, shared), "shared": np.repeat(shared, shared)})

    frequent = blocks.exchange(sets.select("cls", "x"), cut, count, "block binary")
    ordered = blocks.exchange(frequent, send, prefix, "cls bigint, x bigint, place bigint, shared bigint")
    sized = sets.select("cls", "n")
    may_miss = F.col("n") - F.floor((F.col("n") * PER_CENT + 99) / 100)
    # lone shingles come first in the order of frequency and match nothing
    keys = tables.written(
        ordered.join(sized, "cls").where(F.col("place") < may_miss + 1 - (F.col("n") - F.col("shared"))).select("x", "cls")
    )
    lead = keys.groupBy("x").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    return tables.again(keys).join(lead, "x").where("cls <> lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()


def distances(members: list[np.ndarray], pivots: list[np.ndarray], compared: list[list[tuple[int, int]]]) -> np.ndarray:
    """Jaccard overlap [member, pivot] as (intersection, union); only the `compared` spans of members are opened for a pivot."""
    sizes = np.array([len(m) for m in members])
    flat, owner, start = np.concatenate(members), blocks.spans(sizes), np.append(0, np.cumsum(sizes))
    out = np.zeros((len(members), len(pivots), 2), np.int64)
    for j, p in enumerate(pivots):
        for lo, hi in compared[j]:
            x = flat[start[lo] : start[hi]]
            at = np.searchsorted(p, x)
            at[at == len(p)] = 0
            out[lo:hi, j, 0] = np.bincount(owner[start[lo] : start[hi]] - lo, p[at] == x, hi - lo)
        out[:, j, 1] = sizes + len(p) - out[:, j, 0]
    return out


def windows(region: np.ndarray, d: np.ndarray, own: np.ndarray, pd_: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each pivot the spans of members, sorted by region and distance, that the triangle inequality allows.

    A pivot lies in the region `own`, at distance `pd_` from that region's pivot, so members of that region link
    with it only within `pd_` +- threshold; other regions it meets in full. Region -1 is the whole part.
    """
    near = 1 - PER_CENT / 100 + 1e-9
    lo, hi = np.searchsorted(region, own), np.searchsorted(region, own, "right")
    out = []
    for r, at, a, b in zip(own, pd_, lo, hi):
        if r == -1 or a == b:
            out.append([(0, len(region))])
            continue
        first, last = a + np.searchsorted(d[a:b], [at - near, at + near]) + [0, 1]
        spans = [(0, a), (first, min(last, b)), (b, len(region))]
        out.append([(x, y) for x, y in spans if x < y])
    return out


def joining(link: np.ndarray) -> np.ndarray:
    """The links [member, pivot] that join all that `link` joins: fewer than members and pivots together."""
    out = np.zeros_like(link)
    group = np.arange(link.shape[1])  # of each pivot, by the members so far
    for i in np.flatnonzero(link.any(axis=1)):
        pivots = np.flatnonzero(link[i])
        groups, first = np.unique(group[pivots], return_index=True)
        out[i, pivots[first]] = True
        if len(groups) > 1:
            group[np.isin(group, groups)] = groups[0]
    return out


def links(points: DataFrame) -> DataFrame:
    """(a, b): verified links that join all linked points (part, cls, n, x) of each part."""
    weight = points.groupBy("part").agg((F.sum(F.length("x")) / SLOT_BYTES + 1).cast("int").alias("slots"))
    slot = F.pmod(F.xxhash64("cls"), F.col("slots")).cast("int")
    placed = tables.written(points.join(weight, "part").withColumn("slot", slot).drop("slots"))
    # region -1 is the whole part, before there are pivots
    state = tables.written(
        placed.select("part", "cls", "n", F.col("cls").alias("comp"), F.lit(False).alias("was_pivot"), F.lit(-1).cast("bigint").alias("region"), F.lit(1.0).alias("d"))
    )
    good: DataFrame | None = None

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"part": [], "cls": [], "pivot": [], "d": [], "link": []})
        left = left.sort_values(["region", "d"], kind="stable")
        members = [np.frombuffer(x, "<u8") for x in left["x"]]
        compared = windows(*(c.to_numpy() for c in (left["region"], left["d"], right["own"], right["pd"])))
        found = distances(members, [np.frombuffer(x, "<u8") for x in right["px"]], compared)
        both, all_ = found[:, :, 0], found[:, :, 1]
        link = joining(both * 100 >= all_ * PER_CENT)  # all links of near copies would be as many as their pairs
        d = 1 - both / all_
        near = d.argmin(axis=1)
        # links, and the nearest pivot of each point
        i, j = np.nonzero(link | (np.arange(d.shape[1]) == near[:, None]))
        pivot = right["pivot"].to_numpy()
        out = pd.DataFrame(
            {"part": left["part"].to_numpy()[i], "cls": left["cls"].to_numpy()[i], "pivot": pivot[j], "d": d[i, j], "link": link[i, j]}
        )
        return out[out["cls"] != out["pivot"]] if len(out) else out

    while True:
        # points outside the largest component of their part that have not been pivots
        sizes = state.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("k"))
        largest = sizes.groupBy("part").agg(F.max(F.struct("k", "comp")).alias("m")).select("part", F.col("m.comp").alias("main"))
        waiting = state.join(largest, "part").where("comp <> main AND NOT was_pivot")
        order = Window.partitionBy("part").orderBy(F.xxhash64("cls"), "cls")
        running = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
        chosen = tables.written(
            waiting.withColumn("r", F.row_number().over(order))
            .where(F.col("r") <= PIVOTS)
            .withColumn("shingles", running)
            .where((F.col("r") <= 16) | (F.col("shingles") <= PIVOT_SHINGLES))
            .select("part", F.col("cls").alias("pivot"), "region", "d")
        )
        if chosen.isEmpty():
            return good if good is not None else state.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)

        # only the parts that go on; few numbers per point are broadcast where they are few enough
        live = tables.written(
            tables.again(state).select("part", "cls", "region", "d").join(tables.again(chosen).select("part").distinct(), "part")
        )
        small = live.count() <= SENT // 5

        def members() -> DataFrame:
            where = tables.again(live).drop("part")
            return tables.again(placed).join(F.broadcast(where) if small else where, "cls")

        # a pivot goes to the slots of its part, whose number follows the bytes; regions are told apart there
        slots = members().select("part", "slot").distinct()
        sent = slots.join(chosen.withColumnsRenamed({"region": "own", "d": "pd"}), "part")
        whole = tables.again(placed).select(F.col("cls").alias("pivot"), F.col("x").alias("px"))
        names = tables.again(chosen).select("pivot")
        sent = whole.join(F.broadcast(names) if small else names, "pivot").join(sent, "pivot")
        checked = tables.written(
            members().select("part", "slot", "region", "d", "cls", "x")
            .groupBy("part", "slot")
            .cogroup(sent.select("part", "slot", "own", "pd", "pivot", "px").groupBy("part", "slot"))
            .applyInPandas(compare, "part bigint, cls bigint, pivot bigint, d double, link boolean")
        )
        now = checked.where("link").select(F.col("cls").alias("a"), F.col("pivot").alias("b"))
        good = now if good is None else good.unionByName(now)
        named = tables.again(state).select("cls", "comp")
        joined = (
            now.join(named.withColumnsRenamed({"cls": "a", "comp": "ca"}), "a")
            .join(tables.again(state).select(F.col("cls").alias("b"), F.col("comp").alias("cb")), "b")
            .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        )
        roots = graph.components(joined).withColumnsRenamed({"node": "comp"})
        nearest = tables.again(checked).groupBy("cls").agg(F.min(F.struct("d", "pivot")).alias("m"))
        pivots = tables.again(chosen).select(F.col("pivot").alias("cls"), F.lit(True).alias("now_pivot"))
        state = tables.written(
            state.join(roots, "comp", "left")
            .join(nearest, "cls", "left")
            .join(pivots, "cls", "left")
            .select(
                "part",
                "cls",
                "n",
                F.coalesce("root", "comp").alias("comp"),
                (F.col("was_pivot") | F.coalesce("now_pivot", F.lit(False))).alias("was_pivot"),
                F.when(F.col("now_pivot"), F.col("cls")).when(F.col("m.d") < F.col("d"), F.col("m.pivot")).otherwise(F.col("region")).alias("region"),
                F.when(F.col("now_pivot"), F.lit(0.0)).otherwise(F.least("d", "m.d")).alias("d"),
            )
        )


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of all rows, and (set, comp): the first row number of each linked set's component."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("text_hash", F.xxhash64("text"))
    known = facts(rows)
    own = tables.written(
        known.where("n > 0")
        .groupBy("set")
        .agg(F.min("row").alias("cls"), F.first("n").alias("n"), F.min("text_hash").alias("text_hash"))
    )
    total = own.agg(F.sum("n")).first()[0] or 0
    lone = lone_counts(rows, int(total))
    may_miss = F.col("n") - F.floor((F.col("n") * PER_CENT + 99) / 100)
    # a set without sampled shingles has no row in `lone`
    wanted = tables.written(
        own.join(lone, "set", "left").where(F.coalesce("lone", F.lit(0)) <= may_miss).select("set", "cls", "text_hash")
    )
    sets = tables.written(sets_of(rows, wanted))
    parts = tables.written(graph.components(prefix_edges(sets)).withColumnsRenamed({"node": "cls", "root": "part"}))
    linked = graph.components(links(sets.join(parts, "cls").select("part", "cls", "n", "x")))
    comps = own.select("set", "cls").join(linked.withColumnsRenamed({"node": "cls", "root": "comp"}), "cls", "left")
    return known, comps.select("set", F.coalesce("comp", "cls").alias("comp"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of documents (doc_id, text).

    NULL, empty and blank texts have an empty set, are linked with nothing, and
    have their own doc_id as component. Rows with equal sets are linked. A component
    of NULL doc_ids alone has a NULL id. Repeated rows are kept.
    """
    known, comps = classes(docs)
    of_set = known.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    least = tables.written(of_set.join(comps, "set")).select("set", "comp", "least")
    ids = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = least.select("set", "comp").join(ids, "comp").select("set", "component_id")
    return known.join(named, "set", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component with all columns of `docs`: the one of the smallest doc_id (NULL last).

    Rows without words stay. `docs` must be a plain read of stored tables.
    """
    uid = tables.fresh(docs, "_uid")
    rows = docs.withColumn(uid, F.monotonically_increasing_id())
    known, comps = classes(rows.select(F.col(uid).alias("doc_id"), "text"))
    placed = known.where("n > 0").join(comps, "set").select(F.col("doc_id").alias("uid"), "comp")
    names = rows.select(F.col(uid).alias("uid"), F.col("doc_id").alias("name"))
    named = tables.written(placed.join(names, "uid"))
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("name").isNull(), "name", "uid")).alias("m"))
    extra = tables.again(named).join(first, "comp").where(F.col("uid") != F.col("m.uid")).select(F.col("uid").alias(uid))
    return rows.join(extra, uid, "left_anti").select(*docs.columns)
