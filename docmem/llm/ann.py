"""Nearest neighbours by shifted space-filling curves.

Unit vectors are projected on a few random orthogonal directions, shifted at
random, and put in the order of a Hilbert curve; this is done for many curves.
Spark counts the keys of each curve and deals the curves out by ranges, which
gives the window of every query: the keys around its own that hold a share of
all rows. Vectors stay where they lie: each task puts its rows in the order of
each curve again, scores the rows of a query's windows, and merges the windows
of all curves. Only the best of each task travel.

The window is a share of the rows of a curve, so recall does not fall as the
table grows (it rises, as neighbours come closer). Near vectors are found on almost
every curve; the number of curves is set for the hard case of vectors
without any structure (64 dimensions, best cosines near 0.4).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import hilbert, tables

CURVES = 40
DIMS = 8
BITS = 2  # four levels a direction; windows end at the borders of these cells
CELLS = 1 << (DIMS * BITS)
SHARE = 1 / 64
LEAST = 64  # rows a window holds at least
SCALE = 0.8  # widths of the levels: tanh of the standardised projection
PASS_BYTES = 32 << 20  # queries, with their windows, that are sent to all tasks at once
TILE = 4 << 20  # scores a task holds at once
SLACK = 1e-9  # far above the rounding of a cosine of unit vectors


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors without NULL, zero or non-finite parts; floats stay floats."""
    floats = dict(vectors.dtypes)[vector_col] == "array<float>"
    v = F.col(vector_col) if floats else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    ok = (
        F.col(vector_col).isNotNull()
        & (F.size(vector_col) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    return vectors.where(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")
    )


def by_width(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) for each length of vector in a list column.

    Rows are scaled by a power of two, which changes no cosine but keeps squares finite.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    widths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(widths) - widths
    out = []
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        x = flat[starts[at][:, None] + np.arange(width)].astype(np.float64)
        out.append((int(width), at, np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def curve_cells(vectors: np.ndarray, curve: int, seed: int, plan) -> np.ndarray:
    """Hilbert keys of unit vectors on one curve. All is drawn from (seed, curve, width), so tasks agree."""
    width = vectors.shape[1]
    draw = np.random.default_rng([seed, curve, width])
    dims = min(DIMS, width)
    frame = np.linalg.qr(draw.standard_normal((width, dims)))[0]
    # a direction of a unit vector has the spread 1 / sqrt(width) when nothing is known of it
    at = vectors @ frame * np.sqrt(width) + draw.uniform(-0.5, 0.5, dims)
    if dims < DIMS:
        at = np.hstack([at, np.zeros((len(at), DIMS - dims))])
    level = ((np.tanh(at * SCALE) + 1) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert.index_array(np.clip(level, 0, (1 << BITS) - 1), BITS, plan)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosine in double precision; equal rows get equal values wherever they stand."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best by (-score, id), each id once."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return scores[order][first], ids[order][first]


class Asked:
    """Queries of one length: their vectors and windows, and the k best found so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, windows: np.ndarray, k: int):
        self.ids, self.x, self.unit, self.k = ids, x, unit(x), k
        self.low, self.high = windows >> 16, windows & 0xFFFF
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def meet(self, ids: np.ndarray, x: np.ndarray, seed: int, plan) -> None:
        """Score the rows that lie in a window of a query, and keep the best."""
        rows = unit(x)
        keys = [curve_cells(rows, c, seed, plan) for c in range(self.low.shape[1])]
        orders = [np.argsort(key, kind="stable").astype(np.int32) for key in keys]
        step = max(1, TILE // len(ids))
        for lo in range(0, len(self.ids), step):
            tile = slice(lo, lo + step)
            scores = np.full((len(self.ids[tile]), len(ids)), -np.inf)
            for c, order in enumerate(orders):
                placed, key = rows[order], keys[c][order]
                first = np.searchsorted(key, self.low[tile, c], "left")
                last = np.searchsorted(key, self.high[tile, c], "right")
                for j in np.flatnonzero(first < last):
                    a, z = first[j], last[j]
                    scores[j, order[a:z]] = placed[a:z] @ self.unit[lo + j]
            self._keep(lo, scores, ids, x)

    def _keep(self, lo: int, scores: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        k = self.k
        least = np.full(len(scores), -np.inf)
        if scores.shape[1] > 4 * (k + 1):  # one more than k, as the query itself may be among them
            least = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, -k - 1] - SLACK
        for j, s in enumerate(scores):
            q = lo + j
            old, old_ids = self.found[q]
            floor = old[-1] - SLACK if len(old) == k else -np.inf
            near = np.flatnonzero((s >= max(least[j], floor)) & (s > -np.inf) & (ids != self.ids[q]))
            if len(near) < k or len(np.unique(ids[near])) < k:  # repeated rows took the places
                near = np.flatnonzero((s >= floor) & (s > -np.inf) & (ids != self.ids[q]))
            if len(near):
                exact = cosines(x[near], self.x[q])
                self.found[q] = best(np.append(old, exact), np.append(old_ids, ids[near]), k)


def window_bounds(group: pd.DataFrame, share: float, least: int) -> pd.DataFrame:
    """(width, curve, cell, low, high): of each cell of a curve, the cells its window covers."""
    group = group.sort_values("cell")
    cell, n = group["cell"].to_numpy(), group["n"].to_numpy(np.int64)
    upto = np.cumsum(n)
    before, half = upto - n, max(least, upto[-1] * share) / 2
    low = np.searchsorted(upto, before - half, "right")
    high = np.searchsorted(before, upto + half, "left") - 1
    return group[["width", "curve", "cell"]].assign(low=cell[low], high=cell[high])


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    share: float = SHARE,
    seed: int = 7,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row for which `queries` holds.

    `queries` is a condition on `vec_id`; rows without an id take no part. Ties go
    to the smaller id. Vectors of different lengths never meet. Repeated rows of one
    id and vector count once; of different vectors under one id the nearest counts.
    Fewer candidates than k give fewer rows; an empty table gives none. Queries are
    sent in passes of about `pass_bytes`; each pass reads the vectors once.
    """
    points = tables.written(usable(vectors, id_col, vector_col).where("vec_id IS NOT NULL"))
    plan = hilbert.steps(DIMS)
    least = max(LEAST, 2 * (k + 1))

    def count(batches):
        held: dict[int, np.ndarray] = {}

        def send():
            for width, n in held.items():
                curve, cell = np.nonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(cell), width, np.int32)), pa.array(curve.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(n[curve, cell])],
                    names=["width", "curve", "cell", "n"],
                )
            held.clear()

        for b in batches:
            for width, _, x in by_width(b.column("v")):
                if width not in held and len(held) == 2:
                    yield from send()
                n = held.setdefault(width, np.zeros((curves, CELLS), np.int64))
                rows = unit(x)
                for c in range(curves):
                    n[c] += np.bincount(curve_cells(rows, c, seed, plan), minlength=CELLS)
        yield from send()

    def place(batches):
        for b in batches:
            uid = b.column("uid").to_numpy()
            for width, at, x in by_width(b.column("v")):
                rows = unit(x)
                cell = np.concatenate([curve_cells(rows, c, seed, plan) for c in range(curves)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(uid[at], curves)),
                        pa.array(np.full(len(cell), width, np.int32)),
                        pa.array(np.repeat(np.arange(curves, dtype=np.int32), len(at))),
                        pa.array(cell.astype(np.int32)),
                    ],
                    names=["uid", "width", "curve", "cell"],
                )

    # at most CELLS rows a curve, whatever the number of vectors; tasks have summed their own before
    counted = (
        points.select("v")
        .mapInArrow(count, "width int, curve int, cell int, n bigint")
        .groupBy("width", "curve", "cell")
        .agg(F.sum("n").alias("n"))
    )
    bounds = (
        counted.repartitionByRange("width", "curve")
        .groupBy("width", "curve")
        .applyInPandas(
            lambda g: window_bounds(g, share, least), "width int, curve int, cell int, low int, high int"
        )
    )
    asked = tables.written(
        tables.again(points)
        .where(F.coalesce(queries, F.lit(False)))
        .dropDuplicates(["vec_id", "v"])
        .withColumn("uid", F.monotonically_increasing_id())
    )
    window = (F.col("curve").cast("bigint") * CELLS + F.col("low")) * CELLS + F.col("high")
    windows = (
        asked.select("uid", "v")
        .mapInArrow(place, "uid bigint, width int, curve int, cell int")
        .join(bounds, ["width", "curve", "cell"])
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(window)).alias("windows"))
        .select("uid", F.transform("windows", lambda w: (w % (CELLS * CELLS) - (1 << 31)).cast("int")).alias("windows"))
    )
    ready = tables.written(tables.again(asked).join(windows, "uid").drop("uid"))
    number = 4 if dict(points.dtypes)["v"] == "array<float>" else 8
    size = ready.agg(F.sum(F.size("v") * number + 4 * curves + 24)).first()[0] or 0
    passes = 1 + size // pass_bytes
    found = []
    for i in range(passes):
        mine = ready.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i)
        found.append(_one_pass(points, mine.toArrow(), k, seed, plan))
        if passes > 1:
            found[-1] = tables.written(found[-1])
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _one_pass(points: DataFrame, queries: pa.Table, k: int, seed: int, plan) -> DataFrame:
    """The k nearest rows of the queries (vec_id, v, windows), which are sent to all tasks."""
    sent = points.sparkSession.sparkContext.broadcast(queries)

    def scan(batches):
        asked = {}
        table = sent.value
        ids = table.column("vec_id").to_numpy()
        if len(ids):
            windows = table.column("windows").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(np.int64) + (1 << 31)
            for width, at, x in by_width(table.column("v")):
                asked[width] = Asked(ids[at], x, windows[at], k)
        for b in batches:
            rows = b.column("vec_id").to_numpy()
            for width, at, x in by_width(b.column("v")):
                if width in asked:
                    asked[width].meet(rows[at], x, seed, plan)
        for a in asked.values():
            n = [len(s) for s, _ in a.found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(a.ids, n)),
                    pa.array(np.concatenate([i for _, i in a.found])),
                    pa.array(np.concatenate([s for s, _ in a.found])),
                ],
                names=["query_id", "vec_id", "score"],
            )

    merged = (
        points.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
