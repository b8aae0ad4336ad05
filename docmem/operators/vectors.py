"""Exact nearest vectors by cosine.

Every candidate has to be scored against every query of its tenant; only the
`k` best of a task leave the task. No pair rows are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_QUERIES = 4096
MAX_BROADCAST_BYTES = 64 << 20
GROUP_ROWS = 16_384
GROUP_BYTES = 32 << 20  # of vectors on either side of a grid cell
TILE = 2048  # candidates and queries scored at once: 32 MB of scores
DIGITS = 6


def _is_usable(dims: int) -> Column:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col("vector").isNotNull() & (F.size("vector") == dims) & finite, F.lit(False))


def unusable(df: DataFrame, dims: int) -> DataFrame:
    """Rows that no search can use: NULL vectors, NULL or non-finite components, another length than `dims`."""
    return df.where(~_is_usable(dims))


def _matrix(vectors) -> np.ndarray:
    """Rows of unit length; a zero vector scores 0 with everything."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int):
    """Indexes of the k best: score descending, then id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


class _Best:
    """The k best candidates seen so far for each query of one tenant."""

    def __init__(self, query_ids, matrix: np.ndarray, k: int):
        self.query_ids, self.matrix, self.k = query_ids, matrix, k
        self.top: list = [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in query_ids]

    def add(self, ids: np.ndarray, vectors) -> None:
        rows = _matrix(vectors)
        for r in range(0, len(rows), TILE):
            for c in range(0, len(self.query_ids), TILE):
                scores = rows[r : r + TILE] @ self.matrix[c : c + TILE].T
                self._merge(ids[r : r + TILE], np.round(scores, DIGITS, out=scores), c)

    def _merge(self, ids: np.ndarray, scores: np.ndarray, first: int) -> None:
        # only queries for which the tile holds something as good as their worst so far
        worst = np.array([s[-1] if len(s) == self.k else -np.inf for s, _ in self.top[first : first + scores.shape[1]]])
        for i in np.flatnonzero(scores.max(axis=0) >= worst):
            old_scores, old_ids = self.top[first + i]
            s = np.concatenate([old_scores, scores[:, i]])
            d = np.concatenate([old_ids, ids])
            at = _best(s, d, self.k)
            self.top[first + i] = (s[at], d[at])

    def frame(self, tenant) -> pd.DataFrame:
        n = [len(d) for _, d in self.top]
        return pd.DataFrame(
            {
                "uid": np.repeat(tenant, sum(n)),
                "query_id": np.repeat(self.query_ids, n),
                "vec_id": np.concatenate([d for _, d in self.top]) if n else [],
                "score": np.concatenate([s for s, _ in self.top]) if n else [],
            }
        )


def _schema(candidates: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("uid", candidates.schema["uid"].dataType),
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("vec_id", candidates.schema["vec_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan(candidates: DataFrame, queries: pd.DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """One scan of the candidates, no shuffle of vectors; queries go to every task."""
    by_uid = {u: (g["query_id"].to_numpy(), _matrix(g["vector"])) for u, g in queries.groupby("uid")}
    shared = candidates.sparkSession.sparkContext.broadcast(by_uid)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for batch in batches:
            for uid, rows in batch.groupby("uid", sort=False):
                if uid in shared.value:
                    if uid not in state:
                        state[uid] = _Best(*shared.value[uid], k)
                    state[uid].add(rows["vec_id"].to_numpy(), rows["vector"])
        for uid, best in state.items():
            yield best.frame(uid)

    return candidates.select("uid", "vec_id", "vector").mapInPandas(run, schema)


def _grid(candidates: DataFrame, queries: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """For query sets too large to send around: per tenant a grid of bounded cells.

    Candidates fall into row groups and queries into column groups, both of at most
    about `GROUP_ROWS` rows and `GROUP_BYTES` by the tenant's own counts; each side
    is repeated once per group of the other side, and a cell scores its two groups
    tile by tile. A task holds both groups (as rows and as matrices, some four times
    `GROUP_BYTES`) and one tile of scores.
    """

    def groups(df: DataFrame, name: str) -> DataFrame:
        parts = F.greatest(F.count("*") / GROUP_ROWS, F.sum(F.size("vector")) * 8 / GROUP_BYTES)
        return df.groupBy("uid").agg(F.ceil(parts).cast("int").alias(name))

    sizes = groups(candidates, "n_rows").join(groups(queries, "n_cols"), "uid")

    def place(df: DataFrame, key: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return (
            df.select("uid", key, "vector")
            .join(sizes, "uid")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
            .select("uid", "row", "col", key, "vector")
        )

    left = place(candidates, "vec_id", "row", "col", "n_rows", "n_cols")
    right = place(queries, "query_id", "col", "row", "n_cols", "n_rows")

    def cell(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if c.empty or q.empty:
            return pd.DataFrame({"uid": [], "query_id": [], "vec_id": [], "score": []})
        best = _Best(q["query_id"].to_numpy(), _matrix(q["vector"]), k)
        for start in range(0, len(c), TILE):
            part = c.iloc[start : start + TILE]
            best.add(part["vec_id"].to_numpy(), part["vector"])
        return best.frame(c["uid"].iloc[0])

    keys = ("uid", "row", "col")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(cell, schema)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The `k` nearest candidates of each query: `(uid, query_id, rank, vec_id, score)`.

    `candidates(uid, vec_id, vector)` and `queries(uid, query_id, vector)` meet
    within a tenant. Scores are rounded so that ties break by id alike on every
    layout of the data. Query sets of a checked size are sent to the tasks and
    the candidates are read once in place; larger sets go through a grid. Rows of
    `unusable` (for the length of the query vectors) take no part.
    """
    schema = _schema(candidates, queries)
    dims = queries.agg(F.max(F.size("vector"))).first()[0] or 0
    candidates, queries = candidates.where(_is_usable(dims)), queries.where(_is_usable(dims))
    head = queries.select("uid", "query_id", "vector").limit(MAX_BROADCAST_QUERIES + 1).toPandas()
    floats = sum(len(v) for v in head["vector"])
    if len(head) <= MAX_BROADCAST_QUERIES and floats * 8 <= MAX_BROADCAST_BYTES:
        partial = _scan(candidates, head, k, schema)
    else:
        partial = _grid(candidates, queries, k, schema)
    order = Window.partitionBy("uid", "query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def centroids(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector per group, from map-side partial sums per dimension."""
    dims = vectors.select(by, F.posexplode("vector").alias("i", "x"))
    means = dims.groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return (
        means.groupBy(by)
        .agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("e"))
        .select(by, F.transform("e", lambda e: e["m"]).alias("vector"))
    )


def context_of(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of the hits of each query in rank order (at most k per query)."""
    found = hits.join(texts.select("vec_id", "content"), "vec_id")
    return (
        found.groupBy("uid", "query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("h"))
        .select("uid", "query_id", F.transform("h", lambda h: h["content"]).alias("texts"))
    )
