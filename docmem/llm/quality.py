"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins, and the model is a table of numbers per feature
plus a table per chosen pair of features. Training goes round the features
again and again (cyclic boosting): each turn fits a shallow tree on one feature's
bins to the gradient and adds a little of it to the feature's table. Pairs are
then chosen by what a tree on them would still gain, and boosted in the same
way. A score is a sum of table entries, so scoring is a few lookups per row.

The model is fitted on at most `MAX_LABELLED` labelled rows (those of the
smallest hash); every document is scored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .host_rules import repeated_words
from .text import split_words, text_runs

MAX_LABELLED = 20_000
CUT = 0.3

FEATURES = (
    "words log_words word_length length_spread distinct twice_in_row repeats dup_lines symbols signs_only "
    "letters digits capitals commas stops line_words short_words long_words other_letters links top_word"
).split()

_DIGIT = re.compile("[0-9]")
_CAPITAL = re.compile("(?:^|[ \\n])[A-Z\\u00c0-\\u00de]")
_LETTER = re.compile("[^\\W\\d_]")
_OTHER = re.compile("[^\\x00-\\x7f]")


def measure(text: str | None) -> tuple[float, ...]:
    """The features of a whole text; all 0 without words."""
    words = split_words(text) if text else []
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = len(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip()]
    signs = sum(not _LETTER.search(w) for w in number)
    return (
        float(n),
        float(np.log1p(n)),
        float(sizes.mean()),
        float(sizes.std()),
        len(number) / n,
        float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0,
        repeated_words(ids) / n if len(number) < n else 0.0,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(text.count, "#*$%&|<>")) / n,
        signs / len(number),
        1 - (chars - sum(sizes)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_CAPITAL.findall(text)) / n,
        text.count(",") / n,
        text.count(".") / n,
        n / max(1, len(lines)),
        float((sizes <= 3).mean()),
        float((sizes >= 15).mean()),
        len(_OTHER.findall(text)) / chars,
        (text.count("://") + text.count("www.") + text.count("@")) / n,
        float(np.bincount(ids).max()) / n,
    )


class Additive:
    """Bin edges and tables of a fitted model."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base = edges, base
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.single):
            out += t[bins[:, j]]
        for i, j, t in self.pairs:
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int = 4, ridge: float = 1.0) -> np.ndarray:
    """Leaf values by bin of a tree with few leaves over ordered bins, grown best split first."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])

    def best_cut(lo: int, hi: int):
        if hi - lo < 2:
            return 0.0, lo
        at = np.arange(lo + 1, hi)
        gl, hl, gr, hr = g[at] - g[lo], h[at] - h[lo], g[hi] - g[at], h[hi] - h[at]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        found = [(*best_cut(*p), p) for p in parts]
        gain, cut, part = max(found)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], cut), (cut, part[1])]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = (g[hi] - g[lo]) / (h[hi] - h[lo] + ridge)
    return out


def fit(
    x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, rate: float = 0.1, n_pairs: int = 10, pair_bins: int = 8
) -> Additive:
    """Cyclic boosting of single features, then of the best pairs. One class alone gives a constant."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Additive(edges, float(np.log(mean / (1 - mean))))
    if len(x) == 0 or y.min() == y.max():
        return model
    bins = model.bins(x)
    margin = model.margin(bins)

    def slopes(at: np.ndarray, size: int):
        p = 1 / (1 + np.exp(-margin))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(rounds):
        for j, t in enumerate(model.single):
            step = rate * shallow_tree(*slopes(bins[:, j], len(t)))
            t += step
            margin += step[bins[:, j]]
    coarse = [np.linspace(0, pair_bins - 1e-9, len(t)).astype(int) for t in model.single]
    gains = []
    for i, j in itertools.combinations(range(len(edges)), 2):
        g, h = slopes(coarse[i][bins[:, i]] * pair_bins + coarse[j][bins[:, j]], pair_bins**2)
        gains.append(((g**2 / (h + 1.0)).sum(), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(model.single[i]), len(model.single[j])))))
    for _ in range(rounds // 3):
        for i, j, t in model.pairs:
            # a tree of depth two: one feature is cut, then the other inside each part
            ci, cj = coarse[i], coarse[j]
            g, h = slopes(ci[bins[:, i]] * pair_bins + cj[bins[:, j]], pair_bins**2)
            g, h = g.reshape(pair_bins, -1), h.reshape(pair_bins, -1)
            first = shallow_tree(g.sum(1), h.sum(1), 2)
            step = np.zeros_like(g)
            for value in np.unique(first):
                rows = first == value
                step[rows] = shallow_tree(g[rows].sum(0), h[rows].sum(0), 2)
            step = rate * step[ci][:, cj]
            t += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Additive:
    """A model from at most `max_labelled` labelled rows that are not held out (the bound is by row, smallest hash first)."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taken = read.join(F.broadcast(known), "doc_id").select("text", "quality")  # at most max_labelled rows of two numbers

    def run(batches):
        for b in batches:
            x = np.array([measure(t) for t in b["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"x": list(x), "quality": b["quality"].to_numpy()})

    rows = taken.mapInPandas(run, "x array<double>, quality int").toArrow().to_pandas()
    x = np.array(rows["x"].tolist()).reshape(-1, len(FEATURES))
    y = rows["quality"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, name: str = "score") -> DataFrame:
    """All columns of `docs` (with `text`), and the score of each row."""
    schema = docs.withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            runs = text_runs(b.column(b.schema.get_field_index("text")))
            x = np.array([measure(t) for _, texts in runs for t in texts]).reshape(-1, len(FEATURES))
            got = pa.array(model.score(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of documents (doc_id, text).

    NULL, empty and blank texts are scored by features of 0. Without labels, or with
    one class only, every score is the share of label 1 (0.5 without labels).
    """
    model = train(docs, labels)
    bare = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(bare, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of `docs` that the classifier does not reject, with all their columns."""
    name = tables.fresh(docs, "_score")
    return score(docs, train(docs, labels), name).where(F.col(name) >= cut).drop(name)
