"""Host-level quality rules.

Every document is tested by rules of its own. The failures of each rule are
counted by host, and the rate of a host is shrunk towards the rates of the other hosts
by a beta prior fitted to their mean and spread (method of moments, hosts weighed by their
documents; the host itself is left out, so that it cannot widen the measure it is judged by). A host whose shrunk rate of
any rule lies far above that prior loses its documents. Hosts with few documents stay
near the prior, so a few bad documents do not condemn them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables
from .text import split_words, text_runs

WINDOW = 5
SYMBOLS = "#*$%&|<>"
WIDE = 4.0  # standard deviations of the prior that a shrunk rate may lie above its mean

METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of `window` words that occur twice or more in the text.

    Windows are told apart exactly: ids of words are joined to ids of pairs,
    fours and fives, each numbered anew.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    at, width = ids, 1
    while width < window:
        add = min(width, window - width)
        right = at[add:]  # in the last step the two halves overlap
        key = at[: len(right)] * (int(at.max()) + 1) + right
        at, width = np.unique(key, return_inverse=True)[1], width + add
    twice = np.bincount(at)[at] > 1
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The metrics of one whole text; all 0 for None and for texts without words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = split_words(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if split_words(line)] if "\n" in text else []
    duplicates = len(lines) - len(set(lines))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    repeats = repeated_words(ids) if len(number) < len(words) else 0
    return len(words), sum(map(len, words)), symbols, duplicates, repeats


def metrics(docs: DataFrame) -> DataFrame:
    """(doc_id, source) and the metrics of each row of documents."""

    def run(batches):
        for b in batches:
            rows = [measure(t) for _, texts in text_runs(b.column("text")) for t in texts]
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("source"), *columns],
                names=["doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
            )

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id bigint, source string, {METRICS}")


def rules() -> dict:
    """Failed rules by name, as conditions on the metrics."""
    return {
        "few_words": F.col("n_words") < 10,
        "repeats": F.col("n_repeat_words") * 100 > F.col("n_words") * 20,
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
    }


BASE = ("few_words", "repeats")


def judge(docs: DataFrame, wide: float = WIDE) -> DataFrame:
    """Metrics, `base_failed`, host rates and `kept` of each document (doc_id, source, text).

    NULL sources form one host. NULL, empty and blank texts have no words, so they
    fail. Repeated rows count as often as they occur. A document is kept if it
    passes the base rules and no rule's shrunk rate of its host lies more than `wide`
    standard deviations above the mean of the host's prior. A single host is its own prior
    and is kept.
    """
    tests = rules()
    measured = tables.written(metrics(docs).withColumns({f"f_{k}": v for k, v in tests.items()}))
    # counts combine on the map side, so a host with a third of all rows moves few rows
    hosts = measured.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"f_{k}").cast("int")).alias(f"s_{k}") for k in tests]
    )
    square = {k: F.col(f"s_{k}") * F.col(f"s_{k}") / F.col("n") for k in tests}
    sums = hosts.agg(
        F.sum("n").alias("n"),
        *[x for k in tests for x in (F.sum(f"s_{k}").alias(f"t_{k}"), F.sum(square[k]).alias(f"q_{k}"))],
    ).first()
    verdict, shown = F.lit(True), []
    for k in tests:
        a, b = prior_of_others(F.col("n"), F.col(f"s_{k}"), sums["n"] or 0, sums[f"t_{k}"] or 0, sums[f"q_{k}"] or 0.0)
        limit = a / (a + b) + wide * F.sqrt(a * b / (a + b + 1)) / (a + b)
        shown += [((F.col(f"s_{k}") + a) / (F.col("n") + a + b)).alias(f"rate_{k}"), limit.alias(f"limit_{k}")]
        verdict = verdict & (F.col(f"rate_{k}") <= F.col(f"limit_{k}"))
    judged = hosts.select(F.col("source").alias("host"), F.col("n").alias("host_docs"), *shown).withColumn("host_kept", verdict)
    failed = F.col(f"f_{BASE[0]}")
    for k in BASE[1:]:
        failed = failed | F.col(f"f_{k}")
    return (
        measured.join(judged, F.col("source").eqNullSafe(F.col("host")), "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))
        .drop("host", *[f"f_{k}" for k in tests])
    )


def prior_of_others(n: Column, failed: Column, docs: int, total: int, squares: float) -> tuple[Column, Column]:
    """(a, b) of a beta distribution with the mean and variance of the rates of all hosts but one.

    `n` and `failed` are that host's documents and failures, `docs` and `total` those of all
    hosts, `squares` the sum of failed^2 / n. The weight is held between 10 and 100 documents, 100
    without spread (two hosts, equal rates); half a document is added on either side.
    """
    rest = F.lit(docs) - n
    mean = F.when(rest > 0, (F.lit(total) - failed) / rest).otherwise(failed / n)
    variance = F.when(rest > 0, (F.lit(squares) - failed * failed / n) / rest - mean * mean).otherwise(0.0)
    fitted = F.least(F.lit(100.0), F.greatest(F.lit(10.0), mean * (1 - mean) / variance - 1))
    weight = F.when((variance > 0) & (mean > 0) & (mean < 1), fitted).otherwise(100.0)
    return mean * weight + 0.5, (1 - mean) * weight + 0.5
