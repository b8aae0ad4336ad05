"""Repair of the turn structure of conversations.

The roles of a sound conversation spell `(s?(ua)+)?`: an optional system turn, then
user and assistant in turn. For each parity there is one endless target string,
`uaua...` and `suaua...`; its prefixes are the feasible results. Wagner-Fischer
tables align the turns to these prefixes. Shorter targets are prefixes of longer
ones, so one table per parity holds the alignment to every feasible length. Ukkonen
bands, taken from the cost of a greedy repair, bound each row of a table: a cell too
far from the diagonal costs more than the incumbent. Tables are filled from the end,
so that audits can be traced from their first letter, the least one first; the
audits of both tables are then compared.

Spark deals conversations out and sorts their rows. What the tables need of a row is
a letter and a fault, so tasks hold two bytes a row and never a whole conversation's
texts: these stream past in order, each under the audit of its conversation.

Defined cases. NULL roles and texts are empty; a NULL conversation id is an id like
others; NULL turns come first. Rows of one turn follow role and text in a fixed
order, and repeated rows are duplicates. An empty table gives no rows. A conversation
of n rows costs n times the width of its band, which grows with the number of faults
in it; the tables are kept row by row at every sqrt(n)-th row only and filled again
in between.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1  # costs; CUT_OFF for each truncated row that stays
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_NEVER = 1 << 40
_SPACES = " \t\n\x0b\x0c\r"


def _greedy(letters: bytes, faults: bytes) -> int:
    """The cost of a repair found in one pass: deletes what must go, keeps or reroles the rest."""
    fixed = sum(DELETE if f in (BLANK, DUPLICATE) else CUT_OFF if f == TRUNCATED else 0 for f in faults)
    alive = [c for c, f in zip(letters, faults) if f not in (BLANK, DUPLICATE)]
    ways = []
    for start in range(2 if alive[:1] == [ord("s")] else 1):
        cost = n = 0
        for c in alive[start:]:
            if c not in b"ua":
                cost += REROLE
            elif c != b"ua"[n % 2]:
                cost += INSERT
                n += 1
            n += 1
        missing = n % 2 if n or not start else 2
        ways.append(cost + INSERT * missing)
    return fixed + min(ways)


class _Table:
    """Costs to go for one parity: cell (i, x) is the cheapest repair of rows i.. onto the letters j.. of the target.

    Rows are kept relative to the diagonal: x = j - (rows before i that may stay) + width.
    """

    def __init__(self, letters: bytes, faults: bytes, system: bool, slack: int):
        self.n = len(letters)
        self.letters, self.faults, self.system = letters, faults, int(system)
        self.width = slack // 2 + 1
        self.x = np.arange(2 * self.width + 1, dtype=np.int64)
        gone = np.frombuffer(faults, np.uint8)
        self.alive = np.concatenate([[0], np.cumsum((gone != BLANK) & (gone != DUPLICATE))])
        self.block = max(64, math.isqrt(self.n) + 1)
        self.marks: dict[int, np.ndarray] = {self.n: self._closed(self._ends(), self.n)}
        g = self.marks[self.n]
        self.first: list[np.ndarray] = []
        for i in range(self.n - 1, -1, -1):
            g = self._row(i, g)
            if i % self.block == 0:
                self.marks[i] = g
            if i < self.block:
                self.first.append(g)
        self.first.reverse()

    def _target(self, i: int) -> np.ndarray:
        """The place in the target, counted from its first user turn: -1 is the system turn, below lies nothing."""
        return self.x + (int(self.alive[i]) - self.width - self.system)

    def _ends(self) -> np.ndarray:
        j = self._target(self.n)
        out = np.where((j >= 0) & (j % 2 == 0), 0, _NEVER)
        if self.system:
            out[j == 0] = _NEVER  # a system turn alone is no conversation
        return out

    def _closed(self, h: np.ndarray, i: int) -> np.ndarray:
        """Insertions along a row; the system turn can't be inserted."""
        j = self._target(i)
        run = np.minimum.accumulate((h + INSERT * self.x)[::-1])[::-1] - INSERT * self.x
        return np.minimum(np.where(j >= 0, run, h), _NEVER)

    def _sub(self, i: int) -> np.ndarray:
        """What it costs to let row i take the letter of each cell; KEEP where it is its own."""
        c, j = self.letters[i], self._target(i)
        own = {ord("u"): (j >= 0) & (j % 2 == 0), ord("a"): (j >= 0) & (j % 2 == 1), ord("s"): (j == -1) & bool(self.system)}
        kept = own.get(c, np.zeros(len(j), bool))
        extra = CUT_OFF if self.faults[i] == TRUNCATED else 0
        return np.where(kept, KEEP + extra, np.where(j >= 0, REROLE + extra, _NEVER))

    def _row(self, i: int, below: np.ndarray) -> np.ndarray:
        if self.faults[i] in (BLANK, DUPLICATE):
            return np.minimum(below + DELETE, _NEVER)
        drop = np.full(len(below), _NEVER)
        drop[1:] = below[:-1] + DELETE
        return self._closed(np.minimum(drop, self._sub(i) + below), i)

    def _rows(self, start: int) -> list[np.ndarray]:
        """Rows start .. start + block - 1, filled again from the next kept row."""
        if start == 0:
            return self.first
        stop = min(start + self.block, self.n)
        g, out = self.marks[stop], []
        for i in range(stop - 1, start - 1, -1):
            g = self._row(i, g)
            out.append(g)
        return out[::-1]

    def cost(self) -> int:
        return int((self.first[0] if self.n else self.marks[0])[self.width])

    def audit(self) -> str:
        """The least of all audits of the least cost."""
        out, x = [], self.width
        rows = self._rows(0) if self.n else []
        for i in range(self.n):
            if i and i % self.block == 0:
                rows = self._rows(i)
            g = rows[i % self.block]
            last = i + 1 == self.n
            below = self.marks[self.n] if last else self.marks[i + 1] if (i + 1) % self.block == 0 else rows[(i + 1) % self.block]
            forced = self.faults[i] in (BLANK, DUPLICATE)
            if forced:  # a deletion is the least letter and never worse here
                out.append("D")
                continue
            sub = self._sub(i)
            while True:
                if x > 0 and below[x - 1] == g[x] - DELETE:
                    out.append("D")
                    x -= 1
                elif x + 1 < len(g) and g[x + 1] == g[x] - INSERT and self._target(i)[x] >= 0:
                    out.append("I")
                    x += 1
                    continue
                else:
                    out.append("K" if sub[x] in (KEEP, KEEP + CUT_OFF) else "R")
                break
        g = self.marks[self.n]
        while g[x]:
            out.append("I")
            x += 1
        return "".join(out)


def cheapest(letters: bytes, faults: bytes) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair; of equally cheap ones the least audit."""
    if not letters:
        return 0, ""
    at_most = _greedy(letters, faults)
    fixed = sum(DELETE if f in (BLANK, DUPLICATE) else CUT_OFF if f == TRUNCATED else 0 for f in faults)
    tables = [_Table(letters, faults, system, at_most - fixed) for system in ((False, True) if b"s" in letters else (False,))]
    least = min(t.cost() for t in tables)
    return least, min(t.audit() for t in tables if t.cost() == least)


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def _digest(role: Column, text: Column) -> Column:
    """Equal for equal pairs of role and text, 16 bytes."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def _rows(messages: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")).withColumn(
        "digest", _digest(F.col("role"), F.col("text"))
    )


def faults(messages: DataFrame) -> DataFrame:
    """`(conv_id, turn, digest, letter, fault)` of every row; the fault is its first of blank, duplicate, truncated, else 0."""
    first = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    rows = _rows(messages).select(
        "conv_id",
        "turn",
        "digest",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("?").alias("letter"),
        F.when(_bare(F.col("text")) == "", BLANK)
        .when(~F.substring(_bare(F.col("text")), -1, 1).isin(".", "!", "?"), TRUNCATED)
        .otherwise(0)
        .alias("fault"),
    )
    again = F.row_number().over(first) > 1
    return rows.withColumn("fault", F.when((F.col("fault") != BLANK) & again, DUPLICATE).otherwise(F.col("fault")).cast("tinyint"))


_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _id_kind(messages: DataFrame) -> StructType:
    return StructType([StructField("conv_id", messages.schema["conv_id"].dataType)])


def audits(messages: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """One row per conversation: `conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`.

    `messages` has `conv_id, turn, role, text`. The audit spells the edits in order:
    Keep, Rerole, Delete, Insert. `also` names (by `conv_id`) conversations that are
    to have a row even without messages: zeros and an empty audit.
    """
    slim = faults(messages)
    if also is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in slim.dtypes if c != "conv_id"]
        slim = slim.unionByName(also.select("conv_id").distinct().select("conv_id", *none))
    placed = slim.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "digest", F.col("fault") == DUPLICATE
    )
    out = StructType(_id_kind(messages).fields + StructType.fromDDL(_REPORT).fields)
    schema = to_arrow_schema(out)

    def report(conv, state, known) -> tuple:
        letters, found = bytes(state["letters"]), bytes(state["faults"])
        pairs = sum(letters[i : i + 2] not in (b"su", b"ua", b"au") for i in range(len(letters) - 1))
        cost, audit = known(letters, found) if len(letters) <= 64 else cheapest(letters, found)
        gaps = state["hi"] - state["lo"] + 1 - state["turns"] if state["turns"] else 0
        return conv, gaps, found.count(BLANK), found.count(DUPLICATE), found.count(TRUNCATED), pairs, cost, audit

    def fresh() -> dict:
        return {"letters": bytearray(), "faults": bytearray(), "lo": None, "hi": None, "turns": 0}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(1 << 12)(cheapest)  # at most 4096 x 64 rows; short conversations are much alike
        now, state, done, size = None, None, [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "fault")]
            for conv, turn, letter, fault in zip(*cols):
                if state is None or conv != now:
                    if state is not None:
                        done.append(report(now, state, known))
                        size += len(done[-1][-1])
                        if len(done) >= 4096 or size > 1 << 20:
                            yield _batch(done, schema)
                            done, size = [], 0
                    now, state = conv, fresh()
                if letter is None:  # a conversation named by `also`
                    continue
                state["letters"].append(ord(letter))
                state["faults"].append(fault)
                if turn is not None and turn != state["hi"]:
                    state["lo"] = turn if state["lo"] is None else state["lo"]
                    state["hi"] = turn
                    state["turns"] += 1
        if state is not None:
            done.append(report(now, state, known))
        if done:
            yield _batch(done, schema)

    return placed.mapInArrow(task, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _stream(messages: DataFrame, audited: DataFrame) -> DataFrame:
    """The audit of each conversation, then its rows in order, in one task."""
    rows = _rows(messages).select("conv_id", F.lit(1).alias("part"), "turn", "digest", F.lit(None).cast("string").alias("audit"), "role", "text")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c not in ("conv_id", "part", "audit")]
    heads = audited.select("conv_id", F.lit(0).alias("part"), "audit", *nothing)
    return (
        rows.unionByName(heads)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "digest")
        .select("conv_id", "part", "audit", "role", "text")
    )


def _mended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, edit, role, text) of the repaired turns; (conv_id, -1, None, None, None) begins each conversation."""
    conv, audit, at, place, first = None, "", 0, 0, 0

    def role_at(p: int) -> str:
        return "system" if p < first else "user" if (p - first) % 2 == 0 else "assistant"

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "part", "audit", "role", "text")]
        for conv_id, part, edits, role, text in zip(*cols):
            if part == 0:
                while at < len(audit):  # insertions at the end of the last conversation
                    yield conv, place, "I", role_at(place), ""
                    at, place = at + 1, place + 1
                conv, audit, at, place = conv_id, edits, 0, 0
                first = (len(audit) - audit.count("D")) % 2
                yield conv, -1, None, None, None
                continue
            while audit[at] == "I":
                yield conv, place, "I", role_at(place), ""
                at, place = at + 1, place + 1
            if audit[at] != "D":
                yield conv, place, audit[at], role if audit[at] == "K" else role_at(place), text
                place += 1
            at += 1
    while at < len(audit):
        yield conv, place, "I", role_at(place), ""
        at, place = at + 1, place + 1


def repaired(messages: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired conversations as rows: `conv_id, place, edit, role, text`, `place` from 0."""
    out = StructType(_id_kind(messages).fields + StructType.fromDDL("place bigint, edit string, role string, text string").fields)
    schema = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for row in _mended(batches):
            if row[1] >= 0:
                done.append(row)
                size += len(row[4])
            if len(done) >= 4096 or size > 1 << 20:
                yield _batch(done, schema)
                done, size = [], 0
        if done:
            yield _batch(done, schema)

    return _stream(messages, audited).mapInArrow(task, out)


def digests(messages: DataFrame, audited: DataFrame) -> DataFrame:
    """`conv_id, repaired_sha256`: the digest of `role:text` of the repaired rows, joined by newlines."""
    out = StructType(_id_kind(messages).fields + StructType.fromDDL("repaired_sha256 string").fields)
    schema = to_arrow_schema(out)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, done = None, None, []
        for conv_id, place, _, role, text in _mended(batches):
            if place < 0:
                if sha is not None:
                    done.append((conv, sha.hexdigest()))
                    if len(done) >= 4096:
                        yield _batch(done, schema)
                        done = []
                conv, sha = conv_id, hashlib.sha256()
                continue
            sha.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        if sha is not None:
            done.append((conv, sha.hexdigest()))
        if done:
            yield _batch(done, schema)

    return _stream(messages, audited).mapInArrow(task, out)
