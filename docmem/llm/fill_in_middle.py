"""Fill-in-the-middle transformation by secondary sort.

A task cuts each text into its units (words with the blanks before them), draws the
two cuts and the form from a hash of the document id, and emits *pieces*: runs of
whole units, keyed by row and place in the output. Spark deals pieces out by row and
sorts them by place within each partition, so that a task sees every output as a
stream and needs one piece at a time, for digests or for writing. For restoration
the pieces are told by the marks that they follow, sorted within the partition again
by their place in the text, and stream past once more; the second sort needs no
further exchange.

Forms: `plain` leaves the text as it is, `psm` gives prefix, suffix, middle and `spm`
suffix, prefix, middle, each after its mark.

Defined cases. A NULL text is empty; an empty text, or one that holds a mark, is
plain. A NULL id is drawn from like an empty one. Rows are told apart by their place
in the input, so repeated ids and rows each give their own output. Blanks are the
ASCII blanks; a run of blanks at the end of a text is a unit of its own. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MARKS = {"P": "<P>", "S": "<S>", "M": "<M>"}
ORDERS = {"psm": "PSM", "spm": "SPM"}
UNITS = 8192  # units in a piece
RUN = 1 << 20  # bytes a task emits at once

_META = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
_PIECE = f"row bigint, place int, mark string, piece binary, {_META}"
_NO_META = (None,) * 5


def unit_ends(text: bytes) -> np.ndarray:
    """Where each unit ends, in bytes. Blanks are single bytes in UTF-8, so bytes are all it takes."""
    b = np.frombuffer(text, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(b))


def drawn(doc_id: int | None, n: int, seed: int, fim: int, spm: int) -> tuple[int, int, str]:
    """(units before the middle, units before the suffix, form) from the hash of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    return cuts[0], cuts[1], "plain" if h3 % 100 >= fim else "spm" if h4 % 100 < spm else "psm"


def _chars(text: bytes) -> int:
    return int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())


def _pieces_of(row: int, doc_id: int | None, text: bytes, seed: int, fim: int, spm: int) -> Iterator[tuple]:
    ends = unit_ends(text)
    n = len(ends)
    lo, hi, form = drawn(doc_id, n, seed, fim, spm)
    if not n or any(m.encode() in text for m in MARKS.values()):
        form = "plain"
    at = lambda k: int(ends[k - 1]) if k else 0
    if form == "plain":
        parts, meta = [("", 0, n)], (doc_id, n, form, None, None)
    else:
        where = {"P": (0, lo), "M": (lo, hi), "S": (hi, n)}
        parts = [(MARKS[c], *where[c]) for c in ORDERS[form]]
        meta = (doc_id, n, form, _chars(text[: at(lo)]), _chars(text[at(lo) : at(hi)]))
    place = 0
    for mark, first, last in parts:
        for k in range(first, max(last, first + 1), UNITS):
            yield row, place, mark if k == first else "", text[at(k) : at(min(k + UNITS, last))], *(_NO_META if place else meta)
            place += 1


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pieces(docs: DataFrame, seed: int = 42, fim: int = 50, spm: int = 80) -> DataFrame:
    """The outputs as pieces, dealt out by row and sorted by place in the output.

    `docs` has `doc_id, text`. The columns are `row, place, mark, piece`; the first
    piece of a row also has `doc_id, n, form, prefix_chars, middle_chars`. Of 100
    documents some `fim` are transformed, of these `spm` in a hundred as `spm`.
    """
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    schema = _schema(_PIECE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for batch in batches:
            ids, names = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for i in range(batch.num_rows):
                for piece in _pieces_of(ids[i], names[i], texts[i].as_py(), seed, fim, spm):
                    done.append(piece)
                    size += len(piece[3]) + 64
                    if size > RUN:
                        yield _batch(done, schema)
                        done, size = [], 0
        if done:
            yield _batch(done, schema)

    return numbered.mapInArrow(cut, _PIECE).repartition("row").sortWithinPartitions("row", "place")


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def outputs(placed: DataFrame) -> DataFrame:
    """The outputs of `pieces` as texts: `doc_id, n, form, prefix_chars, middle_chars, output`."""
    ddl = f"{_META}, output string"
    schema = _schema(ddl)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meta, parts, size, done = None, [], 0, []
        for batch in batches:
            marks = batch.column("mark").to_pylist()
            places, found = batch.column("place").to_pylist(), batch.column("piece")
            for i in range(batch.num_rows):
                if places[i] == 0:
                    if meta is not None:
                        done.append((*meta, b"".join(parts).decode("utf-8", "surrogatepass")))
                        size += len(done[-1][-1]) + 64
                        if size > RUN:
                            yield _batch(done, schema)
                            done, size = [], 0
                    meta, parts = _meta(batch, i), []
                parts += [marks[i].encode(), found[i].as_py()]
        if meta is not None:
            done.append((*meta, b"".join(parts).decode("utf-8", "surrogatepass")))
            yield _batch(done, schema)

    return placed.mapInArrow(join, ddl)


def _meta(batch: pa.RecordBatch, i: int) -> tuple:
    return tuple(batch.column(c)[i].as_py() for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars"))


_SEGMENT = {m: "PMS".index(c) for c, m in MARKS.items()}  # the order of the text
_BACK = f"row bigint, segment int, place int, piece binary, {_META}, output_sha256 string"


def in_text_order(placed: DataFrame) -> DataFrame:
    """Pieces of outputs back in the order of their texts, under one row each with the digest of the output.

    That row has segment -1 and the columns of the document. Segments are told by the
    marks in the output alone.
    """
    schema = _schema(_BACK)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, meta, sha, segment = None, None, None, 0
        for batch in batches:
            heads, segments = [], []
            rows, places = batch.column("row").to_pylist(), batch.column("place").to_pylist()
            marks, found = batch.column("mark").to_pylist(), batch.column("piece")
            for i in range(batch.num_rows):
                if places[i] == 0:
                    if sha is not None:
                        heads.append((row, -1, 0, b"", *meta, sha.hexdigest()))
                    row, meta, sha, segment = rows[i], _meta(batch, i), hashlib.sha256(), 0
                if marks[i]:
                    sha.update(marks[i].encode())
                    segment = _SEGMENT[marks[i]]
                sha.update(found[i].as_buffer())
                segments.append(segment)
            if heads:
                yield _batch(heads, schema)
            n = batch.num_rows
            told = [batch.column("row"), pa.array(segments, pa.int32()), batch.column("place"), found]
            yield pa.RecordBatch.from_arrays([*told, *[pa.nulls(n, f.type) for f in list(schema)[4:]]], schema=schema)
        if sha is not None:
            yield _batch([(row, -1, 0, b"", *meta, sha.hexdigest())], schema)

    return placed.mapInArrow(tell, _BACK).sortWithinPartitions("row", "segment", "place")


def digests(placed: DataFrame) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256` of `pieces`."""
    ddl = f"{_META}, output_sha256 string, restored_sha256 string"
    schema = _schema(ddl)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sha, done = None, None, []
        for batch in batches:
            segments, found = batch.column("segment").to_pylist(), batch.column("piece")
            for i in range(batch.num_rows):
                if segments[i] < 0:
                    if head is not None:
                        done.append((*head, sha.hexdigest()))
                    head = (*_meta(batch, i), batch.column("output_sha256")[i].as_py())
                    sha = hashlib.sha256()
                else:
                    sha.update(found[i].as_buffer())
            if len(done) >= 4096:
                yield _batch(done, schema)
                done = []
        if head is not None:
            done.append((*head, sha.hexdigest()))
        if done:
            yield _batch(done, schema)

    return in_text_order(placed).mapInArrow(read, ddl)
