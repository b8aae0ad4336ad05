"""Words and sizes of texts, as column expressions and for tasks in Python."""

from __future__ import annotations

import ctypes
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")
ODD_BLANKS = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")


def words(text: Column) -> Column:
    """The words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    """How many words a text has (bigint); 0 for NULL."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS))).cast("bigint")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: str) -> list[str]:
    """Words in Python. `str.split` is faster but knows more blanks, so it serves only texts without those."""
    return WORD.findall(text) if ODD_BLANKS.search(text) else text.split()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and serve the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_runs(column: pa.ChunkedArray | pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of some `most` bytes of an Arrow column of texts; a task holds one run as Python objects."""
    sizes = [n or 0 for n in pc.binary_length(column).to_pylist()]
    lo, size = 0, 0
    for i, n in enumerate(sizes):
        if size + n + 1 > most and i > lo:
            yield lo, column.slice(lo, i - lo).to_pylist()
            lo, size = i, 0
        size += n + 1
    if sizes:
        yield lo, column.slice(lo).to_pylist()
        give_back()


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z in lower case. `bytes.split` and `bytes.lower` know ASCII only, which is what is wanted."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
