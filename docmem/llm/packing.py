"""Best-fit packing of token sequences.

Texts become token ids, long documents are cut into full sequences and a rest,
and the rests are packed online: each goes into the open bin with the least
free space that still fits. A fixed number of bins is open at a time; the bins
stand in a bitset keyed by free space, so the best fit is the lowest set bit at
or above the size, and when a new bin is needed the fullest one is closed.

Pieces are dealt out to tasks of bounded size by hash. The pieces of bins that
are still open at the end of a task are packed again together with those of
other tasks, level by level, so that only the last level leaves bins half full.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .text import give_back, split_words, text_runs

LENGTH = 4096
OPEN = 2048
PER_TASK = 16384  # pieces packed in one task
JOIN = 16  # tasks whose rests are packed together
CACHED = 32 << 20  # bytes of words that a task remembers
WORD_BYTES = 220  # of a remembered word beside its letters and ids: two objects and a place in the table
END = 1

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


class Parts(dict):
    """Ids of parts of words from the BPE model; parts that two generations in a row have not asked for are forgotten."""

    def __init__(self, model):
        self.model = model
        # bytes stand for themselves where printable, the others follow from 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in kept]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        self.before: dict[str, bytes] = {}
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.held = 0

    def age(self) -> None:
        self.before = dict(self)
        self.begin()

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(self.shown)
            found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes() if part else b""
        self[part] = found
        self.held += WORD_BYTES + 5 * len(part)
        return found


class WordIds:
    """Token ids of words, remembered for a while.

    The vocabulary's pre-tokenizer cuts at blanks and finds the same parts in any text of
    Latin letters and ASCII as its own pattern does here, so those parts go straight to
    the BPE model. Other texts go word by word: the ids of a text are those of its words.
    Plain words (Latin letters and a run of ASCII signs) are two parts; all others go
    through the whole tokenizer.
    """

    letter, small, sign = "A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff", "a-z\\u00df-\\u00f6\\u00f8-\\u00ff", "!-/:-@\\[-`{-~"
    plain = re.compile(f"([{letter}]*)([{sign}]*)")
    plain_text = re.compile("[\\x20-\\x7e\\x09-\\x0d\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]*")
    cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{small}]+|[0-9]|[{sign}]+")

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.whole = Tokenizer.from_file(path)
        self.parts = Parts(self.whole.model)
        self.forget()

    def forget(self) -> None:
        self.parts.forget()
        self.forget_words()

    def forget_words(self) -> None:
        self.words: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        odd = []
        for w in words:
            m = self.plain.fullmatch(w)
            if m and not w.startswith("<|"):
                a, b = m.groups()
                self.words[w] = self.parts[a.lower()] + self.parts[b]
            else:
                odd.append(w)
        if odd:
            for w, e in zip(odd, self.whole.encode_batch_fast(odd, add_special_tokens=False)):
                self.words[w] = np.array(e.ids, "<u4").tobytes()
        self.held += sum(WORD_BYTES + 5 * len(w) for w in words)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if 2 * self.parts.held + self.held > CACHED:  # two generations of parts, and the words
            self.parts.age()
            self.forget_words()
        part, cut = self.parts.__getitem__, self.cut.findall
        split = [None if "<|" not in t and self.plain_text.fullmatch(t) else split_words(t) for t in texts]
        wanted = set().union(*(words for words in split if words))
        self.learn(wanted - self.words.keys())
        at = self.words.__getitem__
        return [b"".join(map(part, cut(t.lower())) if words is None else map(at, words)) for t, words in zip(texts, split)]


def word_ids(path: str | None) -> WordIds:
    """The tokenizer of this worker process, whose size is that of the vocabulary; words are forgotten after a task."""
    kept = sys.modules.setdefault("_docmem_word_ids", types.ModuleType("_docmem_word_ids")).__dict__
    if ("ids", path) not in kept:
        kept["ids", path] = WordIds(path)
    return kept["ids", path]


def tokenize(docs: DataFrame, path: str | None = None, length: int = LENGTH, digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each row of documents (doc_id, text).

    The ids end with `END`. NULL and empty texts give the end alone. Only documents
    of more than `length` ids are cut. With `digest`, `ids` is left out and
    `ids_crc32` given instead.
    """

    def run(batches):
        words = word_ids(path)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            out = []
            names = b.column("doc_id").to_pylist()
            for lo, texts in text_runs(b.column("text")):
                for name, ids in zip(names[lo : lo + len(texts)], words.texts([t or "" for t in texts])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[at : at + 4 * length]
                        out.append((name, piece, at // 4, len(cut) // 4, zlib.crc32(cut) if digest else cut))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids"],
            )
        words.forget()
        give_back()

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, PIECE.replace("ids binary", "ids_crc32 bigint") if digest else PIECE)


class OpenBins:
    """Open bins in a bitset keyed by free space; `close` gets each bin that is closed."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.mask, self.count, self.made = 0, 0, 0
        self.at: dict[int, list[int]] = {}
        self.closed: set[int] = set()

    def _take(self, free: int) -> int:
        bins = self.at[free]
        out = bins.pop()
        if not bins:
            self.mask &= ~(1 << free)
        self.count -= 1
        return out

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fitting = self.mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count == self.most:
                self.closed.add(self._take((self.mask & -self.mask).bit_length() - 1))
            bin_, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.at.setdefault(left, []).append(bin_)
            self.mask |= 1 << left
            self.count += 1
        else:
            self.closed.add(bin_)
        return bin_, self.capacity - free


def _task_packer(length: int, open_bins: int, level: int, last: bool):
    def run(key, rows):
        rows = rows.sort_values("_h", kind="stable")
        bins = OpenBins(length, open_bins)
        placed = [bins.add(int(s)) for s in rows["length"]]
        number = np.array([b for b, _ in placed], np.int64)
        done = np.array([last or b in bins.closed for b, _ in placed])
        first = (level << 24 | int(key[0])) << 28
        return rows.assign(
            sequence_id=np.where(done, (first + number) * 2 + 1, -1), offset=np.array([o for _, o in placed], np.int64)
        )

    return run


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN, per_task: int = PER_TASK) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a `length` of 1 to `length`; other columns are kept.

    Pieces of full length are sequences of their own. Repeated rows are packed as
    often as they occur. The result depends on how the rows are stored, and any
    result is a valid packing.
    """
    kept = pieces.columns
    held = tables.written(pieces.withColumn("_id", F.monotonically_increasing_id()))
    full = held.where(F.col("length") >= length).withColumns(
        {"sequence_id": F.col("_id") * 2, "offset": F.lit(0).cast("bigint")}
    )
    out = [full.select(*kept, "sequence_id", "offset")]
    rest = held.where(F.col("length") < length).withColumn("_h", F.xxhash64("_id"))
    n = rest.count()
    tasks = max(1, -(-n // per_task))
    rest = rest.withColumn("_task", F.pmod(F.xxhash64("_h"), F.lit(tasks)))
    level = 0
    while True:
        last = tasks == 1

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
        placed = tables.written(
            rest.groupBy("_task").applyInPandas(_task_packer(length, open_bins, level, last), f"{schema}, sequence_id bigint, offset bigint")
        )
        out.append(placed.where("sequence_id >= 0").select(*kept, "sequence_id", "offset"))
        if last:
            break
        tasks, level = -(-tasks // JOIN), level + 1
        rest = (
            placed.where("sequence_id < 0")
            .drop("sequence_id", "offset")
            .withColumn("_task", F.floor(F.col("_task") / JOIN))
        )
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, ids of at most `length` tokens as binary."""
    placed = pack(tokenize(docs, path, length), length)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `length` pieces
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids")
    )
