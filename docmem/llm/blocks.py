"""Exchange of packed arrays.

Tasks cut what they have into buckets and send one binary block per bucket and
batch; the blocks of a bucket meet in one task. Numbers travel as arrays, which
takes a fraction of the bytes and the time of one row per number. The caller
chooses so many buckets that each stays small whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import give_back

BUCKET_BYTES = 16 << 20


def buckets_for(total_bytes: int) -> int:
    return max(8, -(-int(total_bytes) // BUCKET_BYTES))


def packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one block: their lengths, then their bytes."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], "<i8")
    return b"".join([head.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])


def unpacked(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    n = int(np.frombuffer(block, "<i8", 1)[0])
    sizes = np.frombuffer(block, "<i8", n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(block, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def gathered(blocks: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    """The arrays of several blocks, each kind joined."""
    parts = [unpacked(b, kinds) for b in blocks]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """`packed`, compressed: bytes of equal weight lie together, which makes sorted keys small."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T for a in arrays]
    whole = packed(planes)
    return np.array([len(whole)], "<i8").tobytes() + pa.compress(whole, "zstd", asbytes=True)


def unsqueezed(block: bytes, kinds: list[str]) -> list[np.ndarray]:
    size = int(np.frombuffer(block, "<i8", 1)[0])
    planes = unpacked(pa.decompress(pa.py_buffer(block)[8:], size, "zstd", asbytes=True), ["u1"] * len(kinds))
    widths = [np.dtype(k).itemsize for k in kinds]
    return [np.ascontiguousarray(a.reshape(w, -1).T).reshape(-1).view(k) for a, w, k in zip(planes, widths, kinds)]


def exchange(
    df: DataFrame,
    cut: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes]]],
    merge: Callable[[int, list[bytes]], pa.Table],
    schema: str,
) -> DataFrame:
    """`cut` gives (bucket, block) for the batches of a task, `merge` the rows of a bucket's blocks."""

    def send(batches):
        for bucket, block in cut(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"]
            )

    def meet(group: pa.Table) -> pa.Table:
        out = merge(group.column("bucket")[0].as_py(), group.column("block").to_pylist())
        give_back()
        return out

    return df.mapInArrow(send, "bucket int, block binary").groupBy("bucket").applyInArrow(meet, schema)


def spans(counts: np.ndarray) -> np.ndarray:
    """[0 .. n-1] repeated by counts."""
    return np.repeat(np.arange(len(counts)), counts)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    for b, at in zip(found, np.split(order, starts[1:])):
        yield int(b), at
