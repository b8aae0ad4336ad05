"""Python kernels over Arrow batches: the leaves of VARIANT documents, and JSON text from leaves.

Both read or write each container once, however deep it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docmem.functions.paths import PLAIN_KEY, STEP

AT_ONCE = 1 << 14  # leaves that are built or read together
_LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("v", T.VariantType())])

# bytes of a VARIANT primitive by its type, header included; binary and long text say theirs
_FIXED = {0: 1, 1: 1, 2: 1, 3: 2, 4: 3, 5: 5, 6: 9, 7: 9, 8: 6, 9: 10, 10: 18, 11: 5, 12: 9, 13: 9, 14: 5, 17: 9, 18: 9, 19: 9, 20: 17}
_ENDS = "\n\r\x85\u2028\u2029"  # what Java takes for the end of a line
_PLAIN = re.compile(rf"{PLAIN_KEY[:-1]}(?:\r\n|[{_ENDS}])?\Z")
_STEP = re.compile(STEP.replace(r"\d", "[0-9]").replace(r"\\.", rf"\\[^{_ENDS}]"))
_BARE = re.compile(rf"\.[A-Za-z0-9_-]+(?:\r\n|[{_ENDS}])?\Z")
_ESCAPED = re.compile(rf"\\([^{_ENDS}])")
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def _number(b: bytes, at: int, size: int) -> int:
    return int.from_bytes(b[at : at + size], "little")


@lru_cache(1024)
def _key_steps(metadata: bytes) -> list[str]:
    """The path step of each key of a VARIANT's dictionary."""
    size = (metadata[0] >> 6) + 1
    n = _number(metadata, 1, size)
    ends = [_number(metadata, 1 + size * (i + 1), size) for i in range(n + 1)]
    text = 1 + size * (n + 2)
    keys = [metadata[text + a : text + b].decode() for a, b in zip(ends, ends[1:])]
    escaped = [k.replace("\\", "\\\\").replace('"', '\\"') for k in keys]
    return [f".{k}" if _PLAIN.match(k) else f'["{e}"]' for k, e in zip(keys, escaped)]


def _inside(value: bytes, at: int) -> tuple[int, int, int, int, int]:
    """Of the container at `at`: its size, where its ids and offsets start, bytes of an offset, where its values start."""
    head, is_object = value[at] >> 2, value[at] & 3 == 2
    width, ids = (head & 3) + 1, ((head >> 2 & 3) + 1 if is_object else 0)
    if head >> (4 if is_object else 2) & 1:
        n, first = _number(value, at + 1, 4), at + 5
    else:
        n, first = value[at + 1], at + 2
    return n, first, first + n * ids, width, first + n * ids + (n + 1) * width


def _size(value: bytes, at: int) -> int:
    head = value[at]
    if head & 3 == 1:
        return 1 + (head >> 2)
    if head & 3 == 0:
        kind = head >> 2
        if kind in (15, 16):
            return 5 + _number(value, at + 1, 4)
        if kind not in _FIXED:
            raise ValueError(f"unknown VARIANT type {kind}")
        return _FIXED[kind]
    n, _, offsets, width, values = _inside(value, at)
    return values - at + _number(value, offsets + n * width, width)


def leaves_of(value: bytes, metadata: bytes, root: str, enter_lists: bool) -> list[tuple[str, bytes]]:
    """(path, VARIANT value) of the scalars and empty containers below a value."""
    steps, out, todo = _key_steps(metadata), [], [(root, 0)]
    while todo:
        path, at = todo.pop()
        kind = value[at] & 3
        if kind == 2 or (kind == 3 and enter_lists):
            n, ids, offsets, width, values = _inside(value, at)
            if n:
                if width == 1:
                    places = [values + x for x in value[offsets : offsets + n]]
                else:
                    places = [values + _number(value, offsets + i * width, width) for i in range(n)]
                if kind == 3:
                    todo += [(f"{path}[{i}]", x) for i, x in enumerate(places)]
                    continue
                wide = (offsets - ids) // n
                keys = value[ids:offsets] if wide == 1 else [_number(value, ids + i * wide, wide) for i in range(n)]
                todo += [(path + steps[k], x) for k, x in zip(keys, places)]
                continue
        out.append((path, value[at : at + _size(value, at)]))
    return out


def opened(path: Column, v: Column, enter_lists: bool) -> Column:
    """All leaves of `v` as `array<struct<path, v>>`."""
    returned = T.ArrayType(_LEAF)
    arrow = to_arrow_type(returned)
    leaf = arrow.value_type
    variant = leaf.field("v").type

    def built(rows: list[list[tuple]], metadata: list[bytes | None]) -> pa.Array:
        ends, paths, values, names = [0], [], [], []
        for row, m in zip(rows, metadata):
            paths += [p for p, _ in row]
            values += [x for _, x in row]
            names += [m] * len(row)
            ends.append(len(paths))
        missing = pa.array([x is None for x in values], pa.bool_())
        parts = [pa.array([x or b"" for x in column], pa.binary()) for column in (values, names)]
        v = pa.StructArray.from_arrays(parts, fields=[variant.field(i) for i in range(2)], mask=missing)
        both = pa.StructArray.from_arrays([pa.array(paths, pa.string()), v], fields=[leaf.field(i) for i in range(2)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both, type=arrow)

    def walk(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for roots, docs in batches:
            docs = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
            given, rows, kept, n = docs.is_valid().to_pylist(), [], [], 0
            columns = [docs.field(variant.field(i).name).to_pylist() for i in range(2)]
            for root, here, value, metadata in zip(roots.to_pylist(), given, *columns):
                found = leaves_of(value, metadata, root or "", enter_lists) if here else [(root, None)]
                rows.append([(None, x) for _, x in found] if root is None else found)
                kept.append(metadata if here else None)
                n += len(found)
                if n >= AT_ONCE:
                    yield built(rows, kept)
                    rows, kept, n = [], [], 0
            if rows:
                yield built(rows, kept)

    return F.arrow_udf(walk, returned, F.ArrowUDFType.SCALAR_ITER)(path, v)


# ---- JSON text from leaves -----------------------------------------------------

_NO_PLACE, _FIELD, _ITEM = 0, 1, 2


def _quoted(text: str) -> str:
    return '"' + re.sub(r'["\\\x00-\x1f]', lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'


class _Places(dict):
    """The place of a path step: a field with its key as JSON text, or an item with its number, -1 for `[*]`."""

    def __missing__(self, step: str) -> tuple[int, object]:
        if step.startswith("[") and not step.startswith('["'):
            i = -1 if step == "[*]" else int(step[1:-1])
            place = (_ITEM, i) if i < 1 << 63 else (_NO_PLACE, 0)
        elif _BARE.match(step):
            place = (_FIELD, f'"{step[1:]}":')
        else:
            place = (_FIELD, _quoted(step[1:] if step.startswith(".") else _ESCAPED.sub(r"\1", step[2:-2])) + ":")
        if len(self) < 1 << 16:  # keys that are data must not fill the memory
            self[step] = place
        return place


class _Paths(dict):
    """The places of a path. Those of its parent are remembered, as siblings share it."""

    def __init__(self, places: _Places):
        self.places = places

    def __missing__(self, parent: str) -> tuple:
        if len(self) >= 1 << 14:
            self.clear()
        at = self[parent] = tuple([self.places[s] for s in _STEP.findall(parent)])
        return at

    def of(self, path: str) -> tuple:
        if path.endswith("]"):
            i = path.rfind("[")
            plain = i >= 0 and path[i + 1 : -1].isdecimal() and path.isascii()
        else:
            i = path.rfind(".")
            plain = 0 <= i < len(path) - 1 and "[" not in path[i:] and '"' not in path[i:]
        if plain:  # no step of the parent can reach into such a last one
            return (*self[path[:i]], self.places[path[i:]])
        return tuple([self.places[s] for s in _STEP.findall(path)])


def _shared(a: tuple, b: tuple) -> int:
    """How many places two paths share at their beginning."""
    least = min(len(a), len(b))
    for n in range(least, max(least - 4, -1), -1):  # mostly nearly all
        if a[:n] == b[:n]:
            return n
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _clash(at: tuple) -> ValueError:
    return ValueError(f"a value and children at the same place below {list(at)}")


def _stays(at: tuple, value: str, after: tuple, common: int, deepest: int) -> bool:
    """Does a leaf stay in the text beside the next one? Empty containers above others go; of equal places the last stays."""
    n = len(at)
    if common == n:
        if len(after) == n:
            return n == deepest and at[-1] != (_ITEM, -1)
        kind, i = after[n]
        if (kind == _FIELD and value == "{}") or (kind != _FIELD and i != -1 and value == "[]"):
            return False
        raise _clash(at)
    mine, other = at[common], after[common]
    if (mine[0] == _FIELD) != (other[0] == _FIELD) or (_ITEM, -1) in (mine, other):
        raise _clash(at)
    return True


def written(rows: list[tuple[tuple, str]], deepest: int) -> str:
    """JSON text of the leaves `(places, value)` of one document.

    What two neighbours share at the beginning of their paths stays open between them.
    """
    rows = sorted(rows)
    cuts = [_shared(a, b) for (a, _), (b, _) in zip(rows, rows[1:])]
    stay = [_stays(*x, after, common, deepest) for x, (after, _), common in zip(rows, rows[1:], cuts)]
    if not all(stay):
        rows = [x for x, kept in zip(rows, [*stay, True]) if kept]
        cuts = [_shared(a, b) for (a, _), (b, _) in zip(rows, rows[1:])]
    out, before = [], -1
    for (at, value), common in zip(rows, [*cuts, -1]):
        after = min(common, len(at) - 1)  # paths that come twice part at their last place
        if before >= 0:
            out.append("," + at[before][1] if at[before][0] == _FIELD else ",")
        out += ["{" + x if kind == _FIELD else "[" for kind, x in at[before + 1 :]]
        out.append(value)
        out += ["}" if kind == _FIELD else "]" for kind, _ in reversed(at[after + 1 :])]
        before = after
    return "".join(out)


def most_steps(path: Column) -> Column:
    """Numbers of which the largest is that of steps of the longest path; only paths that may be longer are looked at."""

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        best = 0
        for batch in batches:
            marks = pc.add(pc.count_substring(batch, "."), pc.count_substring(batch, "["))  # every step has one of them
            longer = pc.fill_null(pc.greater(marks, best), False)
            for path, n in zip(batch.filter(longer).to_pylist(), marks.filter(longer).to_pylist()):
                if n > best:
                    best = max(best, len(_STEP.findall(path)))
            yield pa.array([best] * len(batch), pa.int32())

    return F.arrow_udf(count, T.IntegerType(), F.ArrowUDFType.SCALAR_ITER)(path)


def text_of_leaves(leaves: Column, deepest: int) -> Column:
    """The document of its leaves `array<struct<path, value>>` as JSON text; a path deeper than `deepest` fails."""

    def write(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        paths = _Paths(_Places())
        for batch in batches:
            out = []
            ends = batch.offsets.to_pylist()
            for first, end in zip(ends, ends[1:]):
                rows, any_ = [], False
                part = batch.values.slice(first, end - first)
                for path, value in zip(part.field("path").to_pylist(), part.field("value").to_pylist()):
                    if path is None:
                        any_ = any_ or value is not None
                        continue
                    at = paths.of(path)
                    if len(at) > deepest:
                        raise ValueError(f"nesting deeper than {deepest} levels at {path}")
                    if value is None:  # a NULL is no field; of a list it leaves the list, be it empty
                        up = next((i for i in range(len(at) - 1, -1, -1) if at[i][0] == _ITEM and at[i][1] >= 0), None)
                        if up is None:
                            continue
                        at, value = at[:up], "[]"
                    rows.append((at, value))
                out.append(written(rows, deepest) if rows else "" if any_ else None)
            yield pa.array(out, pa.string())

    return F.arrow_udf(write, T.StringType(), F.ArrowUDFType.SCALAR_ITER)(leaves)
