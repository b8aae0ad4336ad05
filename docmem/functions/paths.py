"""Document paths.

Two uses. *Builders* (`field`, `each`, `where`, ...) compose a Column that takes
the matches of a path out of one VARIANT document; they are plain functions from
`array<variant>` to `array<variant>`. *Path text* such as `$.a.b` is data: it
names the place an edit writes to, and is taken apart with SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmem.functions.jsontext import Col, col, variant_text

Step = Callable[[Column], Column]
Predicate = Callable[[Column], Column]

# Fixed patterns of the path text.
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_-]*$"
STEP = r'\.[^.\["]+|\["(?:[^"\\]|\\.)*"\]|\[\d+\]|\[\*\]'
STATIC_PATH = r'^\$(?:\.[A-Za-z_][A-Za-z0-9_-]*|\["[^"]+"\])+$'
READ_PATH = (
    r"^\$(?:"
    r"\.\.?[A-Za-z_][A-Za-z0-9_-]*"
    r'|\["[^"]+"\]'
    r"|\[\*\]|\[-?\d+\]|\[-?\d*:-?\d*\]"
    r"|\[[\\/][A-Za-z_][A-Za-z0-9_]*(?:,\s*[\\/][A-Za-z_][A-Za-z0-9_]*)*\]"
    r'|\[\?\(?\s*(?:@\.)?[A-Za-z_][A-Za-z0-9_.]*\s*(?:==?|!=|<=?|>=?|=~)\s*(?:"[^"]*"|-?\d+(?:\.\d+)?)\s*\)?\]'
    r"|\.`(?:len|keys|this|sub\(/(?:[^/\\`]|\\.)*/,\s*(?:[^)\\`]|\\.)*\)|split\(\s*[^`]+?\s*,\s*-?\d+\s*,\s*-?\d+\s*\))`"
    r")*$"
)
# list path, selecting field and JSON literal (both empty for `[*]`), target field
ELEMENT_PATH = (
    r"^(\$(?:\.[A-Za-z_][A-Za-z0-9_-]*)+)"
    r'\[(?:\*|\?\s*([A-Za-z_][A-Za-z0-9_]*)\s*==?\s*("[^"]*"|-?\d+(?:\.\d+)?)\s*)\]'
    r"\.([A-Za-z_][A-Za-z0-9_]*)$"
)
# any edit of list elements: list path, selector, field, operator and literal of a test, keys below the element
ANY_ELEMENT_PATH = (
    r"^(\$(?:\.[A-Za-z_][A-Za-z0-9_-]*)+)"
    r"\[(\*|-?\d+|\?\(?\s*(?:@\.)?([A-Za-z_][A-Za-z0-9_]*)\s*(==?|!=|<=?|>=?)"
    r'\s*("[^"]*"|-?\d+(?:\.\d+)?)\s*\)?)\]'
    r"((?:\.[A-Za-z_][A-Za-z0-9_]*)*)$"
)


# ---- builders over one document ------------------------------------------------


def matches(doc: Col, *steps: Step) -> Column:
    """All matches of a path in one document, in order, as `array<variant>`."""
    found = F.array(col(doc))
    for step in steps:
        found = step(found)
    return found


def field(name: str) -> Step:
    """Descend into an object; elements without the field are no match."""
    where_to = f'$["{name}"]'
    return lambda m: F.filter(
        F.transform(m, lambda x: F.try_variant_get(x, where_to, "variant")),
        lambda x: x.isNotNull(),
    )


def each() -> Step:
    """One match per list element."""
    return lambda m: F.flatten(
        F.filter(
            F.transform(m, lambda x: F.try_variant_get(x, "$", "array<variant>")),
            lambda x: x.isNotNull(),
        )
    )


def where(*tests: Predicate) -> Step:
    """Keep the elements of the matched lists that pass every test."""

    def step(m: Column) -> Column:
        def ok(x: Column) -> Column:
            out = F.lit(True)
            for test in tests:
                out = out & F.coalesce(test(x), F.lit(False))
            return out

        return F.filter(each()(m), ok)

    return step


def _typed(name: str, like: object) -> Callable[[Column], Column]:
    """The field as the type of `like`; NULL when it holds another type."""
    kind = "boolean" if isinstance(like, bool) else "double" if isinstance(like, int | float) else "string"
    of_kind = {"boolean": "^BOOLEAN$", "double": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "string": "^STRING$"}[kind]

    def get(x: Column) -> Column:
        found = F.try_variant_get(x, f'$["{name}"]', "variant")
        return F.when(F.schema_of_variant(found).rlike(of_kind), F.try_variant_get(found, "$", kind))

    return get


def eq(name: str, value: object) -> Predicate:
    get = _typed(name, value)
    return lambda x: get(x) == F.lit(value)


def compare(name: str, op: str, value: object) -> Predicate:
    """`<`, `<=`, `>`, `>=`, `!=` on numbers or on text such as ISO dates."""
    get = _typed(name, value)
    tests = {
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "!=": lambda a, b: a != b,
    }
    return lambda x: tests[op](get(x), F.lit(value))


def regex(name: str, pattern: str) -> Predicate:
    """Search in strings (not full match), case-sensitive; other types do not match."""
    get = _typed(name, "")
    return lambda x: get(x).rlike(pattern)


def eq_any_case(name: str, value: str) -> Predicate:
    get = _typed(name, "")
    return lambda x: F.lower(get(x)) == value.lower()


def order(*keys: tuple[str, str, bool]) -> Step:
    """Sort each matched list by `(name, type, descending)` keys.

    The match stays one list, as in the path language; `each` or `where` follows.
    Elements without a key come last.
    """

    def step(m: Column) -> Column:
        def cmp(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for name, kind, down in reversed(keys):
                x = F.try_variant_get(a, f'$["{name}"]', kind)
                y = F.try_variant_get(b, f'$["{name}"]', kind)
                lo, hi = (1, -1) if down else (-1, 1)
                out = (
                    F.when(x < y, lo)
                    .when(x > y, hi)
                    .when(x.isNull() & y.isNotNull(), 1)
                    .when(x.isNotNull() & y.isNull(), -1)
                    .otherwise(out)
                )
            return out

        lists = F.filter(
            F.transform(m, lambda x: F.try_variant_get(x, "$", "array<variant>")), lambda x: x.isNotNull()
        )
        return F.transform(lists, lambda x: F.to_variant_object(F.array_sort(x, cmp)))

    return step


def index(i: int) -> Step:
    """`[i]`; a negative index counts from the end."""
    at = i + 1 if i >= 0 else i
    return lambda m: F.filter(
        F.transform(
            m, lambda x: F.try_element_at(F.try_variant_get(x, "$", "array<variant>"), F.lit(at))
        ),
        lambda x: x.isNotNull(),
    )


def part(start: int | None, stop: int | None) -> Step:
    """`[start:stop]`; a negative bound counts from the end, an open one (None) is the end."""

    def cut(x: Column) -> Column:
        items = F.try_variant_get(x, "$", "array<variant>")
        n = F.size(items)

        def bound(b: int | None, none: Column) -> Column:
            return none if b is None else F.greatest(n + b, F.lit(0)) if b < 0 else F.least(F.lit(b), n)

        first = bound(start, F.lit(0))
        return F.slice(items, first + 1, F.greatest(bound(stop, n) - first, F.lit(0)))

    return lambda m: F.flatten(F.filter(F.transform(m, cut), lambda x: x.isNotNull()))


def split(sep: str, i: int) -> Callable[[Column], Column]:
    """Piece `i` of each matched string, cut at `sep` (a regular expression)."""
    return lambda m: F.transform(m, lambda x: F.try_element_at(F.split(variant_text(x), sep), F.lit(i + 1)))


def sub(pattern: str, repl: str) -> Callable[[Column], Column]:
    """Each matched string with every occurrence of `pattern` replaced."""
    return lambda m: F.transform(m, lambda x: F.regexp_replace(variant_text(x), pattern, repl))


def length() -> Callable[[Column], Column]:
    """`len` of each matched list, object or string, as `array<int>`."""
    return lambda m: F.transform(
        m,
        lambda x: F.coalesce(
            F.array_size(F.try_variant_get(x, "$", "array<variant>")),
            F.array_size(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>"))),
            F.length(variant_text(x)),
        ),
    )


def texts() -> Callable[[Column], Column]:
    return lambda m: F.transform(m, variant_text)


# ---- path text -----------------------------------------------------------------


def key_step(key: Col) -> Column:
    """The path step of an object key, quoted unless it is a plain name."""
    k = col(key)
    escaped = F.replace(F.replace(k, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(k.rlike(PLAIN_KEY), F.concat(F.lit("."), k)).otherwise(
        F.concat(F.lit('["'), escaped, F.lit('"]'))
    )


def steps_of(path: Col) -> Column:
    return F.regexp_extract_all(col(path), F.lit(STEP), F.lit(0))


def depth_of(path: Col) -> Column:
    return F.size(steps_of(path))


def prefixes_of(path: Col) -> Column:
    """Paths of all proper ancestors below the root."""
    steps = steps_of(path)
    return F.when(
        F.size(steps) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(steps) - 1),
            lambda i: F.concat(F.lit("$"), F.array_join(F.slice(steps, F.lit(1), i), "")),
        ),
    ).otherwise(F.array().cast("array<string>"))


def simplify(path: Col) -> Column:
    """The path without bracket and backtick parts."""
    return F.regexp_replace(F.regexp_replace(col(path), r"\[.*?\]", ""), r"`.*?`", "")


def normalise_quotes(path: Col) -> Column:
    """Single-quoted keys and literals to double quotes; apostrophes stay."""
    keys = F.regexp_replace(col(path), r"\['([^'\]]*)'\]", '["$1"]')
    return F.regexp_replace(keys, r"(=~?\s*)'([^']*)'", '$1"$2"')


def one_form(path: Col) -> Column:
    """Quoted keys that are plain names without quotes, as the walk writes them."""
    return F.regexp_replace(col(path), r'\["([A-Za-z_][A-Za-z0-9_-]*)"\]', ".$1")


def any_index(path: Col) -> Column:
    """List positions as `[*]`, so that all elements share one path."""
    return F.regexp_replace(col(path), r"\[\d+\]", "[*]")
