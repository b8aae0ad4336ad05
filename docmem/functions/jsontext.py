"""Expressions over JSON text and VARIANT values.

Folds and groupings carry JSON *text*, since VARIANT can be neither grouped nor
ordered; VARIANT is used while a value is being taken apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """`body(x)` with `x` worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def is_json(text: Col) -> Column:
    """True when the whole text is one JSON value.

    `try_parse_json` stops after the first value and ignores what follows
    ("5 6" gives 5). The text is therefore parsed inside an array and inside an
    object: anything left over after the first value breaks one of the two.
    """
    t = col(text)
    in_list = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), "$", "array<variant>"
    )
    in_object = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit('{"d":'), t, F.lit(',"e":0}'))), "$", "map<string,variant>"
    )
    ok = (F.size(in_list) == 1) & (F.size(in_object) == 2)
    return F.coalesce(ok, F.lit(False))


def text_kind(text: Col) -> Column:
    """list / object / scalar, from the first character of valid JSON text."""
    head = F.substring(F.ltrim(col(text), F.lit(" \t\r\n")), 1, 1)
    return F.when(head == "[", "list").when(head == "{", "object").otherwise("scalar")


def json_type(v: Col) -> Column:
    """JSON schema type name of a VARIANT: null, boolean, integer, number, ..."""
    s = F.schema_of_variant(col(v))
    return (
        F.when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def quote(text: Col) -> Column:
    """A string as a JSON string literal; NULL becomes `null`."""
    wrapped = F.to_json(F.array(col(text)), {"ignoreNullFields": "false"})
    return wrapped.substr(F.lit(2), F.length(wrapped) - 2)


def variant_text(v: Col) -> Column:
    """The plain text of a scalar VARIANT (strings without quotes)."""
    return F.try_variant_get(col(v), "$", "string")
