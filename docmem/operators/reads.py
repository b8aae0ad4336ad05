"""Read requests: several paths per document, answered in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions.paths import key_step
from docmem.operators.leaves import is_container, list_items, object_entries, walked

# One place in a document: plain or quoted keys and list positions.
ONE_PLACE = r"""^\$(\.[A-Za-z_][A-Za-z0-9_-]*|\[\d+\]|\["[^"\\\]]*"\])*$"""


def fetch(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers `(db_id, path, value)` of `requests(db_id, path_list)`.

    The paths are data; each names one place. `NA` asks for nothing, a path
    without a match gives no row, JSON null is a match. Paths of other forms are
    left out here; `requests.fetch_any` answers all forms.
    """
    asked = requests.select("db_id", F.explode("path_list").alias("path")).where(F.col("path").rlike(ONE_PLACE))
    found = asked.join(docs.select("db_id", "doc"), "db_id").withColumn(
        "v", F.try_variant_get("doc", F.regexp_replace("path", r"\.([A-Za-z_][A-Za-z0-9_-]*)", '["$1"]'), "variant")
    )
    return found.where(F.col("v").isNotNull()).select("db_id", "path", F.to_json("v").alias("value"))


def as_text(found: Column) -> Column:
    """A list of matches as one JSON text."""
    return F.to_json(found)


def descendants(docs: DataFrame, name: str, max_depth: int | None = None) -> DataFrame:
    """`..name`: `(..., path, v)` for the value under the key `name` at any depth, containers included.

    A field that is found is kept as it is and also walked on. The depth comes from
    the data unless the caller knows it (`max_depth`).
    """
    if max_depth is None:
        return walked(docs, lambda some, n: descendants(some, name, n))
    keep = [c for c in docs.columns if c != "doc"]
    out = docs.select(*keep, F.lit("$").alias("path"), F.col("doc").alias("v"), F.lit(False).alias("_hit"))

    def child(step: Column, v: Column, hit: bool) -> Column:
        return F.struct(F.concat(F.col("path"), step).alias("path"), v.alias("v"), F.lit(hit).alias("_hit"))

    for _ in range(max_depth):
        opened = out.withColumns(
            {
                "_fields": F.coalesce(F.when(~F.col("_hit"), object_entries("v")), F.array()),
                "_items": F.coalesce(F.when(~F.col("_hit"), list_items("v")), F.array()),
            }
        )
        found = F.filter("_fields", lambda e: e["key"] == name)
        children = F.concat(
            F.transform("_fields", lambda e: child(key_step(e["key"]), e["value"], False)),
            F.transform(found, lambda e: child(key_step(e["key"]), e["value"], True)),
            F.transform("_items", lambda x, i: child(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x, False)),
        )
        own = F.array(F.struct("path", "v", "_hit"))
        out = opened.select(*keep, F.explode(F.when(F.col("_hit"), own).otherwise(children)).alias("c")).select(*keep, "c.*")
    deep = F.raise_error(F.concat(F.lit(f"nesting deeper than {max_depth} levels at "), F.col("path"))).cast("boolean")
    return out.where(F.when(~F.col("_hit") & is_container("v"), deep).otherwise(F.col("_hit"))).drop("_hit")
