"""Relational side: inserts, updates, widening, splitting documents into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions.paths import steps_of
from docmem.operators.leaves import leaves


SYSTEM = ("sqlite_", "system.")


def insert_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows that fit the table, by column name."""
    return table.unionByName(rows.select(*table.columns))


def widen(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Add rows with further columns; old rows hold NULL there."""
    return table.unionByName(rows, allowMissingColumns=True)


def patch_rows(
    table: DataFrame, patches: DataFrame, key: str, fields: dict[str, Column], order: str | None = None
) -> DataFrame:
    """Partial update by key: `fields` name the columns to set, each with the
    condition (over the patch, as `p.<column>`) under which it is set. A set
    field may become NULL; fields that are not set keep their value.

    Of several patches of a key the latest by `order` counts, one without an order
    before all others; without an order column the largest row.
    """
    row = F.struct(*[F.col(c) for c in patches.columns])
    latest = F.max(row) if order is None else F.max_by(row, F.struct(F.col(order).isNotNull(), F.col(order)))
    patches = patches.groupBy(key).agg(latest.alias("_row")).select("_row.*")
    b, p = table.alias("b"), patches.withColumn("_hit", F.lit(True)).alias("p")
    joined = b.join(p, F.col(f"b.{key}") == F.col(f"p.{key}"), "left")
    hit = F.coalesce(F.col("p._hit"), F.lit(False))

    def column(name: str) -> Column:
        if name not in fields:
            return F.col(f"b.{name}")
        is_set = hit & F.coalesce(fields[name], F.lit(False))
        return F.when(is_set, F.col(f"p.{name}")).otherwise(F.col(f"b.{name}")).alias(name)

    return joined.select(*[column(c) for c in table.columns])


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def split_into_tables(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Documents as cells of one table per top-level key.

    `(table_name, db_id, item, column_name, value)`: `db_id` is the foreign key
    to the document; `item` numbers the elements where the top-level value is a
    list, else 0. Scalars under a top-level key are the column `value`.
    """
    rows = leaves(docs.select("db_id", "doc"), max_depth=max_depth)
    steps = steps_of("path")
    top = F.regexp_replace(F.element_at(steps, 1), r'^\.|^\["|"\]$', "")
    second = F.try_element_at(steps, F.lit(2))
    number = F.regexp_extract(F.coalesce(second, F.lit("")), r"^\[(\d+)\]$", 1)
    item = F.when(number != "", number).cast("int")
    skip = F.when(item.isNotNull(), 2).otherwise(1)
    rest = F.array_join(F.slice(steps, skip + 1, F.greatest(F.size(steps) - skip, F.lit(0))), "")
    name = F.regexp_replace(rest, r"^\.", "")
    return rows.where(F.size(steps) > 0).select(
        top.alias("table_name"),
        "db_id",
        F.coalesce(item, F.lit(0)).alias("item"),
        F.when(name == "", "value").otherwise(name).alias("column_name"),
        "value",
    )


def table_of(cells: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One of the split tables in wide form: `(db_id, item, columns...)`."""
    return (
        cells.where(F.col("table_name") == name)
        .groupBy("db_id", "item")
        .agg(*[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in columns])
    )


def relate_children(docs: DataFrame, field: str) -> DataFrame:
    """List elements as child rows `(parent_id, child_no, child)` of their document."""
    return docs.select(
        F.col("db_id").alias("parent_id"),
        F.posexplode(F.try_variant_get("doc", f'$["{field}"]', "array<variant>")).alias("child_no", "child"),
    )


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    keys = parents.select(F.col(parent_key).alias(child_key)).distinct()
    return children.join(keys, child_key, "left_anti")


def row_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def user_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Without the system's own tables, whose names start with `sqlite_` or `system.`."""
    return {k: v for k, v in tables.items() if not k.lower().startswith(SYSTEM)}


def dump(tables: dict[str, DataFrame]) -> DataFrame:
    """Every row of every user table as `(table_name, row)` with JSON text rows."""
    out: DataFrame | None = None
    for name, df in user_tables(tables).items():
        part = df.select(F.lit(name).alias("table_name"), row_text(df).alias("row"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no tables to dump")
    return out


def listing(tables: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Columns of every table: `(table_name, pos, column_name, type, pk, filled)`.

    `filled` counts the values that are not NULL, all columns in one pass.
    """
    out: DataFrame | None = None
    for name, df in user_tables(tables).items():
        counted = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("pos"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.lit(keys.get(name) == f.name).alias("pk"),
                    F.col(f.name).alias("filled"),
                )
                for i, f in enumerate(df.schema.fields)
            ]
        )
        part = counted.select(F.lit(name).alias("table_name"), F.explode(rows).alias("r")).select("table_name", "r.*")
        out = part if out is None else out.unionAll(part)
    if out is None:
        raise ValueError("no tables to list")
    return out
