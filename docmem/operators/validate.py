"""Checks of incoming edits and read requests; bad rows are set aside with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmem.functions.jsontext import is_json
from docmem.functions.paths import ANY_ELEMENT_PATH, READ_PATH, STATIC_PATH, normalise_quotes, one_form


def edit_fault(path: Column, data: Column) -> Column:
    """Why an edit cannot be applied, NULL when it can."""
    path_ok = path.rlike(STATIC_PATH) | path.rlike(ANY_ELEMENT_PATH) | (path == "NA")
    return F.when(~F.coalesce(path_ok, F.lit(False)), "path").when(~is_json(data), "data")


def check_edits(edits: DataFrame) -> DataFrame:
    """Edits with paths in one form (`$['a']` is `$.a`) and a `fault` column."""
    clean = edits.withColumn("path", one_form(normalise_quotes("path")))
    return clean.withColumn("fault", edit_fault(F.col("path"), F.col("data")))


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("fault").isNull()).drop("fault")


def quarantine(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("fault").isNotNull())


def check_requests(requests: DataFrame) -> DataFrame:
    """`ok` when every path of the list can be read; an empty list is fine."""
    usable = F.forall("path_list", lambda p: F.coalesce(normalise_quotes(p).rlike(READ_PATH) | (p == "NA"), F.lit(False)))
    return requests.withColumn("ok", F.coalesce(usable, F.lit(False)))


def check_qa(sets: DataFrame) -> DataFrame:
    """`ok` when there are as many answers as questions."""
    return sets.withColumn("ok", F.size("question") == F.size("answers"))
