"""Edit streams.

The log is the state: a micro-batch only appends to it, so its cost does not
grow with the history, and late edits need no special care, since the fold
orders by `seq`. Current values come from folding the log, for all owners or
for those that changed; live values per path come from the two stateful queries
below.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmem.functions.jsontext import quote, text_kind
from docmem.operators import fold as fo
from docmem.operators import matching, validate

GOOD, BAD = "good", "quarantine"
EDIT_SCHEMA = "db_id string, seq bigint, path string, data string"


def append_to_log(edits: DataFrame, log: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Check streamed edits and append them to the log folder.

    Each micro-batch owns the folder of its number and replaces it when it is
    tried again after a failure, so no edit is lost or doubled. Bad edits go to
    the folder's quarantine with their fault.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate.check_edits(batch)
        state = F.when(F.col("fault").isNull(), GOOD).otherwise(BAD)
        checked = checked.withColumn("state", state).withColumn("batch_id", F.lit(batch_id))
        (
            checked.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id", "state")
            .parquet(log)
        )

    return (
        edits.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def once(edits: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Drop edits delivered again within `delay`."""
    return edits.withWatermark(time, delay).dropDuplicatesWithinWatermark(["db_id", "seq"])


def read_log(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).where(F.col("state") == GOOD).select("db_id", "seq", "path", "data")


def read_quarantine(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).where(F.col("state") == BAD).select("batch_id", "db_id", "seq", "path", "data", "fault")


def changed_since(spark: SparkSession, log: str, batch_id: int) -> DataFrame:
    """Owners with edits in micro-batches after `batch_id` (prunes log folders)."""
    return spark.read.parquet(log).where((F.col("batch_id") > batch_id) & (F.col("state") == GOOD)).select("db_id").distinct()


def refold(spark: SparkSession, log: str, since: int | None = None, **options) -> DataFrame:
    """Fold the log; with `since` only the owners that changed after that batch."""
    edits = read_log(spark, log)
    if since is not None:
        edits = edits.join(changed_since(spark, log, since), "db_id", "left_semi")
    return matching.replay(edits, **options)


def last_values(edits: DataFrame) -> DataFrame:
    """Streaming last write per path (update mode). State: one row per path."""
    return fo.last_values(edits)


def thread_touch(messages: DataFrame, time: str = "created_at") -> DataFrame:
    """Streaming `updated_at` per thread (update mode)."""
    return messages.groupBy("thread_id").agg(F.max(time).alias("updated_at"))


STATE = "start bigint, last bigint, seqs array<bigint>, data array<string>"
SENT = "array<struct<seq bigint, idx int, value string, in_list boolean, late boolean>>"
SENT_AT_ONCE = 4096  # rows that travel as one text
NEVER, LONG_AGO = (1 << 62), -(1 << 62)


def _path_fold(horizon: int):
    """Values of one path, with room for edits that come late.

    List elements are sent out as they arrive and are not kept. The state has where the
    list starts, the newest edit, and the plain edits before the list that a late list
    edit may still turn into elements: those that are newer than the newest edit by less
    than `horizon`, so the state of a path stays small. Most paths bring few edits at once,
    and what a call takes is mostly that of its columns, so edits come and rows go as one text.
    """

    def fold(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, seqs, data = state.get if state.exists else (NEVER, LONG_AGO, [], [])
        held = dict(zip(seqs, data))
        arrived: dict[int, tuple] = {}
        for rows in chunks:
            for seq, text, items in map(json.loads, rows["edit"].tolist()):
                if seq is not None:  # no place in the order without a number
                    arrived.setdefault(int(seq), (text, items))
        sent = []  # (seq, idx, value, in_list, late)
        fresh = {}
        for seq, edit in arrived.items():
            if seq <= last - horizon:
                sent.append((seq, 0, None, False, True))
            else:
                fresh[seq] = edit
        begins = min([start, *(seq for seq, (_, items) in fresh.items() if items is not None)])
        if begins < start:  # the list starts earlier than known: plain edits since then are its elements
            sent += [(seq, 0, text, True, False) for seq, text in held.items() if seq >= begins]
            held = {seq: text for seq, text in held.items() if seq < begins}
        for seq, (text, items) in fresh.items():
            if seq < begins:
                held.setdefault(seq, text)
                sent.append((seq, 0, text, False, False))
            elif items is None:
                sent.append((seq, 0, text, True, False))
            else:  # an empty list shows as one element without a value
                sent += [(seq, i, item, True, False) for i, item in enumerate(items or [None])]
        last = max(last, max(arrived))
        held = {seq: text for seq, text in held.items() if seq > last - horizon}
        state.update((begins, last, list(held), list(held.values())))
        names = ("seq", "idx", "value", "in_list", "late")
        told = [
            json.dumps([dict(zip(names, row)) for row in sent[i : i + SENT_AT_ONCE]], ensure_ascii=False)
            for i in range(0, len(sent), SENT_AT_ONCE)
        ]
        # as objects: the NULL of one owner must not make floats of the numbers of others
        owner = np.full(len(told), None if pd.isna(key[0]) else key[0], object)
        yield pd.DataFrame({"db_id": owner, "path": key[1], "sent": told})

    return fold


def state_fold(edits: DataFrame, horizon: int = 1 << 16) -> DataFrame:
    """Stateful fold per path, for logs without nested paths.

    Emits `(db_id, path, seq, idx, value, in_list, late)`: plain values and list elements
    as they arrive, `(seq, idx)` being the place of an element in its list; an empty list
    shows as one element without a value. Late edits take their place: a late list edit
    makes elements of the plain edits after it. `sent_values` puts all that was sent
    together. Only an edit older than its path's newest by more than `horizon` sequence
    numbers is reported as `late` instead of applied; its owner is then to be folded
    again from the log (`refold`). Keyed by `(db_id, path)`, so a busy owner is spread
    over its paths. What one path brings at once is bounded by the micro-batch
    (`maxFilesPerTrigger` or its like).
    """
    v = F.parse_json("data").cast("array<variant>")
    items = F.when(text_kind("data") == "list", F.transform(v, lambda x: F.to_json(x)))
    seq = F.coalesce(F.col("seq").cast("string"), F.lit("null"))
    edit = F.concat(F.lit("["), seq, F.lit(","), quote("data"), F.lit(","), F.coalesce(F.to_json(items), F.lit("null")), F.lit("]"))
    typed = fo.drop_na(edits).select("db_id", "path", edit.alias("edit"))
    owner = edits.schema["db_id"].dataType.simpleString()
    told = typed.groupBy("db_id", "path").applyInPandasWithState(
        _path_fold(horizon),
        outputStructType=f"db_id {owner}, path string, sent string",
        stateStructType=STATE,
        outputMode="update",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
    return told.select("db_id", "path", F.inline(F.from_json("sent", SENT)))


def sent_values(sent: DataFrame) -> DataFrame:
    """All rows that `state_fold` has sent out as fold rows, positions included.

    A plain edit that a late list has made an element was sent twice; it counts as that.
    """
    elements = F.array_sort(F.collect_set(F.when(F.col("in_list"), F.struct("idx", "value"))))
    edits = (
        sent.where("NOT late")
        .groupBy("db_id", "path", "seq")
        .agg(F.max("in_list").alias("listed"), elements.alias("e"), F.max(F.when(~F.col("in_list"), F.col("value"))).alias("plain"))
    )
    items = F.filter(F.transform("e", lambda x: x["value"]), lambda x: x.isNotNull())
    return fo.fold_writes(
        edits.select(
            "db_id",
            "path",
            "seq",
            F.when(F.col("listed"), F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(F.col("plain")).alias("value"),
            F.when(F.col("listed"), "list").otherwise("scalar").alias("kind"),
            F.lit(False).alias("marker"),
        )
    )
