"""Streamed queries: the event table read as a stream until it is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docmem.operators import schema
from docmem.plans import query
from docmem.plans.folds import LIST_ITEMS, LIST_PLAIN, K
from docmem.session import shared_dir
from docmem.sources import testdata as td
from docmem.streaming import edits as se
from docmem.streaming import materialised as mt
from docmem.streaming import profiles as sp


def _stream(spark, sf):
    schema = td.table(spark, sf, "events").schema
    # a pattern, as a stream source takes no single file by its plain name
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")


def _fresh(spark):
    return f"{shared_dir(spark)}/docmem-stream-{uuid.uuid4().hex}"


def _updates(spark, df):
    """Run an update-mode stream and return what it sent out, by micro-batch."""
    where = _fresh(spark)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{where}/out/batch_id={batch_id}")

    q = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out")


@query("stream_fold", f"SELECT * FROM {LIST_ITEMS} UNION ALL SELECT db_id, path, NULL, value FROM {LIST_PLAIN}")
def stream_fold(spark, sf):
    """Edits are appended to the log as they come; the log gives the batch fold."""
    where = _fresh(spark)
    log = td.list_edits_of(_stream(spark, sf))
    se.append_to_log(log, f"{where}/log", f"{where}/checkpoint").awaitTermination()
    return se.refold(spark, f"{where}/log", nested=False).select("db_id", "path", "pos", "value")


def _batches(spark, sf, n=4, table="events", key="event_id"):
    """A table as a stream of `n` micro-batches, dealt out at random: each batch of events has late ones."""
    rows = td.table(spark, sf, table)
    where = f"{_fresh(spark)}/{table}"
    files = n * max(1, -(-rows.rdd.getNumPartitions() // n))
    rows.repartition(files, F.xxhash64(key)).write.parquet(where)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // n).parquet(where)


@query("stream_fold_incremental", f"SELECT * FROM {LIST_ITEMS} UNION ALL SELECT db_id, path, NULL, value FROM {LIST_PLAIN}")
def stream_fold_incremental(spark, sf):
    """Each micro-batch is folded onto the stored state of its owners; many of its edits are late."""
    where = _fresh(spark)
    log = td.list_edits_of(_batches(spark, sf))
    mt.materialise(log, f"{where}/fold", f"{where}/checkpoint", buckets=16, horizon=1 << 10).awaitTermination()
    return mt.current(spark, f"{where}/fold", buckets=16).select("db_id", "path", "pos", "value")


@query("stream_state_fold", f"SELECT * FROM {LIST_ITEMS} UNION ALL SELECT db_id, path, NULL, value FROM {LIST_PLAIN}")
def stream_state_fold(spark, sf):
    """State per path; late edits, of which every batch has many, take their places."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        sent = _updates(spark, se.state_fold(td.list_edits_of(_batches(spark, sf)), horizon=1 << 40))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return se.sent_values(sent).select("db_id", "path", "pos", "value")


@query(
    "stream_last_value",
    f"""SELECT user_id AS db_id, '$.' || event_type || '.k' AS path, arg_max({K}, event_id) AS value
FROM events GROUP BY ALL""",
)
def stream_last_value(spark, sf):
    sent = _updates(spark, se.last_values(td.field_edits_of(_stream(spark, sf))))
    return sent.groupBy("db_id", "path").agg(F.max_by("value", "seq").alias("value"))


@query(
    "stream_thread_touch",
    "SELECT user_id AS thread_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM events GROUP BY user_id",
)
def stream_thread_touch(spark, sf):
    messages = _stream(spark, sf).select(F.col("user_id").alias("thread_id"), F.col("ts").alias("created_at"))
    sent = _updates(spark, se.thread_touch(messages))
    last = sent.groupBy("thread_id").agg(F.max("updated_at").alias("t"))
    return last.select("thread_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


@query(
    "stream_schema_drift",
    """SELECT path, old_types, new_types, change FROM (VALUES
('$.nation', 'integer', 'string', 'retyped'), ('$.market.segment', 'string', NULL, 'removed'), ('$.market', 'object', NULL, 'removed'),
('$.supplier', NULL, 'boolean', 'added')) t(path, old_types, new_types, change)""",
)
def stream_schema_drift(spark, sf):
    """Suppliers come as a stream of batches; their types by path are state, compared with the customers' profile."""
    streamed = td.supplier_docs_of(_batches(spark, sf, 4, "supplier", "s_suppkey"))
    sent = _updates(spark, sp.type_counts(streamed, max_depth=3))
    return sp.drift(schema.profile(td.customer_docs(spark, sf), max_depth=3, containers=True), sent)
