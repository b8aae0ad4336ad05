"""Streams against the batch fold of the same edits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docmem.operators import fold as fo
from docmem.streaming import edits as se

ROWS = []
for owner in ("a", "b", "c"):
    for i in range(24):
        data = json.dumps([i, "x"]) if i % 5 == 3 else json.dumps(i)
        ROWS.append((owner, i, f"$.p{i % 3}", data))
BAD = ("a", 99, "$.p1", "plain words")


@pytest.fixture
def source(spark, tmp_path):
    """The edits in four files, one micro-batch each."""
    folder = str(tmp_path / "in")
    rows = ROWS + [BAD]
    for part in range(4):
        df = spark.createDataFrame(rows[part::4] if part != 3 else rows[3::4], se.EDIT_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(se.EDIT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def values(df):
    return sorted((r.db_id, r.path, -1 if r.pos is None else r.pos, r.value) for r in df.collect())


def test_stream_fold_equals_batch_fold(spark, source, tmp_path):
    log = str(tmp_path / "log")
    se.append_to_log(source(), log, str(tmp_path / "cp")).awaitTermination()
    want = values(fo.fold(spark.createDataFrame(ROWS, se.EDIT_SCHEMA)))
    assert values(se.refold(spark, log)) == want
    assert [(r.data, r.fault) for r in se.read_quarantine(spark, log).collect()] == [("plain words", "data")]
    # a second run finds nothing new and changes nothing
    se.append_to_log(source(), log, str(tmp_path / "cp")).awaitTermination()
    assert values(se.refold(spark, log)) == want
    changed = {r.db_id for r in se.changed_since(spark, log, 2).collect()}
    assert values(se.refold(spark, log, since=2)) == [w for w in want if w[0] in changed]


def test_stream_last_value(spark, source):
    q = (
        se.last_values(source())
        .writeStream.outputMode("update")
        .format("memory")
        .queryName("last_values")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = (
        spark.table("last_values").groupBy("db_id", "path").agg(F.max_by("value", "seq").alias("v")).collect()
    )
    want = {}
    for d, s, p, v in sorted(ROWS + [BAD], key=lambda r: r[1]):
        want[d, p] = v
    assert {(r.db_id, r.path): r.v for r in got} == want


def run_state_fold(spark, tmp_path, parts, horizon):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    folder = str(tmp_path / "parts")
    for part in parts:
        spark.createDataFrame(part, se.EDIT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(se.EDIT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = se.state_fold(stream, horizon).writeStream.outputMode("update")
    q = q.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/sent/batch={n}"))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(f"{tmp_path}/sent")


def test_stream_state_fold(spark, tmp_path):
    rows = ROWS + [("d", 1, "$.e", "[]"), ("d", 2, "$.f", "null"), ("d", 3, "$.f", "[null, 1]"), ("d", 0, "$.f", "7")]
    parts = [rows[i::3] for i in range(3)]  # each batch comes late for the one before
    random.Random(4).shuffle(parts)
    sent = run_state_fold(spark, tmp_path, parts, horizon=1 << 20)
    assert sent.where("late").count() == 0
    assert values(se.sent_values(sent)) == values(fo.fold(spark.createDataFrame(rows, se.EDIT_SCHEMA)))


def test_state_fold_of_numbered_owners_beside_none(spark, tmp_path):
    """Edits without an owner stay apart from those of numbered ones, and numbers stay exact."""
    key = 1 << 60
    rows = [(None if i % 7 == 3 else key + i % 5, i, f"$.p{i % 3}", json.dumps([i]) if i % 4 == 2 else json.dumps(i)) for i in range(400)]
    folder, typed = str(tmp_path / "in"), "db_id bigint, seq bigint, path string, data string"
    for part in range(2):
        spark.createDataFrame(rows[part::2], typed).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(typed).option("maxFilesPerTrigger", 1).parquet(folder)
    q = se.state_fold(stream, 1 << 20).writeStream.outputMode("update")
    q = q.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/sent/batch={n}"))
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    owned = spark.createDataFrame([r for r in rows if r[0] is not None], typed)
    assert values(se.sent_values(spark.read.parquet(f"{tmp_path}/sent"))) == values(fo.fold(owned))


def test_state_is_bounded_by_the_horizon(spark, tmp_path):
    parts = [
        [("a", i, "$.p", str(i)) for i in range(0, 6000, 2)],
        [("a", 5001, "$.p", "[5001]"), ("a", 7, "$.p", "[7]")],  # late by less, and by more, than the horizon
        [("a", 4999, "$.p", "[4999]")],
    ]
    sent = run_state_fold(spark, tmp_path, parts, horizon=2000)
    assert [r.seq for r in sent.where("late").collect()] == [7]
    got = [r.value for r in se.sent_values(sent).where("pos IS NOT NULL").orderBy("pos").collect()]
    assert got == ["4999", "5000", "5001"] + [str(i) for i in range(5002, 6000, 2)]


def test_stream_thread_touch(spark, tmp_path):
    folder = str(tmp_path / "m")
    spark.createDataFrame([(1, 10), (1, 30), (2, 20)], "thread_id int, created_at int").write.parquet(folder)
    stream = spark.readStream.schema("thread_id int, created_at int").parquet(folder)
    q = (
        se.thread_touch(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("touched")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert {(r.thread_id, r.updated_at) for r in spark.table("touched").collect()} == {(1, 30), (2, 20)}


def test_repeated_delivery_is_dropped(spark, tmp_path):
    folder = str(tmp_path / "dups")
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 1, "2024-01-01 00:10:00"), ("a", 2, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "db_id string, seq bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(folder)
    q = (
        se.once(spark.readStream.schema(df.schema).parquet(folder), "ts")
        .writeStream.format("memory")
        .queryName("once")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    assert sorted(r.seq for r in spark.table("once").collect()) == [1, 2]
