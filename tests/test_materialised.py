"""The materialised fold against the batch fold of the same edits."""

import json
import os
import random
import shutil

from docmem.operators import fold as fo
from docmem.streaming import edits as se
from docmem.streaming import materialised as mt


def nested_log(r, owners, seqs):
    rows = []
    for o in range(owners):
        for seq in range(seqs):
            path = r.choice(["$.a", "$.a.b", "$.a.b.c", "$.l", "$.l", "$.x"])
            data = r.choice([1, "s", None, [], [seq, {"k": 1}], {"b": 2}, {"b": {"c": [seq]}, "d": 0}, {}])
            rows.append((f"o{o}", seq, path, json.dumps(data)))
    return rows


def values(df):
    return sorted((x.db_id, x.path, -1 if x.pos is None else x.pos, x.value) for x in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, se.EDIT_SCHEMA)


def test_batches_equal_the_batch_fold(spark, tmp_path):
    r = random.Random(11)
    rows = nested_log(r, 10, 24)
    order = sorted(rows, key=lambda x: x[1] + r.random() * 14)  # some late by more than the horizon
    parts = [order[k : k + 80] for k in range(0, len(order), 80)]
    root = str(tmp_path / "fold")
    sent = []
    for n, part in enumerate(parts):
        again = random.Random(n).sample(sent, min(5, len(sent)))  # delivered twice
        mt.apply(frame(spark, part + again + [("o1", 900 + n, "$.x", "no json"), ("o2", 990, "NA", "{}")]), n, root, 4, horizon=8)
        sent += part
        if n == len(parts) - 1:
            mt.apply(frame(spark, part), n, root, 4, horizon=8)  # tried again
            assert values(mt.current(spark, root, buckets=4)) == values(fo.fold(frame(spark, sent)))
    some = spark.createDataFrame([("o3",), ("o5",), ("nobody",)], "db_id string")
    want = [x for x in values(fo.fold(frame(spark, rows))) if x[0] in ("o3", "o5")]
    assert values(mt.current(spark, root, some, 4)) == want
    assert spark.read.parquet(f"{root}/bad").count() == len(parts)
    assert len(os.listdir(f"{root}/manifest")) <= 3


def test_compaction_drops_what_no_longer_counts(spark, tmp_path):
    rows = [("a", i, "$.n", str(i)) for i in range(200)] + [("a", 300 + i, "$.m.k", str(i)) for i in range(50)]
    root = str(tmp_path / "fold")
    for n in range(3):
        mt.apply(frame(spark, rows[n * 90 : n * 90 + 90]), n, root, 2, horizon=10)
    held = spark.read.parquet(*mt.state_folders(spark, root))
    assert held.count() <= 2 + 11 + 1
    assert values(mt.current(spark, root, buckets=2)) == [("a", "$.m.k", -1, "49"), ("a", "$.n", -1, "199")]


def test_edits_of_list_elements(spark, tmp_path):
    rows = [("a", 1, "$.l", '[{"n": 1}, {"n": 2}]'), ("a", 5, "$.l[?n = 2].x", '"y"'), ("a", 9, "$.l", '{"n": 2}'), ("a", 12, "$.l[-1].z", "3")]
    root = str(tmp_path / "fold")
    for n, part in enumerate((rows[1:2] + rows[3:], rows[:1] + rows[2:3])):
        mt.apply(frame(spark, part), n, root, 2, horizon=2)
    got = [json.loads(x[3]) for x in values(mt.current(spark, root, buckets=2))]
    assert got == [{"n": 1}, {"n": 2, "x": "y"}, {"n": 2, "z": 3}]


def test_log_folders_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mt, "FAN", 3)
    root = str(tmp_path / "fold")
    for n in range(4):
        mt.apply(frame(spark, [("a", n, "$.l", f"[{n}]")]), n, root, 2)
    assert mt.log_folders(spark, root) == {mt_bucket(spark, "a", 2): 2}
    mt.apply(frame(spark, [("a", -5, "$.l", "[-5]"), ("a", 100, "$.l", "[100]")]), 4, root, 2, horizon=3)  # the floor moves up ...
    mt.apply(frame(spark, [("a", -9, "$.l", "[-9]")]), 5, root, 2, horizon=3)  # ... and the log is read again
    assert [x[3] for x in values(mt.current(spark, root, buckets=2))] == ["-9", "-5", *map(str, range(4)), "100"]


def mt_bucket(spark, owner, buckets):
    return spark.sql(f"SELECT '{owner}' AS db_id").select(mt.bucket_of(buckets)).first()[0]


def test_untouched_buckets_are_not_read(spark, tmp_path):
    root = str(tmp_path / "fold")
    mt.apply(frame(spark, [(f"o{i}", 1, "$.l", "[1]") for i in range(40)]), 0, root, 8)
    one = frame(spark, [("o7", 2, "$.l", "2"), ("o7", 0, "$.l", "[0]")])
    mine = mt.state_folders(spark, root, one, 8)
    assert len(mine) == 1
    for folder in set(mt.state_folders(spark, root)) - set(mine):  # whoever reads these fails
        for name in os.listdir(folder):
            if name.endswith(".parquet"):
                shutil.copy(__file__, f"{folder}/{name}")
    for folder in os.listdir(f"{root}/log/gen=0"):
        if folder.startswith("bucket=") and not mine[0].endswith(folder):
            for name in os.listdir(f"{root}/log/gen=0/{folder}"):
                if name.endswith(".parquet"):
                    shutil.copy(__file__, f"{root}/log/gen=0/{folder}/{name}")
    mt.apply(one, 1, root, 8, horizon=0)
    mt.apply(frame(spark, [("o7", -1, "$.l", "[-1]")]), 2, root, 8, horizon=0)
    got = values(mt.current(spark, root, one.select("db_id"), 8))
    assert [x[3] for x in got] == ["-1", "0", "1", "2"]
