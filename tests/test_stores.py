"""Files, document folders, keyed stores."""

import json

from pyspark.sql import functions as F

from docmem.operators import extract, tables
from docmem.sources import documents, files, keyed


def test_document_folder(spark, tmp_path):
    (tmp_path / "2024-04-06.json").write_text(json.dumps({"education": [{"year": "2010"}]}, indent=4))
    (tmp_path / "with space.json").write_text("{}")
    (tmp_path / "2024-04-06-desc.json").write_text(json.dumps({"education": "schools", "user": {"name": "full name"}}))
    (tmp_path / "broken.json").write_text('{"a": 1')
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    stored = documents.read_folder(spark, str(tmp_path))
    assert {r.db_id for r in stored.collect()} == {"2024-04-06", "with space"}
    assert {r.db_id for r in documents.folder_faults(spark, str(tmp_path)).collect()} == {"broken", "twice"}
    asked = spark.createDataFrame([("2024-04-06",), ("with space",), ("unknown",)], "db_id string")
    got = {r.db_id: json.loads(r.d) for r in documents.lookup(asked, stored).select("db_id", F.to_json("doc").alias("d")).collect()}
    assert got == {"2024-04-06": {"education": [{"year": "2010"}]}, "with space": {}, "unknown": {}}
    notes = {(r.db_id, r.path, r.description) for r in documents.read_descriptions(spark, str(tmp_path)).collect()}
    assert notes == {("2024-04-06", "$.education", "schools"), ("2024-04-06", "$.user.name", "full name")}


def test_saved_documents_are_replaced(spark, tmp_path):
    folder = str(tmp_path / "docs")
    rows = [(f"d{i}", json.dumps({"v": i})) for i in range(50)]
    documents.save(spark.createDataFrame(rows, "db_id string, doc string"), folder, buckets=4)
    changed = spark.createDataFrame([("d7", '{"v":70}'), ("new", "{}")], "db_id string, doc string")
    documents.replace(spark, folder, changed)
    got = {r.db_id: r.doc for r in documents.load(spark, folder).collect()}
    assert got == {**dict(rows), "d7": '{"v":70}', "new": "{}"}
    more = spark.createDataFrame([("d8", "[]"), ("newer", "{}")], "db_id string, doc string")
    documents.save(more, folder, buckets=9)  # the first choice of buckets holds
    got = {r.db_id: r.doc for r in documents.load(spark, folder).collect()}
    assert got == {**dict(rows), "d7": '{"v":70}', "new": "{}", "d8": "[]", "newer": "{}"}
    assert {r.bucket for r in spark.read.parquet(folder).collect()} <= set(range(4))


def test_patches_without_an_order(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    patches = spark.createDataFrame([(1, "x", None), (2, "y", None), (2, "z", 5)], "k int, v string, t int")
    got = tables.patch_rows(table, patches, "k", {"v": F.lit(True)}, "t")
    assert {r.k: r.v for r in got.collect()} == {1: "x", 2: "z", 3: "c"}


def test_whole_phone_numbers(spark):
    texts = ["call +420 123 456 789 now", "or 123 456 789", "or +420 123 4567", "+420123456789"]
    df = spark.createDataFrame(list(enumerate(texts)), "db_id int, text string")
    got = {r.db_id: r.data for r in extract.extract_edits(df).where("path = '$.phones'").collect()}
    assert got == {0: '"+420 123 456 789"', 1: '"123 456 789"', 2: '"+420 123 4567"', 3: '"+420123456789"'}


def test_descriptions_upsert(spark):
    rows = [
        ("a", 1, '$.l[?n = "x"].v', "old"),
        ("a", 2, "$.l.v", "new"),
        ("a", 3, "$.l.v", ""),
        ("a", 4, "$.l.`len`", "size"),
    ]
    df = spark.createDataFrame(rows, "db_id string, seq int, path string, description string")
    got = {r.path: r.description for r in documents.upsert_descriptions(df).collect()}
    assert got == {"$.l.v": "new", "$.l.": "size"}


def test_csv_and_lines(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('Biography,ID\n"Jane, born in Brno, said ""hi""",1\nHe\'s plain,2\n"two\nlines",3\n')
    got = [r.Biography for r in files.read_csv_column(spark, str(path), "Biography").collect()]
    assert got == ['Jane, born in Brno, said "hi"', "He's plain", "two\nlines"]
    assert files.read_lines(spark, str(path)).count() == 5
    out = str(tmp_path / "qa")
    df = spark.createDataFrame([("q,1", 'a "1"', "c")], "q string, a string, chunk string")
    files.append_csv(df, out, ["q", "a", "chunk"])
    files.append_csv(df, out, ["q", "a", "chunk"])
    assert [tuple(r) for r in spark.read.options(**{**files.CSV, "header": "false"}).csv(out).collect()] == [("q,1", 'a "1"', "c")] * 2


def test_blobs_and_records(spark):
    log = spark.createDataFrame([("u", "/a", 1, "x"), ("u", "/a", 2, "y"), ("v", "/a", 1, "z")], "uid string, path string, seq int, data string")
    latest = keyed.upsert_blobs(log)
    assert [r.data for r in keyed.get_blob(latest, "u", "/a").collect()] == ["y"]
    users = keyed.create(spark.createDataFrame([("n",)], "name string"), "users", "name")
    threads = keyed.create(spark.createDataFrame([("n",)], "name string"), "threads", "name")
    assert users.columns == ["name", "uid"] and threads.columns == ["name", "id"]
    assert users.first().uid != threads.first().id
