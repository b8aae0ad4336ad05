import json
import random

import pytest

SYLLABLES = "an re ti on the er in at es or nd ha en ed is ou".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def text(r, n, per_line=12):
    words = [word(r) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + per_line]) for i in range(0, n, per_line))


@pytest.fixture(scope="session")
def documents(spark, tmp_path_factory):
    """A stored table with everything that may go wrong: NULLs, blanks, repeats, near copies, clashing names."""
    r = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, text(r, r.randint(1, 150)), f"s{i % 4}"))
    long = text(r, 9000)
    rows += [(100, long, "s0"), (101, long, "s1"), (102, None, "s2"), (103, "", None), (104, " \n\t ", "s3"), (None, "null id one two three", "s1")]
    base = text(r, 120)
    for i in range(30):  # a group of near and exact copies
        words = base.split(" ")
        for _ in range(i % 3):
            words[r.randrange(len(words))] = word(r)
        rows.append((200 + i, " ".join(words), "s0"))
    rows += [rows[3], rows[3], rows[65]]
    rows = [(*x, len(x[1]) if x[1] else 0, 7, "c", 1.5, "kept") for x in rows]
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    kinds = "doc_id bigint, text string, source string, n_chars bigint, size int, row string, score double, _uid string"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "empty.parquet")
    documents.limit(0).write.parquet(path)
    return spark.read.parquet(path)


def as_rows(df):
    return sorted((json.dumps(x.asDict(recursive=True), default=str, sort_keys=True) for x in df.collect()))
