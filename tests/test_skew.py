"""Queries on tables where one key holds a third of all rows, with small segments."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from docmem.operators import fold as fo  # noqa: E402
from docmem.operators import vectors  # noqa: E402
from oracle import TABLES, compare, duck  # noqa: E402

SENSITIVE = (
    "fold_elements fold_docs replay_edits fold_prefix_conflicts update_matching_elements fold_onto_base "
    "thread_assemble previous_context qa_chunks last_message ingest_chunks vector_topk_by_tenant "
    "first_doc_per_collection sql_join sql_window descriptions_upsert"
).split()


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, sf):
    """Copies of the tables: every third row moved to one owner, thread, source, label or customer."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    con = duck(sf)
    changed = {
        "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id, "
        "CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS event_type) FROM events",
        "documents": "SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'src7' ELSE source END AS source, "
        "CASE WHEN doc_id % 3 = 0 THEN 'one line' || chr(10) || 'copied' ELSE text END AS text) FROM documents",
        "embeddings": "SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 THEN 0 ELSE label END::INT AS label) FROM embeddings",
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM orders",
        "conversations": "SELECT -1::BIGINT AS conv_id, event_id AS turn, "
        "CASE WHEN event_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, props AS text FROM events "
        "UNION ALL SELECT conv_id + 100000, turn, role, text FROM conversations",
    }
    for name in TABLES:
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", SENSITIVE)
def test_skewed_query_equals_sql(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(fo, "SEGMENT", 64)
    if name.startswith("vector"):
        monkeypatch.setattr(vectors, "MAX_BROADCAST_QUERIES", 3)
        monkeypatch.setattr(vectors, "GROUP_ROWS", 50)
    diff, rows = compare(spark, duck(skewed), skewed, entry.queries()[name], entry.oracle_sql()[name])
    assert diff is None
    assert rows > 0
