"""What the plans must not contain."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_pairwise_joins(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in text


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["tenant_filter"](spark, sf))
    assert "EqualTo(source,src7)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    text = plan(QUERIES["path_nested_field"](spark, sf))
    assert "html" not in text


def test_walk_is_one_stage(spark, sf):
    from docmem.operators import leaves as lv
    from docmem.sources import testdata as td

    docs = td.order_docs(spark, sf)
    base = plan(docs).count("Exchange")
    assert plan(lv.leaves(docs)).count("Exchange") == base


def test_vectors_are_not_shuffled(spark, sf):
    text = plan(QUERIES["vector_topk_by_tenant"](spark, sf))
    assert "WindowGroupLimit" in text
    assert text.count("Exchange hashpartitioning") == 1
