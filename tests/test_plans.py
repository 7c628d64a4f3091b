"""Plan shape: no cross joins anywhere, filters and columns reach the scan, rank cuts sit below the shuffle."""

import pytest

from sparkassay.plans import catalogue

ROOT = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, ROOT))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scan_pruning(spark):
    text = plan(QUERIES["q_topk_spend"](spark, ROOT))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in text
    assert "TakeOrderedAndProject" in text
    months = plan(QUERIES["q_month_series"](spark, ROOT))
    assert "GreaterThanOrEqual(o" in months and "1998-01-01" in months and "1999-01-01" in months


def test_rank_cut_below_shuffle(spark):
    text = plan(QUERIES["result_preview"](spark, ROOT))
    assert "WindowGroupLimit" in text and "Partial" in text


@pytest.mark.parametrize("name", ["chunk_fixed", "chunk_sentence", "chunk_lines", "sparse_terms", "check_output", "parse_completion_json"])
def test_row_work_does_not_shuffle(spark, name):
    text = plan(QUERIES[name](spark, ROOT))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_packing_runs_once(spark):
    assert plan(QUERIES["chunk_sentence"](spark, ROOT)).count("ArrowEvalPython") == 1
    assert plan(QUERIES["hash_embed"](spark, ROOT)).count("ArrowEvalPython") == 1


def test_parts_of_the_brand_report_follow_the_lines(spark, tmp_path, monkeypatch):
    from sparkassay.plans import catalogue, warehouse

    monkeypatch.setattr(warehouse, "LINES_PER_TASK", 3, raising=False)
    lines = [(1, 1, 10.0), (1, 1, 5.0), (1, 2, 7.0), (2, 1, 1.0), (2, None, 4.0), (None, 1, 9.0), (3, 3, 2.0), (9, 1, 8.0)]
    spark.createDataFrame([(o, p, price, 0.5) for o, p, price in lines], "l_orderkey long, l_partkey long, l_extendedprice double, l_discount double"
                          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    # Order 2 is there twice, order 9 is not; part 2 is there twice and part 3 has no brand.
    spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "A"), (2, "A"), (2, "B"), (3, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.queries()["q_multi_agg"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("A", 12.0, 2), ("B", 3.5, 1), (None, 1.0, 1)}
    assert "hashpartitioning(l_orderkey" in found._jdf.queryExecution().toString() and ", 3)" in found._jdf.queryExecution().toString()
