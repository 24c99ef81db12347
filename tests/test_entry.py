"""The driver's contract."""

import __spark_entry__
from trawler.plans.registry import QUERIES


def test_names():
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(oracle) <= set(queries) and len(QUERIES) == 77


def test_flagship(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["qid", "doc_id", "score", "rank"] and frame.count() > 0


def test_plan_prunes_and_limits_early(spark):
    from trawler.plans.views import Views

    v = Views.of(spark, "/root/testdata/sf0.001")
    plan = __spark_entry__.queries()["topk_per_query"](spark, v.sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Cartesian" not in plan and "BatchEvalPython" not in plan
    scan = __spark_entry__.queries()["full_content"](spark, v.sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in scan and "IsNotNull(text)" in scan
