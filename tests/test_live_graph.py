"""The live view made from numbers has the rows of ``live()``, and never moves edges by their names."""

import datetime

from quillgraph.sources.tables import load_graph


def _written(spark, path, small):
    for name in ("nation", "orders", "lineitem"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    # Lost ends: customers and suppliers that orders and line items name, but that the tables or their nations lack.
    spark.read.parquet(f"{small}/customer.parquet").where("c_custkey % 7 <> 0").selectExpr("* except (c_nationkey)", "if(c_custkey % 11 = 0, 99, c_nationkey) as c_nationkey").write.parquet(f"{path}/customer.parquet")
    spark.read.parquet(f"{small}/supplier.parquet").where("s_suppkey % 5 <> 0").write.parquet(f"{path}/supplier.parquet")


def test_live_by_numbers_is_live(spark, small, tmp_path):
    path = str(tmp_path)
    _written(spark, path, small)
    every = load_graph(spark, path)
    slow, fast = every.live(), load_graph(spark, path, live=True)
    rows = lambda df: sorted(df.collect(), key=str)
    assert fast.edges.columns == slow.edges.columns and fast.edges.dtypes == slow.edges.dtypes
    assert rows(fast.edges) == rows(slow.edges) and rows(fast.nodes) == rows(slow.nodes)
    assert 0 < slow.edges.count() < every.edges.where("active").count()
    assert all(isinstance(x.first_filing, datetime.date) for x in fast.edges.take(5))
    assert "hashpartitioning(source" not in fast.edges._jdf.queryExecution().executedPlan().toString()
