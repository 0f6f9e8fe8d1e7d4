"""Documents of a graph stay small however many edges it has, and hold every edge once."""

from pyspark.sql import functions as F

from quillgraph.sources import graph_json


def test_documents_grow_in_number_not_in_size(spark, tmp_path):
    edges = spark.range(3000).select(F.concat(F.lit("E"), "id").alias("edge_id"), F.lit("A").alias("source"), F.lit("B").alias("target"), F.lit("X").alias("relationship_type"))
    docs = graph_json.documents(edges, 50)
    sizes = [r.n for r in docs.select(F.size("edges").alias("n")).collect()]
    assert sum(sizes) == 3000 and len(sizes) == 60 and max(sizes) < 100
    path = str(tmp_path / "graph")
    docs.write.partitionBy("shard").json(path)
    got = graph_json.read_graph(spark, path, "2026-01-01").edges
    assert got.select("edge_id").distinct().count() == got.count() == 3000
    assert graph_json.documents(edges.where("false")).count() == 0
