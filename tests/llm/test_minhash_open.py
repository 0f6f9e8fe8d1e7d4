"""Buckets whose only stranger is their lead are settled by its star and are not opened again."""

from quillgraph.llm import minhash


def test_a_lead_alone_opens_no_bucket(spark):
    rows = [(0, 1, 10, 10, 10), (0, 1, 11, 10, 11), (0, 1, 12, 10, 11), (0, 2, 20, 20, 20), (0, 2, 21, 20, 20), (0, 2, 22, 20, 22), (0, 2, 23, 20, 23)]
    labelled = spark.createDataFrame(rows, "band int, bucket long, id long, lead long, label long")
    assert sorted((x.bucket, x.id) for x in minhash._open(labelled).collect()) == [(2, 21), (2, 22), (2, 23)]
