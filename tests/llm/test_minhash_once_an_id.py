"""What a document's signature or shingles weigh goes through a join once, however many buckets hold the document."""

from quillgraph.llm.minhash import _once_an_id


def test_one_row_an_id_is_joined(spark):
    rows = spark.createDataFrame([(b, i, i % 3) for i in range(6) for b in range(20)], "band int, id long, label long")
    of = spark.createDataFrame([(i, f"s{i}") for i in range(5)] + [(4, "other")], "id long, sig string")
    got = _once_an_id(rows, of)
    assert sorted(got.select("band", "id", "label", "sig").collect()) == sorted(rows.join(of, "id").select("band", "id", "label", "sig").collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # Dealt out behind the join: the aggregate stands below it, the generator above.
    assert plan.index("Generate inline") < plan.index("Join Inner") < plan.index("Aggregate [id")
