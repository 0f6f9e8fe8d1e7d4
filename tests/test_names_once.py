"""Equal names are compared once, however many records bear them."""

from quillgraph.functions.names import match_people


def _shuffled(spark, run):
    """Records that the stages of ``run`` hand to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    out = run()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def test_equal_names_are_compared_once(spark):
    left = spark.createDataFrame([(i, "Ann J. Smith" if i % 2 else "A. Smith") for i in range(200)], "id long, name string")
    right = spark.createDataFrame([(1000 + i, "Ann Smith") for i in range(200)], "id long, name string")
    rows, shuffled = _shuffled(spark, match_people(left, right).collect)
    assert len({(r.left_id, r.right_id) for r in rows}) == len(rows) == 200 * 200
    assert all(r.kind == ("first_last" if r.left_id % 2 else "initial") for r in rows)
    assert shuffled < 10_000


def test_records_of_several_names_give_each_pair_once(spark):
    left = spark.createDataFrame([(1, "Ann Smith"), (1, "Anna Smith"), (1, "A. Smith"), (2, None), (3, "Smith")], "id long, name string")
    right = spark.createDataFrame([(4, "Ann Smith"), (4, "Ann Smith"), (5, "Anna Smith"), (5, "Ann Smith"), (6, None)], "id long, name string")
    got = sorted(tuple(r) for r in match_people(left, right).collect())
    assert got == [(1, 4, "first_last"), (1, 4, "initial"), (1, 5, "first_last"), (1, 5, "initial")]
