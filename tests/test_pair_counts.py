"""Pairs of organisations count people without looking for repeats: a person has one seat in each."""

from quillgraph.operators import interlocks
from quillgraph.sources.tables import load_graph


def test_via_pairs_count_each_person_once_without_a_distinct(spark, small):
    g = load_graph(spark, small)
    seats = interlocks.seats(g)
    assert seats.count() == seats.select("person", "org").distinct().count() > 0
    for df in (interlocks.via_pairs(g), interlocks.org_pairs(g)):
        assert "distinct" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
