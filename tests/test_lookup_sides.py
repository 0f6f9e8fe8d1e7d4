"""Sides of joins that look up nodes: few nodes go to the edges, merges are hashed, searches carry what is asked for."""

import random

from quillgraph.operators import identity, paths, records
from quillgraph.plans import graph
from quillgraph.plans.graph import Graph


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_nodes_go_to_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "a", "x"), ("e3", "y", "x")], "edge_id string, source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    found = records.dangling(edges, nodes)
    want = [("e2", "target", "x"), ("e3", "source", "y"), ("e3", "target", "x")]
    assert sorted(tuple(r) for r in found.collect()) == want
    assert _plan(found).count("rightHint=(strategy=broadcast)") == 2
    monkeypatch.setattr(graph, "BROADCAST_IDS", 1)
    found = records.dangling(edges, nodes)
    assert sorted(tuple(r) for r in found.collect()) == want and "strategy=broadcast" not in _plan(found)


def test_merges_are_hashed_not_sorted_with_the_edges(spark):
    edges = spark.createDataFrame([("a", "x", "t"), ("b", "x", "t"), ("a", "b", "t"), ("c", "y", "u")], "source string, target string, relationship_type string")
    merges = spark.createDataFrame([("a", "a"), ("b", "a"), ("y", "x")], "id string, keep string")
    found = identity.apply_merges(edges, merges)
    assert sorted(tuple(r) for r in found.collect()) == [("a", "x", "t", 2), ("c", "x", "u", 1)]
    assert _plan(found).count("rightHint=(strategy=shuffle_hash)") == 2


def test_transparent_search_without_names(spark):
    rng = random.Random(5)
    ids = [f"{'p' if i % 3 else 'o'}{i}" for i in range(60)]
    ends = [tuple(rng.sample(ids, 2)) for _ in range(70)]
    nodes = spark.createDataFrame([(i, "PERSON" if i[0] == "p" else "ORGANIZATION") for i in ids], "id string, entity_type string")
    edges = spark.createDataFrame([(f"e{n}", a, b, "t", 1.0, True) for n, (a, b) in enumerate(ends)], "edge_id string, source string, target string, relationship_type string, weight double, active boolean")
    g, start = Graph(nodes, edges, "2001-01-01"), spark.createDataFrame([("o0",)], "id string")
    want, moved = {"o0": 0}, True
    while moved:
        moved = False
        for a, b in [*ends, *[(b, a) for a, b in ends]]:
            cost = want.get(a, 99) + (b[0] == "o")
            if cost < want.get(b, 99):
                want[b], moved = cost, True
    full = paths.hop_distances(g, start, transparent=g.persons()).collect()
    assert {r.id: r.hops for r in full} == {k: v for k, v in want.items() if v < 99}
    hops = {r.id: r.hops for r in full}
    assert all(r.prev is None or hops[r.prev] + (r.id[0] == "o") == r.hops for r in full)
    near = paths.hop_distances(g, start, transparent=g.persons(), max_cost=2, trace=False).collect()
    assert {r.id: r.hops for r in near} == {k: v for k, v in want.items() if v <= 2} and not any(r.edge_id for r in near)
