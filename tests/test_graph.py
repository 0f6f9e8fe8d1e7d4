"""Graph operators on small graphs with known answers."""

import json
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import central, interlocks, measures, paths
from quillgraph.operators.components import connected_components
from quillgraph.plans.graph import Graph
from quillgraph.plans.staging import Staging
from quillgraph.sources.graph_json import identities, read_graph

EDGE = "edge_id string, source string, target string, relationship_type string, first_filing string, last_filing string, filings_seen long, percent int, weight double, active boolean"


def graph(spark, edges, people=(), domains=("DOM_A",)):
    ids = sorted({x for e in edges for x in e[:2]})
    nodes = spark.createDataFrame([(i, i, "PERSON" if i in people else "ORGANIZATION", list(domains), None) for i in ids], "id string, label string, entity_type string, domains array<string>, sic int")
    rows = [(f"E{n}", s, t, kind, first, last, 1, None, 0.5, active) for n, (s, t, kind, first, last, active) in enumerate(edges)]
    e = spark.createDataFrame(rows, EDGE)
    return Graph(nodes, e.withColumns({c: F.col(c).cast("date") for c in ("first_filing", "last_filing")}), "2026-01-01")


def plain_graph(spark, pairs):
    return graph(spark, [(a, b, "DIRECTOR_OF", "2020-01-01", "2026-01-01", True) for a, b in pairs])


@pytest.fixture(scope="module")
def boards(spark):
    now = "2026-01-01"
    rows = [
        ("PARENT", "CO", "TEN_PERCENT_OWNER_OF", now, now), ("P1", "CO", "DIRECTOR_OF", "2010-01-01", now), ("P1", "CO", "OFFICER_OF", now, now), ("P2", "CO", "DIRECTOR_OF", now, now),
        ("P2", "PARENT", "OFFICER_OF", now, now), ("P3", "CO", "DIRECTOR_OF", now, now), ("P4", "OTHER", "DIRECTOR_OF", now, now), ("P4", "CO", "DIRECTOR_OF", now, now),
    ]
    return graph(spark, [(*r, True) for r in rows], people={"P1", "P2", "P3", "P4"})


def test_measures_on_one_board(boards):
    [co] = measures.board_independence(boards.live()).collect()
    assert (co.org, co.directors, co.tied, co.flag) == ("CO", 4, 2, True)
    assert [r.person for r in measures.long_tenure(boards.live()).collect()] == ["P1"]
    assert "P4" not in {r.id for r in central.single_points(boards.live()).collect()}
    quiet = Graph(boards.nodes, boards.edges.withColumn("active", F.lit(False)), boards.as_of)
    assert measures.board_independence(quiet.live()).count() == 0


def test_unknown_activity_counts_as_active(spark):
    g = graph(spark, [("P", "A", "DIRECTOR_OF", "2020-01-01", "2026-01-01", None), ("P", "B", "DIRECTOR_OF", "2020-01-01", "2026-01-01", True)], people={"P"})
    assert g.live().edges.count() == 2
    assert [tuple(r) for r in interlocks.org_pairs(g.live()).collect()] == [("A", "B", 1)]


def test_components_of_a_long_chain_and_an_empty_graph(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(chain, Staging(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert connected_components(chain.limit(0), Staging(spark, "t")).count() == 0


def test_targets_are_not_expanded_and_ties_are_settled(spark):
    g = plain_graph(spark, [("S", "T"), ("T", "X"), ("S", "B"), ("S", "A"), ("A", "Z"), ("B", "Z")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r.id: (r.hops, r.prev) for r in paths.hop_distances(g, ids("S"), ids("T")).collect()}
    assert "X" not in got and got["Z"] == (2, "A")
    only = {r.id for r in paths.hop_distances(g, ids("S"), ids("Z"), allowed=ids("B")).collect()}
    assert only == {"S", "B", "Z"}
    [best] = paths.find_paths(g, ids("S"), ids("Z", "S"), limit=1).collect()
    assert (best.target, best.nodes, best.hops) == ("Z", "S>A>Z", 2)
    assert paths.find_paths(g, ids("S"), ids("NOBODY")).count() == 0


def test_cut_points_against_removal(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d"), ("f", "g"), ("g", "h"), ("b", "x"), ("p", "q")]
    g = plain_graph(spark, pairs)
    adj = defaultdict(set)
    for a, b in pairs[:-1]:
        adj[a].add(b), adj[b].add(a)

    def parts(gone):
        seen, out = {gone}, []
        for s in adj:
            if s not in seen:
                stack, n = [s], 0
                seen.add(s)
                while stack:
                    n += 1
                    for v in adj[stack.pop()] - seen:
                        seen.add(v), stack.append(v)
                out.append(n)
        return out

    expected = {v: (sum(p) - max(p), len(p) - 1) for v in adj if len(p := parts(v)) > 1}
    assert {r.id: (r.cut_off, r.groups) for r in central.single_points(g, least=1).collect()} == expected


def test_betweenness_of_a_star(spark):
    g = plain_graph(spark, [("hub", x) for x in "abcd"])
    got = {r.id: r.score for r in central.betweenness(g).collect()}
    assert got["hub"] == 12 and got["a"] == 0


def test_loops_count_once_per_set(spark):
    people = {f"p{i}" for i in range(6)}
    ring = [("p0", "A"), ("p0", "B"), ("p1", "B"), ("p1", "C"), ("p2", "C"), ("p2", "D"), ("p3", "D"), ("p3", "A"), ("p4", "A"), ("p4", "C"), ("p5", "B"), ("p5", "D")]
    g = graph(spark, [(p, o, "DIRECTOR_OF", "2020-01-01", "2026-01-01", True) for p, o in ring], people=people)
    projection = interlocks.affiliation_projection(g)
    assert [r.orgs for r in interlocks.closed_squares(projection).collect()] == ["A,B,C,D"]
    assert interlocks.closed_triangles(projection).count() == 4
    assert len(list(permutations("ABCD", 3))) // 6 == 4


def test_crossings_along_a_path(spark):
    nodes = spark.createDataFrame([("A", "A", "ORGANIZATION", ["DOM_A"], None), ("P", "P", "PERSON", [], None), ("B", "B", "ORGANIZATION", ["DOM_B"], None), ("C", "C", "ORGANIZATION", ["DOM_B"], None)], "id string, label string, entity_type string, domains array<string>, sic int")
    g = Graph(nodes, spark.createDataFrame([], EDGE), "2026-01-01")
    walk = spark.createDataFrame([("C", 0, "A", None), ("C", 1, "P", 0.9), ("C", 2, "B", 0.4), ("C", 3, "C", 0.7)], "end string, pos int, id string, weight double")
    [x] = paths.crossings(walk, g).collect()
    assert (x.from_org, x.to_org, x.via, x.leaving, x.entering, x.full_boundary, x.weight) == ("A", "B", "P", "DOM_A", "DOM_B", True, 0.4)


def test_graph_document(spark, tmp_path):
    doc = {
        "nodes": [{"id": "N1", "label": "One", "entity_type": "CORPORATION", "domains": ["DOM_A"], "identity": {"sec_cik": "1"}, "provenance": {}}, {"id": "N2", "label": "Two", "entity_type": "PERSON", "domains": [], "identity": {"sec_cik": "1"}, "provenance": {"merged_into": "N3"}}],
        "edges": [{"edge_id": "E1", "source": "N1", "target": "N1", "relationship_type": "X", "transparency": {"document_date": "2026-01-02", "active": None}, "integrity": {"conflict_weight": 0.5}}],
    }
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc))
    g = read_graph(spark, str(path), "2026-01-01")
    assert identities(g.nodes).collect()[0].id == "N1" and identities(g.nodes).count() == 1
    assert str(g.live().edges.first().last_filing) == "2026-01-02"
