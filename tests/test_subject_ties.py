"""Links of subjects are found from ties of two ids, each once, and are not made distinct again."""

from quillgraph.operators.interlocks import subject_links
from quillgraph.plans.graph import Graph


def test_links_of_subjects_shuffle_ids_only(spark):
    nodes = spark.createDataFrame([("P", "PERSON"), ("Q", "PERSON"), ("A", "ORGANIZATION"), ("B", "ORGANIZATION"), ("C", "ORGANIZATION")], "id string, entity_type string")
    rows = [("P", "A", "DIRECTOR_OF"), ("P", "A", "OFFICER_OF"), ("P", "B", "OFFICER_OF"), ("Q", "B", "DIRECTOR_OF"), ("Q", "C", "TEN_PERCENT_OWNER_OF"), ("A", "B", "DIRECTOR_OF"), ("P", "C", "DIRECTOR_OF")]
    edges = spark.createDataFrame([(f"{s}>{t}>{r}", s, t, r, "2001-01-01", True) for s, t, r in rows], "edge_id string, source string, target string, relationship_type string, last_filing string, active boolean")
    out = subject_links(Graph(nodes, edges, "2001-11-04"), nodes.where("id in ('A', 'B')"))
    assert sorted(map(tuple, out.collect())) == [("A", "B", "P"), ("A", "C", "P"), ("B", "A", "P"), ("B", "C", "P")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "edge_id" not in plan.split("LogicalRDD")[0]
    assert not plan.startswith("Aggregate")
