"""The graph as a pair of frames, and the views every operator starts from."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.weights import control_class

# Relation groups and published thresholds.
OWN = ("TEN_PERCENT_OWNER_OF", "BENEFICIAL_OWNER_OF")
ROLE = ("DIRECTOR_OF", "OFFICER_OF")
STANDARDS = {
    "independence_min_share": 0.5,
    "concentration_hhi_high": 1800,
    "tenure_years": 9,
    "overboard_seats": 5,
    "overboard_ceo_outside": 2,
    "min_board_size": 3,
    "min_positions": 10,
    "single_point_min_cut": 3,
}
#: Rows of node ids that may be broadcast (some dozens of bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Days after its last filing for which a role counts as active.
ACTIVE_DAYS = 456


def not_false(c: str | Column) -> Column:
    """Tri-state flag: true and unknown both hold."""
    c = F.col(c) if isinstance(c, str) else c
    return ~c.eqNullSafe(F.lit(False))


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def few(ids: DataFrame, n: int | None = None) -> DataFrame:
    """``ids``, of which there are ``n`` (else they are counted), to be broadcast if that is few enough."""
    return F.broadcast(ids) if (ids.count() if n is None else n) <= BROADCAST_IDS else ids


@dataclass(frozen=True)
class Graph:
    """nodes: id, label, entity_type, domains, sic; edges: edge_id, source, target, relationship_type,
    first_filing, last_filing, filings_seen, percent, weight, active. Optional columns: merged_into on
    nodes, superseded_by on edges."""

    nodes: DataFrame
    edges: DataFrame
    as_of: str

    def live(self, active_only: bool = True) -> Graph:
        """Without merged nodes, superseded or (by default) inactive edges, and edges with a lost end."""
        nodes = self.nodes.where(blank("merged_into")) if "merged_into" in self.nodes.columns else self.nodes
        edges = self.edges.where(blank("superseded_by")) if "superseded_by" in self.edges.columns else self.edges
        edges = edges.where(not_false("active")) if active_only else edges
        for end in ("source", "target"):
            edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        return replace(self, nodes=nodes, edges=edges)

    def of(self, *relations: str) -> DataFrame:
        return self.edges.where(F.col("relationship_type").isin(*relations))

    def adjacency(self) -> DataFrame:
        """Every edge seen from both its ends."""
        keep = ["edge_id", "relationship_type", "weight", "active"]
        ahead = self.edges.select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("forward").alias("direction"), *keep)
        back = self.edges.select(F.col("target").alias("a"), F.col("source").alias("b"), F.lit("reverse").alias("direction"), *keep)
        return ahead.unionByName(back)

    def sectors(self) -> DataFrame:
        """(id, label, domain) per organisation and sector; only DOM_ entries are sectors."""
        orgs = self.nodes.where("entity_type <> 'PERSON'").select("id", "label", F.explode("domains").alias("domain"))
        return orgs.where(F.col("domain").startswith("DOM_"))

    def persons(self) -> DataFrame:
        return self.nodes.where("entity_type = 'PERSON'")

    def strict(self, hard_only: bool = False, current_only: bool = False, min_weight: float | None = None, domains: tuple[str, ...] = ()) -> Graph:
        """The edges a search is built on: hard control only, current only, of a least weight, or between nodes of the given sectors."""
        e = self.edges
        if hard_only:
            e = e.where(control_class(F.col("relationship_type")) == "hard")
        if current_only:
            e = e.where(not_false("active"))
        if min_weight is not None:
            e = e.where(F.coalesce("weight", F.lit(0.0)) >= min_weight)
        nodes = self.nodes
        if domains:
            nodes = nodes.where(F.arrays_overlap("domains", F.array(*[F.lit(d) for d in domains])))
            for end in ("source", "target"):
                e = e.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
        return replace(self, nodes=nodes, edges=e)
