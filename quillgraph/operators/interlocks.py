"""Persons and owners that link organisations, and the organisation graph they project to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.loops import closed_squares, closed_triangles, loop_report  # noqa: F401
from quillgraph.plans.graph import OWN, ROLE, Graph

ACTIVE_SHARED, LEAST_BOARD, LEAST_SHARE = 3, 4, 0.5


def seats(g: Graph) -> DataFrame:
    """One role per (person, org): a director's seat before an officer's, then the newest filing."""
    roles = g.of(*ROLE).join(g.persons().select(F.col("id").alias("source")), "source", "left_semi")
    w = Window.partitionBy("source", "target").orderBy(F.col("relationship_type") != "DIRECTOR_OF", F.desc("last_filing"), "edge_id")
    best = roles.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select(F.col("source").alias("person"), F.col("target").alias("org"), "edge_id", "relationship_type", "active", "last_filing")


def interlock_persons(g: Graph, least: int = 2) -> DataFrame:
    s = seats(g).groupBy("person").agg(F.collect_set("org").alias("orgs")).where(F.size("orgs") >= least)
    return s.select("person", F.size("orgs").cast("long").alias("n_orgs"), F.array_join(F.array_sort("orgs"), ",").alias("orgs"))


def _pairs(s: DataFrame) -> DataFrame:
    """Organisation pairs (a < b) of each person, each once: ``s`` has one seat per person and organisation."""
    a = s.select("person", F.col("org").alias("a"), F.col("edge_id").alias("edge_a"), F.col("active").alias("active_a"))
    b = s.select("person", F.col("org").alias("b"), F.col("edge_id").alias("edge_b"), F.col("active").alias("active_b"))
    return a.join(b, "person").where("a < b")


def affiliation_projection(g: Graph) -> DataFrame:
    """(a, b, person, edge_a, edge_b): organisations that share a person."""
    return _pairs(seats(g)).select("a", "b", "person", "edge_a", "edge_b")


def org_pairs(g: Graph) -> DataFrame:
    return affiliation_projection(g).groupBy("a", "b").agg(F.count("person").alias("shared"))


def via_pairs(g: Graph) -> DataFrame:
    """Pairs over all filings; active if some person holds both roles now."""
    both = F.coalesce(F.col("active_a"), F.lit(True)) & F.coalesce(F.col("active_b"), F.lit(True))
    return _pairs(seats(g)).groupBy("a", "b").agg(F.count("person").alias("people"), F.max(both).alias("active"))


def common_owners(g: Graph, least: int = 2) -> DataFrame:
    held = g.of(*OWN).where("percent is null or percent > 0")
    return held.groupBy(F.col("source").alias("owner")).agg(F.countDistinct("target").alias("targets"), F.count(F.lit(1)).alias("edges")).where(F.col("targets") >= least)


def corporate_families(g: Graph) -> DataFrame:
    """Children per parent. Among a child's parents by block ownership the one with the largest share is the ultimate one."""
    w = Window.partitionBy("target").orderBy(F.desc("percent"), "source")
    parent = g.of("BENEFICIAL_OWNER_OF").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return parent.groupBy(F.col("source").alias("parent")).agg(F.countDistinct("target").alias("children"))


def cross_domain_bridges(g: Graph, least: int = 2) -> DataFrame:
    """Nodes whose neighbours lie in ``least`` or more sectors."""
    sectors = g.sectors().select(F.col("id").alias("b"), "domain")
    n = g.adjacency().select("a", "b").distinct().join(sectors, "b").groupBy(F.col("a").alias("id"))
    return n.agg(F.countDistinct("domain").alias("domains"), F.countDistinct("b").alias("members")).where(F.col("domains") >= least)


def _affiliates(g: Graph, trade: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs that are one enterprise: a recorded parent tie, or boards of one ``trade`` (org, sic) that overlap by half."""
    parents = g.of("BENEFICIAL_OWNER_OF").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    d = g.of("DIRECTOR_OF").select(F.col("source").alias("person"), F.col("target").alias("org")).distinct()
    n = d.groupBy("org").agg(F.count(F.lit(1)).alias("n"))
    traded = d.join(trade, "org")
    shared = traded.withColumnRenamed("org", "a").join(traded.withColumnRenamed("org", "b"), ["person", "sic"]).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    sized = shared.join(n.select(F.col("org").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("org").alias("b"), F.col("n").alias("nb")), "b")
    small = F.least("na", "nb")
    return parents.union(sized.where((F.col("s") >= ACTIVE_SHARED) & (small >= LEAST_BOARD) & (F.col("s") / small >= LEAST_SHARE)).select("a", "b")).distinct()


def competitor_links(g: Graph) -> DataFrame:
    """(person, a, b, kind): pairs of unaffiliated organisations of one trade; both roles active is an interlock, one is a hop."""
    # Seats meet on person and trade, so pairs of other trades are not made.
    trade = g.nodes.where("sic is not null").select(F.col("id").alias("org"), "sic")
    s = seats(g).select("person", "org", "active").join(trade, "org")
    a, b = (s.select("person", "sic", F.col("org").alias(c), F.col("active").alias(f"active_{c}")) for c in ("a", "b"))
    p = a.join(b, ["person", "sic"]).where("a < b").join(_affiliates(g.live(), trade), ["a", "b"], "left_anti")
    kind = F.when(F.col("active_a") & F.col("active_b"), "interlock").when(F.col("active_a") != F.col("active_b"), "hop")
    return p.select("person", "a", "b", kind.alias("kind")).where("kind is not null")


def overboarding_families(g: Graph, families: int = 5, outside: int = 2, blank_sic: int = 6770) -> DataFrame:
    """Persons on boards of ``families`` or more name families, or officers with ``outside`` or more others. The family
    is the last word of the label up to its final digit."""
    stem = F.regexp_replace("label", r"\d$", "")
    s = seats(g).join(g.nodes.select(F.col("id").alias("org"), stem.alias("stem"), "sic"), "org").where((F.col("sic") != blank_sic) | F.col("sic").isNull())
    p = s.groupBy("person").agg(F.collect_set("stem").alias("stems"), F.collect_set(F.when(F.col("relationship_type") == "OFFICER_OF", F.col("stem"))).alias("own"))
    away = F.size(F.array_except("stems", "own"))
    return p.where((F.size("stems") >= families) | ((F.size("own") > 0) & (away >= outside))).select("person", F.size("stems").cast("long").alias("families"), away.cast("long").alias("outside"))


def common_ownership_by_sector(g: Graph, least: int = 2, percent: int = 5) -> DataFrame:
    sic = g.nodes.where("sic is not null").select(F.col("id").alias("target"), "sic")
    held = g.of(*OWN).where((F.col("percent").isNull()) | (F.col("percent") >= percent)).join(sic, "target")
    return held.groupBy(F.col("source").alias("holder"), "sic").agg(F.countDistinct("target").alias("targets")).where(F.col("targets") >= least)


def frontier(g: Graph, pulled: DataFrame, top: int = 25) -> DataFrame:
    """Organisations not pulled yet, by pulled neighbours, then people, then id: a report of the first ``top``."""
    p = affiliation_projection(g)
    both = p.select(F.col("a").alias("org"), F.col("b").alias("other"), "person").union(p.select("b", "a", "person"))
    core = pulled.select("id")
    rows = both.join(core.withColumnRenamed("id", "org"), "org", "left_anti").join(core.select(F.col("id").alias("other")), "other", "left_semi")
    out = rows.groupBy("org").agg(F.countDistinct("other").alias("core"), F.countDistinct("person").alias("people"))
    return out.orderBy(F.desc("core"), F.desc("people"), "org").limit(top)


def subject_links(g: Graph, subjects: DataFrame) -> DataFrame:
    """(subject, other, person): organisations linked to each subject through a shared person, once per pair and person."""
    # Which role a person has does not matter here, so ties go through the shuffles as two ids, once each.
    s = g.of(*ROLE).join(g.persons().select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("person"), F.col("target").alias("org")).distinct()
    mine = s.join(subjects.select(F.col("id").alias("org")), "org", "left_semi").select(F.col("org").alias("subject"), "person")
    links = mine.join(s.select("person", F.col("org").alias("other")), "person").where("subject <> other")
    return links.select("subject", "other", "person")
