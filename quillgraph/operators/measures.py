"""Governance measures over the live graph. Thresholds are parameters; defaults are the published ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.graph import OWN, ROLE, STANDARDS, Graph
from quillgraph.plans.ranks import numbered


def degree_count(g: Graph) -> DataFrame:
    """(id, degree): edges at each node, both ends counted."""
    return g.adjacency().groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def relation_counts(g: Graph) -> DataFrame:
    return g.edges.groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("active"), 1)).alias("n_active"))


def _blocks(g: Graph) -> DataFrame:
    """Ownership edges by sector of the owned organisation: (domain, holder, blocks)."""
    s = g.sectors().select(F.col("id").alias("target"), "domain")
    return g.of(*OWN).join(s, "target").groupBy("domain", F.col("source").alias("holder")).agg(F.count(F.lit(1)).alias("blocks"))


def _reach(g: Graph) -> DataFrame:
    """Distinct (domain, holder, org) reached by ownership or role."""
    s = g.sectors().select(F.col("id").alias("target"), "domain")
    return g.of(*OWN, *ROLE).join(s, "target").select("domain", F.col("source").alias("holder"), F.col("target").alias("org")).distinct()


def concentration(g: Graph, floor: int = STANDARDS["min_positions"], high: int = STANDARDS["concentration_hhi_high"], top: int = 4) -> DataFrame:
    """Per sector: blocks, holders, HHI (null under ``floor`` blocks), organisations reached, share of the top reachers."""
    b = _blocks(g).groupBy("domain").agg(F.sum("blocks").alias("total"), F.count(F.lit(1)).alias("holders"), F.sum(F.col("blocks") * F.col("blocks")).alias("squares"))
    hhi = F.when(F.col("total") >= floor, F.round(F.col("squares") * 10000 / (F.col("total") * F.col("total")), 0).cast("long"))
    r = _reach(g)
    w = Window.partitionBy("domain").orderBy(F.desc("n"), "label", "holder")
    labels = g.nodes.select(F.col("id").alias("holder"), "label")
    best = r.groupBy("domain", "holder").agg(F.count(F.lit(1)).alias("n")).join(labels, "holder").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    reached = r.join(best.select("domain", "holder"), ["domain", "holder"], "left_semi").groupBy("domain").agg(F.countDistinct("org").alias("top_reach"))
    every = r.groupBy("domain").agg(F.countDistinct("org").alias("organizations"))
    domains = g.sectors().select("domain").distinct()
    out = domains.join(b, "domain", "left").join(every, "domain", "left").join(reached, "domain", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("domain", zero("total"), zero("holders"), hhi.alias("hhi"), F.coalesce(hhi > high, F.lit(False)).alias("flag"), zero("organizations"), zero("top_reach"))


def top_holders(g: Graph, top: int = 5) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc("blocks"), "holder")
    total = F.sum("blocks").over(Window.partitionBy("domain"))
    return _blocks(g).select("domain", "holder", "blocks", total.alias("total"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= top)


def board_independence(g: Graph, least: int = STANDARDS["min_board_size"], share: float = STANDARDS["independence_min_share"]) -> DataFrame:
    """Boards of ``least`` or more directors: directors, tied ones, independent ones, flag at ``share`` or less."""
    seats = g.of("DIRECTOR_OF").join(g.persons().select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("org"), F.col("source").alias("person")).distinct()
    boards = seats.groupBy("org").agg(F.count(F.lit(1)).alias("directors")).where(F.col("directors") >= least)
    own = g.of(*OWN).select(F.col("source").alias("owner"), F.col("target").alias("org"))
    direct = g.of("OFFICER_OF", *OWN).select(F.col("target").alias("org"), F.col("source").alias("person"))
    roles = g.of(*OWN, *ROLE).select(F.col("source").alias("person"), F.col("target").alias("owner"))
    through = own.join(roles, "owner").select("org", "person")
    tied = seats.join(direct.union(through).distinct(), ["org", "person"], "left_semi").groupBy("org").agg(F.count(F.lit(1)).alias("tied"))
    out = boards.join(tied, "org", "left").withColumn("tied", F.coalesce("tied", F.lit(0)).cast("long"))
    return out.select("org", "directors", "tied", (F.col("directors") - F.col("tied")).alias("independent"), ((1 - F.col("tied") / F.col("directors")) <= share).alias("flag"))


def long_tenure(g: Graph, years: float = STANDARDS["tenure_years"]) -> DataFrame:
    days = F.datediff("last_filing", "first_filing")
    return g.of("DIRECTOR_OF").select(F.col("source").alias("person"), F.col("target").alias("org"), days.cast("long").alias("days")).where(F.col("days") / 365.25 > years)


def overboarding(g: Graph, seats: int = STANDARDS["overboard_seats"], outside: int = STANDARDS["overboard_ceo_outside"]) -> DataFrame:
    """Persons with more than ``seats`` boards, or officers somewhere with more than ``outside`` boards elsewhere."""
    held = g.of(*ROLE).join(g.persons().select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("source").alias("person")).agg(
        F.collect_set(F.when(F.col("relationship_type") == "DIRECTOR_OF", F.col("target"))).alias("boards"),
        F.collect_set(F.when(F.col("relationship_type") == "OFFICER_OF", F.col("target"))).alias("offices"),
    )
    n, away = F.size("boards"), F.size(F.array_except("boards", "offices"))
    return held.where((n > seats) | ((F.size("offices") > 0) & (away > outside))).select("person", n.cast("long").alias("seats"), away.cast("long").alias("outside"), F.array_join(F.array_sort("boards"), ",").alias("boards"))


def flag_ranking(g: Graph, tenure_years: float, seats: int, outside: int, hhi_high: int, cut_points: DataFrame | None = None) -> DataFrame:
    """Flags per entity over all measures, ordered by total, kinds, degree, label."""
    ind = board_independence(g).where("flag")
    parts = [ind.select(F.col("org").alias("id"), F.lit("independence").alias("kind"))]
    ten = long_tenure(g, tenure_years)
    parts += [ten.select(F.col(c).alias("id"), F.lit("tenure").alias("kind")) for c in ("person", "org")]
    parts.append(overboarding(g, seats, outside).select(F.col("person").alias("id"), F.lit("overboarding").alias("kind")))
    flagged = concentration(g, high=hhi_high).where("flag").select("domain")
    parts.append(top_holders(g, 3).join(flagged, "domain", "left_semi").select(F.col("holder").alias("id"), F.lit("concentration").alias("kind")))
    if cut_points is not None:
        parts.append(cut_points.select("id", F.lit("single_point").alias("kind")))
    flags = parts[0]
    for p in parts[1:]:
        flags = flags.unionByName(p)
    totals = flags.groupBy("id").agg(F.count(F.lit(1)).alias("total"), F.countDistinct("kind").alias("kinds"))
    out = totals.join(degree_count(g), "id").join(g.nodes.select("id", "label"), "id")
    return numbered(out, F.desc("total"), F.desc("kinds"), F.desc("degree"), "label", "id").select("id", "total", "kinds", "degree", "rank")


def flagged(populations: dict[str, DataFrame]) -> DataFrame:
    """(id, kinds): entities of any flagged population, with the sorted kinds of flags they have."""
    every = None
    for kind, p in populations.items():
        one = p.select("id", F.lit(kind).alias("kind"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
