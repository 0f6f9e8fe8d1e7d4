"""Connected components by alternating large-star and small-star.

Every round is a partial aggregation plus an equi-join, so a hub vertex is combined before the
shuffle and its edge list may be split by AQE's skew-join handling. The edge set never grows; the
number of rounds is logarithmic in the longest chain in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.staging import Staging


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("lo")).select("u", F.least("u", "lo").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    to_least = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def _is_star_forest(e: DataFrame) -> bool:
    """A fixed point: every u has one v, and no v is itself a u."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").count()


def connected_components(edges: DataFrame, staging: Staging, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is its smallest reachable node.

    Edges may repeat, point either way, or be self loops; rows with a null end are ignored. An empty
    input gives an empty result. Isolated nodes have no row: callers use ``coalesce(component, id)``.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = staging.write(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_star_forest(e):
            break
        new = staging.write(_small_star(_large_star(e)).distinct(), "star")
        staging.drop(e)
        e = new
    else:
        raise RuntimeError("connected components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
