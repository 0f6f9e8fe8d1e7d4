"""Row numbers over a whole frame without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.staging import Staging


def numbered(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with its row number from 1 in the total order of ``order``: a range sort, the sizes of its parts, and a
    running number inside each. The one window without a key holds a row per part. Ties are numbered in any order."""
    st = Staging(df.sparkSession, "numbered")
    taken = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in df.columns), default=0))
    part, of, before, inside = (taken + x for x in ("part", "of", "before", "inside"))
    parts = st.write(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    earlier = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(F.col(part).alias(of)).agg(F.count(F.lit(1)).alias("n")).select(of, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    out = parts.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*order))).join(F.broadcast(offsets), F.col(part) == F.col(of))
    return out.withColumn(name, (F.col(before) + F.col(inside)).cast("long")).drop(part, of, before, inside)
