"""Log files as numbered lines of exact bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.staging import Staging


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line, raw): every line of every file under ``path``, ``log`` the file's path, ``line`` from 1, ``raw`` its
    bytes without the \\n that ends it; a \\r stays. A byte order mark at the start of a file is not part of its first line.

    The lines are staged once, so that numbers do not depend on how later scans cut the files. Numbers are those inside a
    block of a file plus the lines of the blocks before, so no file's lines are sorted or brought together."""
    read = spark.read.option("lineSep", "\n").text(path)
    read = read.select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("raw"))
    staged = Staging(spark, "lines").write(read)
    blocks = staged.groupBy("log", "block").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("log").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("log", "block", "first", before.alias("before"))
    return staged.join(blocks, ["log", "block"]).select("log", (F.col("before") + F.col("pos") - F.col("first") + 1).alias("line"), "raw")
