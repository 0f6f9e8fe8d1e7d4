"""Review batches: files of proposed edges, listed newest first, applied as a stream, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.plans.commits import CommitLog

EDGE = ("source", "target", "relationship_type")
SCHEMA = "batch_id string, created_at string, centers array<string>, edges array<struct<key:string,source:string,target:string,relationship_type:string,approve:boolean>>"
#: Form of a batch's id; records with another one are not batches.
BATCH_ID = "^B[0-9T]{6,20}$"


def list_batches(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """(batch_id, created_at, centers, edges, modified) of a folder's batches: their number of edges, and when the file was
    last written. Sort by ``batch_id`` descending for the newest first; ids begin with the time."""
    b = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(folder).where(F.col("batch_id").rlike(BATCH_ID))
    return b.select("batch_id", "created_at", "centers", F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("edges"), F.col("_metadata.file_modification_time").alias("modified"))


def apply_rows(log: CommitLog, rows: DataFrame, once: str) -> int:
    """Commits approved rows (batch_id, key, source, target, relationship_type) with their outcome: ``added``, or
    ``already_present`` if the log or an earlier key of these rows has the edge. A second call with the same ``once`` changes nothing."""
    first = rows.groupBy(*EDGE).agg(F.min(F.struct("batch_id", "key")).alias("first"))
    out = rows.join(first, list(EDGE)).withColumn("new", F.struct("batch_id", "key") == F.col("first"))
    if log.version():
        held = log.read().where("outcome = 'added'").select(*EDGE, F.lit(True).alias("held")).distinct()
        out = out.join(held, list(EDGE), "left").withColumn("new", F.col("new") & F.col("held").isNull())
    return log.append(out.select("batch_id", "key", *EDGE, F.when(F.col("new"), "added").otherwise("already_present").alias("outcome")), once=once)


def apply_batches(spark: SparkSession, folder: str, log: CommitLog, checkpoint: str, label: str = "batches", files_per_trigger: int = 1, multi_line: bool = False) -> StreamingQuery:
    """Applies all batches of a folder that are there now, in the order their files were written, and ends.

    Each trigger is one commit under a name made of ``label`` and its number, so one that is run again after a loss
    finds itself committed."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("multiLine", multi_line).json(folder)
    rows = stream.where(F.col("batch_id").rlike(BATCH_ID)).select("batch_id", F.explode("edges").alias("e")).select("batch_id", "e.*").where("approve").drop("approve")

    def put(part: DataFrame, number: int) -> None:
        apply_rows(log, part, f"{label}/{number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(log: CommitLog) -> DataFrame:
    """(batch_id, added, already_present): what each batch did."""
    n = lambda kind: F.sum((F.col("outcome") == kind).cast("long")).alias(kind)
    return log.read().groupBy("batch_id").agg(n("added"), n("already_present"))
