"""Corpus pipeline: toxicity, line dedup, near-duplicates, decontamination, and mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns documents with the
columns it got; the last one adds what the mix takes of each. ``run`` writes every stage as Parquet and reads
it again as the next one's input, so a lost executor costs at most a stage.

Odd input, beside what the operators state: a null text is never toxic, boilerplate, a duplicate or a leak
and stays up to the mix; a document that loses all its lines stays with an empty text; exact repeats of a row
leave one row at the near-duplicate stage; extra columns stay, whatever their names. In the last stage a
document of which nothing is taken (an empty one too) is not part of the mix and goes; exact repeats of a row, of which
the stage before leaves none, share evenly what the mix takes of them, less the remainder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.columns import at, unused
from quillgraph.llm.decontaminate import decontaminate
from quillgraph.llm.lines import dedup_lines
from quillgraph.llm.minhash import near_duplicates
from quillgraph.llm.mixing import mix
from quillgraph.llm.toxicity import drop_toxic, train
from quillgraph.plans.staging import Staging

#: Ids of dropped documents that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_DROPPED = 4_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(docs: DataFrame) -> F.Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def _without(docs: DataFrame, on: F.Column, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``on`` is in the one column of ``dropped``."""
    key, gone = unused(docs.columns, "key", "gone")
    dropped = Staging(docs.sparkSession, "dropped").write(dropped.toDF(gone).distinct())
    few = dropped.count() <= BROADCAST_DROPPED
    keyed = docs.withColumn(key, on)
    return keyed.join(F.broadcast(dropped) if few else dropped, F.col(key) == F.col(gone), "left_anti").select(*[at(docs, c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, train(docs, _table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs)
    counted = F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return out.select(*[counted.alias(c) if c == "n_chars" else at(out, c) for c in out.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = Staging(spark, "near").write(near_duplicates(docs, k=5, num=80, den=100))
    out = _without(docs, docs["doc_id"].cast("long"), found.where("not kept").select("doc_id"))
    repeats = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return out if repeats.isEmpty() else out.dropDuplicates()


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, _key(docs), decontaminate(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select("row"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: its documents' columns and size, source_size, target and taken."""
    figures = ("size", "source_size", "target", "taken")
    of_row = F.xxhash64(_key(docs), docs["source"].cast("string"))
    slim = docs.select("doc_id", "source", "text", of_row.alias("row_key"))
    plan = mix(slim, carry=("row_key",)).groupBy("row_key").agg(F.floor(F.avg("taken")).cast("long").alias("taken"), *[F.max(c).alias(c) for c in figures[:3]]).where("taken > 0")
    key, mixed_key, *inner = unused(docs.columns, "key", "mixed_key", *(f"the_{c}" for c in figures))
    plan = plan.select(F.col("row_key").alias(mixed_key), *[F.col(c).alias(i) for c, i in zip(figures, inner, strict=True)])
    out = docs.withColumn(key, of_row).join(plan, F.col(key) == F.col(mixed_key))
    taken_names = {c.lower() for c in docs.columns}
    named = [c if c not in taken_names else f"mix_{c}" for c in figures]
    return out.select(*[at(docs, c) for c in docs.columns], *[F.col(i).alias(name) for i, name in zip(inner, named, strict=True)])


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_boilerplate),
    ("minhash_near_dedup", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
]

#: The fitted toxicity scores and the exact near-duplicate groups have no SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = Staging(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = st.write(docs, name)
    return docs
