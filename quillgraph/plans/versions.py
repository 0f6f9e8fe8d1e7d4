"""A table kept as numbered versions, with a check that nobody else wrote in between, and hash-chained logs of it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChangedError(RuntimeError):
    """The table was written by someone else since it was read."""


class VersionedTable:
    """Versions are folders ``v=N``; the newest complete one counts, older ones stay for reading back.

    A version is complete once Spark's commit marker is there, so a job lost half way leaves the one before in place."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        fs, path = self._fs()
        if not fs.exists(path(self.root)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and fs.exists(path(f"{self.root}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> tuple[DataFrame, int]:
        version = self.versions()[-1] if version is None else version
        return self.spark.read.parquet(f"{self.root}/v={version}"), version

    def save(self, df: DataFrame, expected: int) -> int:
        """Writes the version after ``expected`` (0 for the first); fails if that is not the newest, or is being written."""
        newest = (self.versions() or [0])[-1]
        if newest != expected:
            raise ChangedError(f"read version {expected}, newest is {newest}")
        df.write.mode("errorifexists").parquet(f"{self.root}/v={expected + 1}")
        return expected + 1


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, sha256) of a frame, whatever its order: counts and sums of row hashes, combined before the shuffle."""
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("h")).select("rows", F.sha2(F.concat_ws(":", "rows", F.coalesce("h", F.lit(0))), 256).alias("sha256"))


def chained(events: list[dict], tip: str = "") -> list[str]:
    """Log lines that each carry the hash of the one before; a job appends a handful at a time."""
    out = []
    for e in events:
        body = {k: v for k, v in e.items() if k != "hash"} | {"prev": tip}
        tip = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out.append(json.dumps(body | {"hash": tip}, ensure_ascii=False))
    return out


def graph_matches_log(saved: DataFrame, now: DataFrame) -> DataFrame:
    """(ok): whether the last logged hash of (seq, sha256) is the one of the (sha256) frame; false without a log."""
    last = saved.agg(F.max_by("sha256", "seq").alias("last"))
    return now.select("sha256").limit(1).join(F.broadcast(last)).select(F.coalesce(F.col("last") == F.col("sha256"), F.lit(False)).alias("ok"))
