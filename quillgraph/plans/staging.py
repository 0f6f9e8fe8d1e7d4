"""Durable intermediate tables.

Long or iterative plans are cut by writing a Parquet table to the shared folder named by
``spark.checkpoint.dir`` and reading it back: the table survives lost executors, which a local
checkpoint or a cache does not, and every later branch of the plan reads it instead of recomputing.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local session, whose tasks share the machine, may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Folders of the tables this process has staged.
_ROOTS: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes all tables staged so far; frames that still read them fail from here on."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


class Staging:
    """Tables of one job, each under its own folder; ``drop`` removes those no longer read, ``clear`` all of them."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self._n = 0

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def together(self, frames: list[DataFrame]) -> DataFrame:
        """Tables written here, of one schema, as one scan."""
        return self.spark.read.schema(frames[0].schema).parquet(*[df._staged_path for df in frames])

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_staged_path", None)
            if path:
                _delete(self.spark, path)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a table written inside was shuffled for goes when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_REUSED: dict[tuple[str, str], DataFrame] = {}


def reused(spark: SparkSession, key: str, make) -> DataFrame:
    """The frame of ``make()`` as a table staged once a session under ``key``, staged anew if its files are gone."""
    known = (spark.sparkContext.applicationId, key)
    found = _REUSED.get(known)
    if found is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{found._staged_path}/_SUCCESS")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return found
    _REUSED[known] = Staging(spark, "reused").write(make())
    return _REUSED[known]
