"""Hash-chained logs: hashes of canonical JSON, chain links, anchors."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fields of an edge's integrity part that its fingerprint leaves out.
UNHASHED = ("verification_hash", "superseded_by", "superseded_at", "supersede_reason", "recorded_at")


def canonical(record: dict, compact: bool) -> str:
    return json.dumps(record, sort_keys=True, ensure_ascii=False, separators=(",", ":") if compact else None)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def entry_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of a log record's compact canonical JSON without its own hash; null if it is no JSON object."""

    def one(text):
        try:
            record = json.loads(text)
            return _sha(canonical({k: v for k, v in record.items() if k != "hash"}, compact=True))
        except (TypeError, ValueError, AttributeError):
            return None

    return raw.map(one)


@F.pandas_udf(T.StringType())
def edge_hash(raw: pd.Series) -> pd.Series:
    """SHA-256 of an edge's canonical JSON without the integrity fields that change after it is recorded."""

    def one(text):
        try:
            edge = json.loads(text)
        except (TypeError, ValueError):
            return None
        edge["integrity"] = {k: v for k, v in edge.get("integrity", {}).items() if k not in UNHASHED}
        return _sha(canonical(edge, compact=False))

    return raw.map(one)


def verify_chain(log: DataFrame, seq: str = "seq", raw: str = "raw", shard: str | None = None) -> DataFrame:
    """(shard, seq, problem) of a log of JSON lines: content changed, not linked to the record before, unhashed or
    unreadable after the chain began. Records are rehashed in parallel; only hashes go through the window, one chain
    (``shard``) at a time, since a chain is ordered by nature."""
    get = lambda k: F.get_json_object(raw, f"$.{k}")
    rows = log.select((F.col(shard) if shard else F.lit("log")).alias("shard"), F.col(seq).alias("seq"), get("prev").alias("prev"), get("hash").alias("hash"), F.length(F.btrim(raw)).alias("size"), entry_hash(raw).alias("real"))
    rows = rows.where("size > 0")
    w = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tip", F.last("hash", ignorenulls=True).over(w))
    # Each test in turn, over the tip of the last hashed record.
    cases = [
        ("unreadable", F.col("tip").isNotNull() & F.col("real").isNull()),
        ("not part of the chain", F.col("tip").isNotNull() & F.col("real").isNotNull() & F.col("hash").isNull()),
        ("content changed", F.col("hash").isNotNull() & (F.col("real") != F.col("hash"))),
        ("does not point to the entry before it", F.col("tip").isNotNull() & F.col("hash").isNotNull() & ~F.col("prev").eqNullSafe(F.col("tip"))),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases]))
    return rows.select("shard", "seq", F.explode(problems).alias("problem"))


def missing_anchors(anchors: DataFrame, log: DataFrame) -> DataFrame:
    """(line, tip) anchors whose hash is not at the line they name; log: seq, hash."""
    return anchors.join(log.select(F.col("seq").alias("line"), F.col("hash").alias("tip")), ["line", "tip"], "left_anti").select("line", "tip")


def fingerprint(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, rows, sha256): a fingerprint of each key's rows, whatever their order: the hash of their number and of the
    sums of both halves of their MD5, which combine before the shuffle, so that no key's rows are ever together."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    md5 = F.md5(text.cast("binary"))
    half = lambda n: F.sum(F.conv(F.substring(md5, n, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), half(1), half(16)), 256).alias("sha256"))


def first_breaks(breaks: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` problems of a chain, in order: a report."""
    return breaks.orderBy("shard", "seq", "problem").limit(most)
