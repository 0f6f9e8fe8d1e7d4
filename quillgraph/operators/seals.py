"""Logs whose older lines are sealed as one block by a digest of their bytes, and hash-chained from there on."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.integrity import entry_hash
from quillgraph.plans.versions import chained

#: The event of an entry that seals all lines before it.
SEAL = "chain_start"


def seal_entry(lines: list[bytes]) -> str:
    """The entry that seals ``lines``, the whole of a log that was not chained so far."""
    digest = hashlib.sha256(b"".join(x + b"\n" for x in lines)).hexdigest()
    return chained([{"event": SEAL, "sealed_lines": len(lines), "sealed_sha256": digest}], tip=digest)[0]


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At each seal, the digest of all lines of its log before it; lines come by log and in order, a batch at a time."""
    log, running = None, hashlib.sha256()
    for f in frames:
        out = []
        for at, line, raw, seal in zip(f["log"], f["line"], f["raw"], f["seal"], strict=True):
            if at != log:
                log, running = at, hashlib.sha256()
            if seal:
                out.append((at, line, running.hexdigest()))
            running.update(raw)
            running.update(b"\n")
        yield pd.DataFrame(out, columns=["log", "line", "digest"])


def sealed_digests(lines: DataFrame, seals: DataFrame) -> DataFrame:
    """(log, line, digest) for each row of ``seals`` (log, line). A digest is ordered by nature: one task reads a log's
    lines up to its last seal, sorted on disk and passed on in batches; lines after that are not read."""
    last = seals.groupBy("log").agg(F.max("line").alias("last"))
    at = seals.select("log", "line", F.lit(True).alias("seal"))
    covered = lines.join(last, "log").where("line <= last").select("log", "line", "raw").join(at, ["log", "line"], "left")
    ordered = covered.withColumn("seal", F.coalesce("seal", F.lit(False))).repartition("log").sortWithinPartitions("log", "line")
    return ordered.mapInPandas(_digests, f"log {dict(lines.dtypes)['log']}, line long, digest string")


def verify_log(lines: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """(log, line, problem) of logs of JSON lines (log, line, raw bytes; see ``sources.lines.raw_lines``).

    Before the first seal or fingerprinted entry nothing is held against a line. From then on a line is unreadable (no
    JSON object, or no UTF-8), not part of the chain (no hash), changed (its hash is not that of its content), or does not
    point to the entry before it; a fingerprinted entry that nothing comes before has no chain start before it. A seal is
    held against the bytes of all lines before it and against its own hash. Empty lines count as lines and are no entries.
    ``anchors`` (log, line, tip) of which the line no longer holds the hash are problems without a line.

    Lines are rehashed in parallel; only hashes go through the window over a log, and only sealed lines through one task."""
    text = F.col("raw").cast("string")
    readable = F.when(F.is_valid_utf8(text), text)
    get = lambda k: F.get_json_object("text", f"$.{k}")
    rows = lines.select("log", "line", readable.alias("text"), (F.length(F.regexp_replace(text, r"\s+", "")) > 0).alias("filled"))
    rows = rows.where("filled").select("log", "line", entry_hash("text").alias("real"), get("event").alias("event"), get("prev").alias("prev"), get("hash").alias("hash"), get("sealed_sha256").alias("sealed"))
    rows = rows.withColumn("seal", F.col("real").isNotNull() & F.col("event").eqNullSafe(SEAL)).withColumn("linked", F.col("real").isNotNull() & (F.col("seal") | F.col("hash").isNotNull()))
    seals = rows.where("seal").select("log", "line")
    w = Window.partitionBy("log").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("tip", F.last(F.when(F.col("linked"), F.struct("hash")), ignorenulls=True).over(w)["hash"])
    rows = rows.join(sealed_digests(lines, seals), ["log", "line"], "left")
    seal, entry, begun = F.col("seal"), F.col("linked") & ~F.col("seal"), F.col("tip").isNotNull()
    own = F.col("hash").eqNullSafe(F.col("real"))
    cases = [
        ("unreadable", F.col("real").isNull() & begun),
        ("sealed lines changed", seal & ~(F.col("sealed").eqNullSafe(F.col("digest")) & F.col("prev").eqNullSafe(F.col("sealed")))),
        ("seal altered", seal & ~own),
        ("no chain start before it", entry & ~begun),
        ("does not point to the entry before it", entry & begun & ~F.col("prev").eqNullSafe(F.col("tip"))),
        ("content changed", entry & ~own),
        ("not part of the chain", F.col("real").isNotNull() & ~F.col("linked") & begun),
    ]
    problems = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in cases]))
    found = rows.select("log", "line", F.explode(problems).alias("problem"))
    if anchors is None:
        return found
    held = rows.where("linked").select("log", F.col("line").alias("seq"), "hash")
    lost = anchors.join(held.select("log", F.col("seq").alias("line"), F.col("hash").alias("tip")), ["log", "line", "tip"], "left_anti")
    return found.unionByName(lost.select("log", F.lit(None).cast("long").alias("line"), F.lit("anchor is no longer in the log").alias("problem")))
