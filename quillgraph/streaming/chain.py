"""Continuous verification of hash-chained logs with Structured Streaming.

One key per chain; the state is the chain's tip. A record that does not point to the tip is a break, late and
out-of-order ones included, and the tip moves on to it, so that one edit gives one break."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgraph.operators.integrity import entry_hash

OUT = "shard string, seq long, problem string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tip = state.get[0] if state.exists else None
    found = []
    rows = pd.concat(list(frames), ignore_index=True).sort_values("seq")
    for seq, prev, own, real in zip(rows["seq"], rows["prev"], rows["hash"], rows["real"], strict=True):
        if own is None:
            if tip is not None:
                found.append((key[0], seq, "not part of the chain" if real is not None else "unreadable"))
            continue
        if real != own:
            found.append((key[0], seq, "content changed"))
        if tip is not None and prev != tip:
            found.append((key[0], seq, "does not point to the entry before it"))
        tip = own
    if tip is not None:
        state.update((tip,))
    yield pd.DataFrame(found, columns=["shard", "seq", "problem"])


def chain_breaks(stream: DataFrame) -> DataFrame:
    """(shard, seq, problem) of a stream of (shard, seq, raw) log lines."""
    rows = stream.select(
        "shard", "seq", F.get_json_object("raw", "$.prev").alias("prev"), F.get_json_object("raw", "$.hash").alias("hash"), entry_hash("raw").alias("real")
    )
    return rows.groupBy("shard").applyInPandasWithState(_step, OUT, "tip string", "append", GroupStateTimeout.NoTimeout)


def recent_activity(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and value per type and window of event time, late ones up to ``delay``."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
