"""Verification of hash-chained logs as a stream whose records may come early, late, twice or never.

One key per log. Its state is the number and hash of the last record in order, and the records that came before their turn,
each under its number. A record in turn is verified at once, with all that waited for it. The first record that has to wait
sets an event-time timer: when the watermark passes it, what is missing is given up, and the log goes on with the
smallest number that waits, over as many holes as are due, whose link then does not fit, as it does not in a batch over the same records.
A record whose number is not after the last one verified is ``late or repeated``. Rows behind the watermark do not
reach the state, as usual for event time; they are missing then. Numbers of a log run from 1 without holes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillgraph.operators.integrity import entry_hash

OUT = "shard string, seq long, problem string"
#: A record that waits for its turn.
EARLY = "seq: long, prev: string, hash: string, real: string, came: long"
#: Records of a log taken up at a time.
PART = 10_000
#: State needs timers and maps, which only this store has.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Ordered(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a log: a call to the state costs more than the hashes of many records.
        self.log = handle.getValueState("log", f"seq long, tip string, timer long, early array<struct<{EARLY}>>")

    def _take(self, key: str, seq: int, tip: str | None, record: tuple, found: list[tuple]) -> tuple[int, str | None]:
        """Verifies the record in turn; returns the new last number and tip."""
        prev, own, real, _ = record
        if own is None:
            if tip is not None:
                found.append((key, seq, "not part of the chain" if real is not None else "unreadable"))
            return seq, tip
        if real != own:
            found.append((key, seq, "content changed"))
        if tip is not None and prev != tip:
            found.append((key, seq, "does not point to the entry before it"))
        return seq, own

    def _go_on(self, key: str, seq: int, tip: str | None, waiting: dict[int, tuple], found: list[tuple]) -> tuple[int, str | None]:
        while seq + 1 in waiting:
            seq, tip = self._take(key, seq + 1, tip, waiting.pop(seq + 1), found)
        return seq, tip

    def _state(self) -> tuple[int, str | None, int | None, dict[int, tuple]]:
        """Number and hash of the last record in order, the time of the timer, and the records that wait, by number."""
        found = self.log.get()
        return (found[0], found[1], found[2], {r[0]: tuple(r[1:]) for r in found[3]}) if found else (0, None, None, {})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        seq, tip, timer, waiting = self._state()
        found, latest = [], timerValues.getCurrentWatermarkInMs()
        for part in batched(rows, PART):
            latest = max(latest, max(r.came for r in part))
            for r in part:
                if r.seq <= seq or r.seq in waiting:
                    found.append((key[0], r.seq, "late or repeated"))
                else:
                    waiting[r.seq] = (r.prev, r.hash, r.real, latest)
            # Between two parts only what is out of turn stays in memory.
            seq, tip = self._go_on(key[0], seq, tip, waiting, found)
        self._keep(seq, tip, timer, waiting)
        yield from (Row(shard=shard, seq=n, problem=problem) for shard, n, problem in found)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        seq, tip, _, waiting = self._state()
        found, watermark = [], timerValues.getCurrentWatermarkInMs()
        while waiting and self._due(waiting) <= watermark:
            seq, tip = self._go_on(key[0], min(waiting) - 1, tip, waiting, found)
        self._keep(seq, tip, None, waiting)
        yield from (Row(shard=shard, seq=n, problem=problem) for shard, n, problem in found)

    def _due(self, waiting: dict[int, tuple]) -> int:
        """When the hole before the records that wait is given up: ``patience`` after the first of them came."""
        return min(record[3] for record in waiting.values()) + self.patience

    def _keep(self, seq: int, tip: str | None, timer: int | None, waiting: dict[int, tuple]) -> None:
        at = self._due(waiting) if waiting else None
        if at != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if at is not None:
                self.handle.registerTimer(at)
        self.log.update((seq, tip, at, [(k, *record) for k, record in waiting.items()]))

    def close(self) -> None:
        pass


def ordered_breaks(stream: DataFrame, patience_ms: int = 600_000, delay: str = "10 minutes") -> DataFrame:
    """(shard, seq, problem) of a stream of (shard, seq, ts, raw) log lines in any order; ``ts`` is when a line came in.

    A hole is given up when the watermark is ``patience_ms`` past the time of the rows that showed it."""
    stream.sparkSession.conf.set(*STORE)
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    rows = stream.withWatermark("ts", delay).select(F.col("shard").cast("string").alias("shard"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_millis("ts").alias("came"), get("prev").alias("prev"), get("hash").alias("hash"), entry_hash("raw").alias("real"))
    return rows.groupBy("shard").transformWithState(_Ordered(patience_ms), OUT, "Append", "EventTime")
