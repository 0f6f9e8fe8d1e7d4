"""Chains of events are built row by row, not in a group each, and a log's state is one value."""

import pandas as pd
from pyspark.sql import Row

from quillgraph import catalog
from quillgraph.catalogs.logs import _log_lines
from quillgraph.streaming.ordered import _Ordered


def test_chains_are_built_without_a_group_each(spark, small):
    plan = catalog.QUERIES["au01_chain_verification"](spark, small)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_user_cut_by_batches_has_the_same_lines():
    rows = pd.DataFrame({"event_id": [1, 3, 7, 64, 2, 5], "user_id": [1, 1, 1, 1, 2, 2], "event_type": list("abcdef")})
    whole = pd.concat(_log_lines(iter([rows])))
    cut = pd.concat(_log_lines(iter([rows[:2], rows[2:5], rows[5:]])))
    assert whole.values.tolist() == cut.values.tolist()
    assert whole[["shard", "seq", "event_id"]].values.tolist() == [["1", 1, 1], ["1", 3, 7], ["2", 1, 2], ["2", 2, 5]]


class _Handle:
    """A state that counts its calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getMapState = getValueState  # noqa: N815

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


class _Now:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_calls_to_the_state_do_not_grow_with_the_records_that_wait():
    log, state = _Ordered(600_000), _Handle()
    log.init(state)
    row = lambda n, prev: Row(seq=n, came=1000, prev=prev, hash=f"h{n}", real=f"h{n}")
    assert list(log.handleInputRows(("a",), iter([row(n, f"h{n - 1}") for n in range(300, 2, -1)]), _Now(0))) == []
    assert state.calls <= 4 and state.timers == [601_000]
    state.calls = 0
    assert list(log.handleInputRows(("a",), iter([row(1, "")]), _Now(0))) == []
    assert state.calls <= 4 and state.value[0] == 1
    state.timers.clear()
    assert list(log.handleExpiredTimer(("a",), _Now(601_000), None)) == [Row(shard="a", seq=3, problem="does not point to the entry before it")]
    assert state.value[:3] == (300, "h300", None) and state.timers == []
