"""Commits of racing writers, conflicts, lost jobs and tampering; ordered verification of streams against the batch."""

import json
import os
import random
import threading

import pytest

from quillgraph.operators.integrity import verify_chain
from quillgraph.plans.commits import CommitLog
from quillgraph.plans.versions import ChangedError, chained


def ids(df):
    return sorted(r.id for r in df.collect())


def test_racing_appends_are_all_kept_and_one_replacement_wins(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    first = CommitLog(spark, root)
    assert first.version() == 0 and first.numbers() == []
    with pytest.raises(ValueError):
        first.read()
    first.append(spark.range(3))
    done, lost = [], []

    def add(k):
        done.append(CommitLog(spark, root).append(spark.range(100 * k, 100 * k + 2), writer=k))

    writers = [threading.Thread(target=add, args=(k,)) for k in range(1, 7)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(done) == list(range(2, 8)) == first.numbers()[1:]
    assert ids(first.read()) == [0, 1, 2] + [100 * k + i for k in range(1, 7) for i in range(2)]
    assert ids(first.read(1)) == [0, 1, 2]

    read = first.version()

    def put(k):
        try:
            done.append(CommitLog(spark, root).replace(spark.range(k, k + 1), read))
        except ChangedError:
            lost.append(k)

    writers = [threading.Thread(target=put, args=(k,)) for k in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert len(lost) == 3 and len(first.read().collect()) == 1
    assert len(os.listdir(tmp_path / "t" / "data")) == 8, "data of lost replacements is deleted"
    assert not os.listdir(tmp_path / "t" / "draft")


def test_anchors_and_events_do_not_conflict_and_tampering_shows(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/t")
    log.append(spark.range(2), note="ü")
    log.log(event="checked")
    at = log.anchor()
    assert log.replace(spark.range(5), 1) == at + 1 and ids(log.read()) == [0, 1, 2, 3, 4]
    with pytest.raises(ChangedError):
        log.replace(spark.range(1), 1)
    assert log.problems().count() == 0 and log.records().count() == 4
    name = tmp_path / "t" / "log" / f"{2:020d}.json"
    body = json.loads(name.read_text())
    name.unlink()
    name.write_text(json.dumps(body | {"event": {"event": "other"}}))
    [c.unlink() for c in (tmp_path / "t" / "log").glob(".*.crc")]
    assert {(r.seq, r.problem) for r in log.problems().collect()} == {(2, "content changed")}
    # The whole log rewritten from there on: only the anchor tells.
    lines, tip = [], json.loads((tmp_path / "t" / "log" / f"{1:020d}.json").read_text())["hash"]
    for n in range(2, 5):
        m = json.loads((tmp_path / "t" / "log" / f"{n:020d}.json").read_text())
        lines = chained([{k: v for k, v in m.items() if k not in ("hash", "prev")}], tip)
        tip = json.loads(lines[0])["hash"]
        (tmp_path / "t" / "log" / f"{n:020d}.json").write_text(lines[0])
    assert {(r.seq, r.problem) for r in log.problems().collect()} == {(2, "anchor is no longer in the log")}


def stream_rows(spark, folder, tmp_path, files):
    """Breaks of files taken one at a trigger; each file: (minute, lines of (shard, seq, raw))."""
    from quillgraph.streaming.ordered import ordered_breaks

    os.makedirs(folder)
    for n, (minute, lines) in enumerate(files):
        path = f"{folder}/{n:03d}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps({"shard": s, "seq": q, "ts": f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", "raw": raw}) + "\n" for s, q, raw in lines)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("shard string, seq long, ts timestamp, raw string").option("maxFilesPerTrigger", 1).json(str(folder))
    q = ordered_breaks(stream).writeStream.format("memory").queryName("ordered").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        return sorted((r.shard, r.seq, r.problem) for r in spark.table("ordered").collect())
    finally:
        q.stop()


def test_shuffled_late_and_missing_records_equal_the_batch(spark, tmp_path):
    r = random.Random(4)
    logs = {s: list(enumerate(chained([{"event": s, "n": n} for n in range(30)]), 1)) for s in ("a", "b", "c")}
    logs["a"][7] = (8, logs["a"][7][1].replace('"n": 7', '"n": 99'))  # edited
    logs["b"][11] = (12, '{"event": "b"}')  # without a hash
    logs["b"][20] = (21, "not json")
    present = {s: [x for x in lines if (s, x[0]) not in {("c", 10), ("c", 11), ("a", 29)}] for s, lines in logs.items()}
    want = sorted((x.shard, x.seq, x.problem) for x in verify_chain(spark.createDataFrame([(s, q, raw) for s, lines in present.items() for q, raw in lines], "shard string, seq long, raw string"), shard="shard").collect())
    assert {x[0] for x in want} == {"a", "b", "c"}
    every = [(s, q, raw) for s, lines in present.items() for q, raw in lines]
    r.shuffle(every)
    files = [(i, every[k : k + 15]) for i, k in enumerate(range(0, len(every), 15))]
    # Time goes on, so that holes are given up; then a record that was given up comes, and one comes twice.
    files += [(120, [("d", 1, chained([{"event": "d"}])[0])]), (121, [("d", 2, chained([{"event": "d"}])[0])])]
    files += [(180, [("c", 10, logs["c"][9][1]), ("a", 3, logs["a"][2][1])])]
    got = stream_rows(spark, tmp_path / "in", tmp_path, files)
    extra = [("a", 3, "late or repeated"), ("c", 10, "late or repeated"), ("d", 2, "does not point to the entry before it")]
    assert got == sorted(want + extra)
