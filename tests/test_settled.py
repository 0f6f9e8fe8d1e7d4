"""People merged until nothing changes against one pair after the other; batches, holds and long lists of names."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import identity, records, textlint
from quillgraph.plans.commits import CommitLog
from quillgraph.plans.ranks import numbered
from quillgraph.sources import batches


def sequential(people, ties):
    """Runs of pairs in order, a record in one pair a run, until a run merges nothing. people: {id: (name, official)}."""
    people, orgs, into = dict(people), {}, {i: i for i in people}
    for p, o in ties:
        orgs.setdefault(p, set()).add(o)
    while True:
        found = []
        for a in people:
            for b in people:
                if a < b and people[a][0] == people[b][0] and orgs.get(a, set()) & orgs.get(b, set()) and not (people[a][1] and people[b][1]):
                    found.append((b if people[b][1] else a, a, b))
        used = set()
        for keep, a, b in sorted(found):
            if not {a, b} & used:
                used |= {a, b}
                gone = b if keep == a else a
                orgs.setdefault(keep, set()).update(orgs.pop(gone, set()))
                people[keep] = (people[keep][0], people[keep][1] or people[gone][1])
                del people[gone]
                into = {i: keep if k == gone else k for i, k in into.items()}
        if not used:
            return into


@pytest.mark.parametrize("kind", ["chain", "random"])
def test_people_settle_as_one_after_the_other(spark, kind):
    r = random.Random(3)
    if kind == "chain":
        order = list(range(50))
        r.shuffle(order)
        people = {i: ("Robert Quill", None) for i in range(50)}
        ties = [(p, n) for n, p in enumerate(order)] + [(p, n + 1) for n, p in enumerate(order)]
    else:
        people = {i: (r.choice(["Robert Quill", "Mary Sanders"]), str(i) if r.random() < 0.15 else None) for i in range(40)}
        ties = [(i, r.randrange(25)) for i in range(40) for _ in range(2)]
    rows = spark.createDataFrame([(i, n, {"sec_cik": o} if o else None) for i, (n, o) in people.items()], "id long, name string, ids map<string,string>")
    got = identity.settle_people(rows, spark.createDataFrame(ties, "person long, org long"))
    assert {x.id: x.keep for x in got.collect()} == sequential(people, ties)


def test_nobody_to_settle(spark):
    rows = spark.createDataFrame([(1, "Ann Other", None)], "id long, name string, ids map<string,string>")
    none = spark.createDataFrame([], "person long, org long")
    assert [tuple(x) for x in identity.settle_people(rows, none).collect()] == [(1, 1)]
    assert identity.settle_people(rows.limit(0), none).count() == 0


def test_batches_apply_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    edge = lambda key, t, approve=True: {"key": key, "source": "A", "target": t, "relationship_type": "R", "approve": approve}
    for n, edges in enumerate([[edge("1", "X"), edge("2", "Y", False)], [edge("1", "X"), edge("3", "Z"), edge("4", "Z")], []]):
        (folder / f"{n}.json").write_text(json.dumps({"batch_id": f"B2024010{n}T01", "created_at": "t", "centers": ["c"], "edges": edges}))
    (folder / "9.json").write_text(json.dumps({"batch_id": "other", "edges": [edge("1", "W")]}))
    for n, f in enumerate(sorted(folder.glob("*.json"))):
        os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    listed = batches.list_batches(spark, str(folder)).orderBy(F.desc("batch_id")).collect()
    assert [(x.batch_id, x.edges) for x in listed] == [("B20240102T01", 0), ("B20240101T01", 3), ("B20240100T01", 2)]
    log = CommitLog(spark, f"file://{tmp_path}/log")
    for place in ("a", "b", "a"):
        batches.apply_batches(spark, str(folder), log, str(tmp_path / place)).awaitTermination()
        assert {tuple(x) for x in batches.applied(log).collect()} == {("B20240100T01", 1, 0), ("B20240101T01", 1, 2)}
        assert sorted(x.target for x in log.read().where("outcome = 'added'").collect()) == ["X", "Z"]
    rows = log.read().limit(1).drop("outcome")
    at = batches.apply_rows(log, rows, "again")
    assert batches.apply_rows(log, rows, "again") == at and log.problems().count() == 0


def test_claims_hold_skips_quotes_and_sections(spark):
    texts = ["They billed the agency.\nSee sam.gov", 'He said "kickbacks" and “qui tam”.', "## 7. Sources\nmedicare", "overbilling\nLegal consult: 2024-01-02, cleared by X", "anti-kickback", "plain", None, ""]
    got = {x.doc: (x.signs, x.hold) for x in textlint.claims_hold(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (2, True), 3: (1, False), 4: (1, True)}


def test_names_of_any_length_are_found_in_both_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcd"), (2, "xy"), (3, "")], "id long, text string")
    names = spark.createDataFrame([("a",), ("cd",), ("bcd",), ("xy",), ("abcde",), ("",)], "name string")
    want = {(1, "a"), (1, "cd"), (1, "bcd"), (2, "xy"), (1, ""), (2, ""), (3, "")}
    for most in (records.BROADCAST_NAMES, -1):
        monkeypatch.setattr(records, "BROADCAST_NAMES", most)
        assert {(x.id, x.name) for x in records.contained_names(texts, "text", names, "name").collect()} == want


def test_row_numbers_with_clashing_columns(spark):
    df = spark.range(50).select("id", *[F.lit(0).alias(c) for c in ("__part", "__p", "_inside", "before", "___before")])
    got = numbered(df, F.desc("id"))
    assert got.columns == [*df.columns, "rank"] and {(x.id, x["rank"]) for x in got.collect()} == {(i, 50 - i) for i in range(50)}
