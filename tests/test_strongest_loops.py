"""Loops on dense graphs: people counted without arrays, open loops not shuffled, the strongest found without making all."""

import random
from itertools import combinations

import pytest
from helpers_loops import brute_squares, projection_of

from quillgraph.operators import interlocks


@pytest.mark.parametrize("seed,most", [(1, 3), (2, 25), (3, 100_000)])
def test_strongest_squares_are_the_first_of_all(spark, seed, most):
    r = random.Random(seed)
    seats = {(f"P{r.randrange(40)}", f"O{min(r.randrange(14), r.randrange(14)):02}") for _ in range(110)}
    want = sorted(brute_squares(seats).items(), key=lambda x: (-x[1], x[0]))
    got = [(x.orgs, x.people) for x in interlocks.closed_squares(projection_of(spark, seats), most).orderBy("people", ascending=False).collect()]
    assert len(want) > 25 and sorted(got, key=lambda x: (-x[1], x[0])) == want[:most]


def test_equal_ties_lose_no_square(spark):
    seats = {(f"P{a}{b}", o) for a, b in combinations("ABCDEF", 2) for o in (a, b)}
    got = [x.orgs for x in interlocks.closed_squares(projection_of(spark, seats), 4).orderBy("orgs").collect()]
    assert got == sorted(brute_squares(seats))[:4]
    assert interlocks.closed_squares(projection_of(spark, {("P", "A")}), 4).count() == 0


def test_open_loops_stay_in_their_task(spark):
    seats = {(f"P{p}", f"O{o}") for p in range(12) for o in range(p % 4, 9, 2)}
    t = interlocks.closed_triangles(projection_of(spark, seats))
    people = {}
    for p, o in seats:
        people.setdefault(o, set()).add(p)
    want = {}
    for a, b, c in combinations(sorted(people), 3):
        sides = [people[a] & people[b], people[b] & people[c], people[a] & people[c]]
        if all(sides) and len(set().union(*sides)) > 1:
            want[a, b, c] = len(set().union(*sides))
    assert {(x.a, x.b, x.c): x.people for x in t.collect()} == want and want
    first = interlocks.closed_triangles(projection_of(spark, seats), 3).collect()
    assert [((x.a, x.b, x.c), x.people) for x in sorted(first, key=lambda x: (-x.people, x.a, x.b, x.c))] == sorted(want.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert "collect_set" not in t._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
