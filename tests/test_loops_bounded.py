"""The strongest loops of four without making all, whatever the ties are."""

import random

import pytest
from helpers_loops import brute_squares, projection_of

from quillgraph.operators import loops
from quillgraph.plans.staging import Staging


def staged_rows(monkeypatch):
    made, write = [], Staging.write

    def spy(self, df, name="t"):
        out = write(self, df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(Staging, "write", spy)
    return made


def test_weak_squares_are_not_made_for_a_few_strong_ones(spark, monkeypatch):
    # Ten organisations tied once each way round, and two squares of stronger ties: below them, all ties are equal.
    seats = {(f"W{a}{b}", f"O{x}") for a in range(10) for b in range(a) for x in (a, b)}
    seats |= {(f"S{r}{i}{n}", f"T{r}{x}") for r in range(2) for i in range(4) for n in range(3) for x in (i, (i + 1) % 4)}
    monkeypatch.setattr(loops, "FIRST_OPEN", 1)
    made = staged_rows(monkeypatch)
    got = [tuple(r) for r in loops.closed_squares(projection_of(spark, seats), 2).collect()]
    assert got == [("T00,T01,T02,T03", 12), ("T10,T11,T12,T13", 12)]
    assert max(n for name, n in made if name in ("open", "loops")) <= 16 < len(brute_squares(seats)) == 212


@pytest.mark.parametrize("most", [4, 30])
def test_equal_squares_are_taken_by_name(spark, monkeypatch, most):
    # No strength tells these apart: they are made by names, a few at a time, with nothing lost.
    r = random.Random(most)
    seats = {(f"P{a}{b}", f"O{x}") for a in range(11) for b in range(a) if r.random() < 0.8 for x in (a, b)}
    seats |= {("Q", f"O{x}") for x in (2, 3, 5, 7)}
    monkeypatch.setattr(loops, "MOST_OPEN", 3)
    monkeypatch.setattr(loops, "FIRST_RUN", 1)
    made = staged_rows(monkeypatch)
    want = sorted(brute_squares(seats).items(), key=lambda x: (-x[1], x[0]))
    got = [(x.orgs, x.people) for x in loops.closed_squares(projection_of(spark, seats), most).collect()]
    assert len(want) > most and got == want[:most]
    assert any(name == "names" for name, _ in made)


def test_search_ends_with_all_squares(spark, monkeypatch):
    seats = {(f"P{a}{b}", f"O{x}") for a in range(5) for b in range(a) for x in (a, b)} | {("Z", f"U{x}") for x in range(4)}
    monkeypatch.setattr(loops, "MOST_OPEN", 3)
    got = {x.orgs: x.people for x in loops.closed_squares(projection_of(spark, seats), 50).collect()}
    assert got == brute_squares(seats) and got
