"""The report makes only the loops of three that can be in it."""

import random

import pytest
from helpers_loops import projection_of
from test_loops_bounded import staged_rows
from test_loops_in_blocks import brute_triangles

from quillgraph.operators import loops


def test_weak_triangles_are_not_made_for_a_report(spark, monkeypatch):
    seats = {(f"W{a}{b}", f"O{x}") for a in range(10) for b in range(a) for x in (a, b)}
    seats |= {(f"S{r}{i}{n}", f"T{r}{x}") for r in range(2) for i in range(3) for n in range(3) for x in (i, (i + 1) % 3)}
    monkeypatch.setattr(loops, "FIRST_OPEN", 1)
    made = staged_rows(monkeypatch)
    got = [tuple(r) for r in loops.loop_report(projection_of(spark, seats), 2).collect()]
    assert got == [("T00,T01,T02", 3, 9), ("T10,T11,T12", 3, 9)]
    assert max(n for name, n in made if name in ("open", "loops")) <= 12 < len(brute_triangles(seats)) == 122


@pytest.mark.parametrize("most_open", [3, 10**6])
def test_report_is_the_first_of_all(spark, monkeypatch, most_open):
    r = random.Random(4)
    seats = {(f"P{a}{b}", f"O{x}") for a in range(12) for b in range(a) if r.random() < 0.7 for x in (a, b)}
    seats |= {("Q", f"O{x}") for x in (1, 10, 11)}
    monkeypatch.setattr(loops, "MOST_OPEN", most_open)
    monkeypatch.setattr(loops, "FIRST_RUN", 20)
    want = sorted(((",".join(k), 3, n) for k, n in brute_triangles(seats).items()), key=lambda x: (-x[2], x[0]))
    assert len(want) > 20 and [tuple(x) for x in loops.loop_report(projection_of(spark, seats), 20).collect()] == want[:20]
