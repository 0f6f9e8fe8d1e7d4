"""Loops of three from triples of blocks: bounded arrays in a task, no hash tables of ties."""

import random
from collections import defaultdict
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from helpers_loops import projection_of

from quillgraph.operators import corners, loops


def brute_triangles(seats):
    held, out = defaultdict(set), {}
    for p, o in seats:
        held[o].add(p)
    for a, b, c in combinations(sorted(held), 3):
        sides = [held[a] & held[b], held[b] & held[c], held[a] & held[c]]
        if all(sides) and len(set().union(*sides)) > 1:
            out[a, b, c] = len(set().union(*sides))
    return out


def some_seats(seed, people=30, orgs=13, n=90):
    r = random.Random(seed)
    return {(f"P{r.randrange(people)}", f"Ö{r.randrange(orgs)}") for _ in range(n)}


def test_triangles_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(loops, "BLOCK_TIES", 4)
    seats = some_seats(1)
    t = loops.closed_triangles(projection_of(spark, seats))
    assert {(x.a, x.b, x.c): x.people for x in t.collect()} == brute_triangles(seats)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "SortMergeJoin" not in plan


def test_kernel_in_small_steps(monkeypatch):
    monkeypatch.setattr(corners, "PACKED", 5)
    monkeypatch.setattr(corners, "OPEN", 2)
    seats, blocks = some_seats(2), 3
    held = defaultdict(set)
    for p, o in seats:
        held[p].add(o)
    near = {b: sorted(o for o in {o for _, o in seats} if hash_of(o) % blocks == b) for b in range(blocks)}
    code = {o: (b << 32) + i for b, names in near.items() for i, o in enumerate(names)}
    ties = defaultdict(int)
    for orgs in held.values():
        for x, y in combinations(sorted(code[o] for o in orgs), 2):
            ties[x, y] += 1
    x, y = np.array(list(ties)).T
    tie = pa.record_batch([pa.array(x), pa.array(y), pa.array(list(ties.values()))], ["x", "y", "n"])
    orgs = pa.record_batch([pa.array([[]] + [sorted(code[o] for o in v) for v in held.values()], pa.list_(pa.int64()))[1:]], ["orgs"])
    name = pa.record_batch([pa.array([b for b in near for _ in near[b]], pa.int32()), pa.array([i for b in near for i in range(len(near[b]))]), pa.array([o for b in near for o in near[b]])], ["block", "near", "id"])
    packed = [*corners.pack_ties(iter([tie.slice(0, 7), tie.slice(7)])), *corners.pack_corners(iter([orgs])), *corners.pack_names(iter([name.slice(0, 4), name.slice(4)]))]
    got = {}
    for part, of in enumerate(sorted(combinations_with_replacement(range(blocks), 3), key=lambda t: t[::-1])):
        assert corners.triple(part) == of
        here = [r for r in packed if goes_to(r, of)]
        rows = [pa.record_batch([pa.array([part], pa.int32()), *r.columns], ["part", *r.schema.names]) for r in here]
        for batch in corners.close(iter(rows)):
            got |= {(r["a"], r["b"], r["c"]): r["people"] for r in batch.to_pylist()}
    assert got == brute_triangles(seats) and len(got) > 30


def hash_of(o):
    return sum(map(ord, o)) * 7 // 3


def goes_to(row, of):
    kind, i, j, k = (row.column(c)[0].as_py() for c in range(4))
    if kind == "corners":
        return (i, j, k) == of
    left = list(of)
    for b in (i, j) if kind == "ties" else (i,):
        if b not in left:
            return False
        left.remove(b)
    return True
