"""Seats (person, organisation) as a projection, and their loops of four by brute force."""

from itertools import combinations


def projection_of(spark, seats):
    held = {}
    for p, o in seats:
        held.setdefault(p, set()).add(o)
    rows = [(a, b, p) for p, orgs in held.items() for a, b in combinations(sorted(orgs), 2)]
    return spark.createDataFrame(rows, "a string, b string, person string")


def brute_squares(seats):
    held = {}
    for p, o in seats:
        held.setdefault(o, set()).add(p)
    out = {}
    for four in combinations(sorted(held), 4):
        a, b, c, d = four
        for ring in ((a, b, c, d), (a, b, d, c), (a, c, b, d)):
            sides = [held[ring[i]] & held[ring[(i + 1) % 4]] for i in range(4)]
            if all(sides) and len(set().union(*sides)) > 1:
                key = ",".join(four)
                out[key] = max(out.get(key, 0), len(set().union(*sides)))
    return out
