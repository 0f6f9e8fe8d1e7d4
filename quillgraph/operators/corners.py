"""Loops of three closed inside triples of blocks of organisations, as arrays.

Organisations are dealt into blocks and numbered there by name. A tie goes to all triples of blocks that hold both its ends,
once each, as arrays and not as a row; open loops live for a moment in one task. All rows have the columns of ``ROW``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows packed together, and open loops looked up, at a time.
PACKED, OPEN = 500_000, 500_000
#: kind: ties of blocks i <= j (ends one, two; people in value), corners of one person in blocks i <= j <= k (one, two, value),
#: or names of block i (offsets in one, text in two).
ROW = "kind string, i int, j int, k int, one binary, two binary, value binary"
LOOPS = "a string, b string, c string, people long"
_NAMES = ["kind", "i", "j", "k", "one", "two", "value"]


def _row(kind: str, i: int, j: int, k: int, one, two, value=b"") -> pa.RecordBatch:
    cells = [pa.array([bytes(x)], pa.binary()) for x in (one, two, value)]
    return pa.RecordBatch.from_arrays([pa.array([kind]), *(pa.array([x], pa.int32()) for x in (i, j, k)), *cells], _NAMES)


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int32)


def _grouped(keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Values by equal keys, sorted by the values in turn."""
    order = np.lexsort([*reversed(values), *reversed(keys)])
    keys, values = [x[order] for x in keys], [x[order].astype(np.int32) for x in values]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    for lo, hi in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        yield tuple(int(x[lo]) for x in keys), [x[lo:hi] for x in values]


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def pack_ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ties from (x, y, n): ends as block * 2 ** 32 + number, the smaller first."""
    for table in _some(batches):
        x, y, n = (table[c].to_numpy() for c in ("x", "y", "n"))
        for (i, j), (one, two, people) in _grouped([x >> 32, y >> 32], [x & 0xFFFFFFFF, y & 0xFFFFFFFF, n]):
            yield _row("ties", i, j, -1, one, two, people)


def _corners(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """All corners of each person, three columns, at most ``PACKED`` rows or the corners of one pair of ends at a time."""
    for batch in batches:
        lists = batch.column(0)
        flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        size = np.diff(offsets)
        for m in np.unique(size[size > 2]).tolist():
            step = max(1, PACKED // comb(m, 3))
            of = offsets[:-1][size == m]
            for lo in range(0, len(of), step):
                orgs = flat[of[lo : lo + step, None] + np.arange(m)]
                for first in range(m - 2):
                    two, three = np.triu_indices(m - first - 1, 1)
                    for at in range(0, len(two), PACKED):
                        x, y = (orgs[:, first + 1 + v[at : at + PACKED]].reshape(-1) for v in (two, three))
                        yield np.stack([np.repeat(orgs[:, first], len(x) // len(orgs)), x, y])


def pack_corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all corners from (orgs), a person's organisations in ascending order."""
    held, n, found = [], 0, _corners(batches)
    while True:
        some = next(found, None)
        if some is not None:
            held.append(some)
            n += some.shape[1]
        if n >= PACKED or (some is None and n):
            corners = np.concatenate(held, axis=1)
            for blocks, ends in _grouped(list(corners >> 32), list(corners & 0xFFFFFFFF)):
                yield _row("corners", *blocks, *ends)
            held, n = [], 0
        if some is None:
            return


def pack_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of names from each run of (block, id), dealt by block and sorted by block and number."""
    for table in _some(batches):
        block, ids = table["block"].to_numpy(), table["id"].combine_chunks().cast(pa.string())
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(block)], strict=True):
            text = [x.encode() for x in ids[lo:hi].to_pylist()]
            yield _row("names", int(block[lo]), int(table["near"][lo].as_py()), -1, np.cumsum([0, *map(len, text)]).astype(np.int32), b"".join(text))


def triple(index: int) -> tuple[int, int, int]:
    """Blocks i <= j <= k of the triple that has this number among all."""
    k = next(x for x in range(index + 2) if comb(x + 3, 3) > index)
    index -= comb(k + 2, 3)
    j = next(x for x in range(index + 2) if comb(x + 2, 2) > index)
    return index - comb(j + 1, 2), j, k


def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loops (a, b, c, people) of two people or more from the rows (part, ...) of a triple of blocks."""
    held = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        for part, kind, i, j, k, one, two, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[part][kind, i, -1 if kind == "names" else j, k].append((j, one, two, value))
    for part in list(held):
        yield from _closed(triple(part), held.pop(part))


def _ends(rows: list) -> list[np.ndarray]:
    return [np.concatenate([_ints(r[c]) for r in rows] or [np.zeros(0, np.int32)]).astype(np.int64) for c in (1, 2, 3)]


def _closed(blocks: tuple[int, int, int], held: dict) -> Iterator[pa.RecordBatch]:
    bi, bj, bk = blocks
    if not all(("ties", *b, -1) in held for b in ((bi, bj), (bj, bk), (bi, bk))):
        return
    names, first = [], {}
    for b in sorted(set(blocks)):
        first[b] = sum(map(len, names))
        for _, offsets, text, _ in sorted(held["names", b, -1, -1]):
            names.append(pa.StringArray.from_buffers(len(offsets) // 4 - 1, pa.py_buffer(offsets), pa.py_buffer(text)))
    names = pa.concat_arrays(names)
    order = pc.sort_indices(names)
    ranked, rank = names.take(order), np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))

    size = len(names)
    i, j, n1 = _ends(held["ties", bi, bj, -1])
    at = np.lexsort((j, i))
    i, j, n1 = i[at], j[at], n1[at]
    j2, k2, n2 = _ends(held["ties", bj, bk, -1])
    at = np.lexsort((k2, j2))
    j2, k2, n2 = j2[at], k2[at], n2[at]
    i3, k3, n3 = _ends(held["ties", bi, bk, -1])
    ends = i3 * size + k3
    at = np.argsort(ends)
    ends, n3 = ends[at], n3[at]
    begin = np.searchsorted(j2, j, "left")
    ways = np.searchsorted(j2, j, "right") - begin
    upto = np.cumsum(ways)
    # Corners of one person, named by their first tie's number and their last end.
    ci, cj, ck = _ends(held.get(("corners", *blocks), []))
    sides, same = np.unique(np.searchsorted(i * size + j, ci * size + cj) * size + ck, return_counts=True)
    lo = 0
    while lo < len(i):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + OPEN, "right")))
        w = ways[lo:hi]
        to = np.arange(w.sum()) + np.repeat(begin[lo:hi] - (upto[lo:hi] - w - done), w)
        tie, k = np.repeat(np.arange(lo, hi), w), k2[to]
        end = i[tie] * size + k
        third = np.minimum(np.searchsorted(ends, end), len(ends) - 1)
        hit = np.flatnonzero(ends[third] == end)
        tie, k, to, third = tie[hit], k[hit], to[hit], third[hit]
        people = n1[tie] + n2[to] + n3[third]
        x, y = np.searchsorted(sides, [lo * size, hi * size])
        if x < y and len(hit):
            here = tie * size + k
            found = np.minimum(np.searchsorted(here, sides[x:y]), len(here) - 1)
            met = here[found] == sides[x:y]
            people[found[met]] -= 2 * same[x:y][met]
        keep = people >= 2
        a, b, c = rank[first[bi] + i[tie[keep]]], rank[first[bj] + j[tie[keep]]], rank[first[bk] + k[keep]]
        least, most = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
        columns = [ranked.take(pa.array(v)) for v in (least, a + b + c - least - most, most)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(people[keep])], ["a", "b", "c", "people"])
        lo = hi
