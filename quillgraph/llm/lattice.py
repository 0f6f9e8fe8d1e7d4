"""Embedding near-duplicates by E8 lattice hashing.

Each table projects the unit vectors to eight random orthonormal directions, scales, shifts and decodes
them to the nearest point of the E8 lattice. A vector stands in its home cell and in the neighbouring
cells nearest to it (probing); two vectors meet where the home of one is the home or a probed cell of
the other. Everyone who meets is compared by cosine in double precision. A pair that meets several times
counts once, at its first common cell, which each side can tell from the cells both carry; so links are
counted inside the block and never written out as pairs, and a block returns one row per vector.

The scale grows with the eighth root of the number of distinct vectors (a cell's volume with its inverse), so that
what unrelated vectors a cell holds stays put; the number of probes and of tables is then set from the measured rate
at which two vectors right at the threshold meet, so that a vector has as few keys as will do.

Only keys and ids are shuffled to find the cells with two members or more; vectors are fetched for those alone. Equal
vectors are one class with a multiplicity; classes of many rows meet their rows by broadcast. Cells with many members
are dealt out as block pairs: m mutually near vectors in one cell are compared in (m / BLOCK)^2 / 2 blocks.

Odd input: vectors that are null, empty, all zero, or hold null or non-finite components link with nothing
(n_links 0, component_id their own id, kept true); vectors of unequal length never meet; each row counts
as a vector of its own; rows of one vec_id share its component, and its links if their vectors differ; a null
vec_id links with nothing, has a null component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import scramble
from quillgraph.operators.components import connected_components
from quillgraph.plans.staging import Staging

#: Cells of a table in which a vector stands: the home and its nearest neighbours.
PROBES = (2, 4, 8, 16)
#: Rows of an equal-vector class from which it is matched by broadcast, and how many classes may be.
HEAVY, BROADCAST_CLASSES = 10_000, 2_000_000
#: Members of a cell per block.
BLOCK = 4096
#: Cells with more members than a block: this many may be broadcast (16 bytes each).
BROADCAST_CELLS = 1_000_000


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: +-e_i +-e_j, and half-odd vectors with an even number of minuses."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with an even sum: if the rounded sum is odd, the least sure coordinate goes the other way."""
    near = np.rint(x)
    rest = x - near
    rows = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(rest[rows]).argmax(axis=1)
    near[rows, worst] += np.where(rest[rows, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the better of the two cosets, even integers and even integers plus one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


class Tables:
    """Cell keys of unit vectors of one length in all tables."""

    def __init__(self, dim: int, tables: int, scale: float, seed: int, probes: int = 2):
        rng = np.random.default_rng([seed, dim])
        self.maps = []
        for _ in range(tables):
            # With under eight components the projection is padded with zeros.
            q = np.linalg.qr(rng.normal(size=(dim, min(8, dim))))[0] * scale * math.sqrt(dim / 64)
            self.maps.append((np.pad(q, ((0, 0), (0, 8 - q.shape[1]))), rng.uniform(0, 2, 8)))
        self.mix = rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
        self.roots, self.dim, self.probes = roots(), dim, probes

    def _key(self, points: np.ndarray, table: int) -> np.ndarray:
        twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
        return scramble((twice * self.mix).sum(axis=1) + np.uint64(table * 65_537 + self.dim * 257 + 1)).view(np.int64)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables, probes) cell keys; the first of each table is the home."""
        out = np.empty((len(unit), len(self.maps), self.probes), np.int64)
        for t, (q, shift) in enumerate(self.maps):
            x = unit @ q + shift
            home = decode(x)
            out[:, t, 0] = self._key(home, t)
            if self.probes > 1:
                nearest = np.argsort(-((x - home) @ self.roots.T), axis=1)[:, : self.probes - 1]
                for p in range(self.probes - 1):
                    out[:, t, p + 1] = self._key(home + self.roots[nearest[:, p]], t)
        return out


def meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For key arrays (pairs, tables, probes): the tables in which each pair meets."""
    return (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)


def table_plan(threshold: float, n: int, miss: float = 1e-4, seed: int = 5) -> tuple[int, float, int]:
    """(tables, scale, probes): the scale from the number of vectors, the rest from measured meeting rates."""
    scale = 4.0 * max(1.0, n / 50_000) ** (1 / 8)
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(2000, 64))
    v = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(axis=1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    plans = []
    for probes in PROBES:
        some = Tables(64, 4, scale, seed, probes)
        rate = meets(some.keys(u), some.keys(threshold * u + math.sqrt(1 - threshold**2) * v)).mean()
        tables = math.ceil(math.log(miss) / math.log(1 - min(max(rate, 1e-3), 1 - 1e-9)))
        plans.append((tables * probes, tables, probes))
    _, tables, probes = min(plans)
    return tables, scale, probes


def _cells(tables: int, scale: float, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            flat = batch.column(2)
            lengths = np.array([len(x) for x in flat], np.int64) if len(flat) else np.zeros(0, np.int64)
            values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(lengths)
            keys = np.empty((len(lengths), tables * probes), np.int64)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                x = values[(ends[rows] - dim)[:, None] + np.arange(dim)]
                # Scaled by the largest component first, so that no square over- or underflows.
                x = x / np.abs(x).max(axis=1)[:, None]
                t = made.setdefault(int(dim), Tables(int(dim), tables, scale, seed, probes))
                keys[rows] = t.keys(x / np.linalg.norm(x, axis=1)[:, None]).reshape(len(rows), -1)
            nested = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables * probes), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), nested], ["id", "mult", "vec", "keys"])

    return run


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the pairs, for each of n members."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float, tables: int, probes: int):
    def block(key: int, own: int, ids, mult, part, unit, keys):
        """(ids, links, roots) of the members of one block that have links there."""
        order = np.argsort(ids, kind="stable")
        ids, mult, part, unit, keys = ids[order], mult[order], part[order], unit[order], keys[order]
        home = (keys[:, :, 0] == key).any(axis=1)
        left, right = [], []
        for at in range(0, len(ids), 1024):
            near = unit[at : at + 1024] @ unit.T >= threshold
            near &= home[at : at + 1024, None] | home[None, :]
            if own == 0:  # a pair of unequal parts: only across
                near &= part[at : at + 1024, None] != part[None, :]
            a, b = np.nonzero(near)
            a += at
            left.append(a[a < b]), right.append(b[a < b])
        a, b = np.concatenate(left), np.concatenate(right)
        if not len(a):
            return None
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(a), 50_000):  # counted at the first common cell only
            i, j = a[at : at + 50_000], b[at : at + 50_000]
            ki, kj = keys[i], keys[j]
            one = ki[:, :, :1] == kj
            two = kj[:, :, :1] == ki
            t = (one.any(axis=2) | two.any(axis=2)).argmax(axis=1)
            n = np.arange(len(i))
            big = np.iinfo(np.int64).max
            first = np.minimum(np.where(one[n, t].any(axis=1), ki[n, t, 0], big), np.where(two[n, t].any(axis=1), kj[n, t, 0], big))
            here = first == key
            np.add.at(links, i[here], mult[j[here]])
            np.add.at(links, j[here], mult[i[here]])
        root = _forest(a, b, len(ids))
        some = np.unique(np.concatenate([a, b]))
        return ids[some], links[some], ids[root[some]]

    def arrays(batch: pa.RecordBatch):
        flat = batch.column(6)
        lengths = np.diff(np.asarray(flat.offsets))
        return (
            *(batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)), lengths,
            np.split(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lengths)[:-1]) if len(lengths) else [],
            batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(lengths), tables, probes),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            key, i, j, part, ids, mult, lengths, vecs, keys = arrays(whole)
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            out = []
            for lo, hi in zip([0, *cut], [*cut, len(key)], strict=True):
                if hi - lo < 2:
                    continue
                x = np.stack(vecs[lo:hi]) if (lengths[lo:hi] == lengths[lo]).all() else None
                if x is None:
                    raise ValueError("vectors of unequal length share a cell key")
                x = x / np.abs(x).max(axis=1)[:, None]
                x /= np.linalg.norm(x, axis=1)[:, None]
                found = block(key[lo], int(i[lo] == j[lo]), ids[lo:hi], mult[lo:hi], part[lo:hi], x, keys[lo:hi])
                if found:
                    out.append(found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
            same = np.ones(batch.num_rows, bool)
            for c in range(3):
                same &= batch.column(c).to_numpy(zero_copy_only=False) == last[c]
            tail = int(same[::-1].argmin()) if not same.all() else batch.num_rows
            head = batch.num_rows - tail
            if head:
                yield from flush([*held, batch.slice(0, head)])
                held = []
            held.append(batch.slice(head))
            if head == 0 and len(held) > 1 and [held[0].column(c)[0].as_py() for c in range(3)] != last:
                yield from flush(held[:-1])
                held = held[-1:]
        if held:
            yield from flush(held)

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-4, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    st = Staging(spark, "lattice")
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    good = F.coalesce(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0), F.lit(False),
    )
    h = [F.when(good, F.xxhash64("embedding")).alias("h1"), F.when(good, F.xxhash64(F.lit(7), "embedding")).alias("h2")]
    keyed = rows.select("vec_id", "embedding", *h)
    classes = st.write(
        keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.min_by("embedding", "vec_id").alias("vec")), "classes"
    )
    tables, scale, probes = table_plan(threshold, classes.count(), miss)
    cells = st.write(classes.select("id", "mult", "vec").mapInArrow(_cells(tables, scale, probes, seed), f"id long, mult long, vec {dict(classes.dtypes)['vec']}, keys array<bigint>"), "cells")
    # Cells of two members or more, and of how many blocks.
    places = st.write(cells.select("id", F.explode(F.array_distinct("keys")).alias("key")), "places")
    shared = places.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    crowded = st.write(shared.where("parts > 1"), "crowded")
    crowded_ = F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded
    # What stands in a crowded cell joins it by broadcast, so that no task gets such a cell whole.
    few = places.join(crowded_, "key", "left_anti").join(shared.where("parts = 1"), "key")
    at = few.select("id", "key", "parts").unionByName(places.join(crowded_, "key").select("id", "key", "parts"))
    at = at.groupBy("id").agg(F.collect_list(F.struct("key", "parts")).alias("at"))  # at most tables * probes entries
    dealt = at.join(cells, "id").select("id", "mult", "vec", "keys", F.inline("at"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "mult", "vec", "keys")
    found = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(threshold, tables, probes), "id long, links long, root long")
    found = st.write(found, "found")
    st.drop(places)

    # Rows and their classes; a class's smallest vec_id stands for it, so components are those of the classes.
    ids = classes.select("h1", "h2", "id", "mult")
    heavy = st.write(ids.where(F.col("mult") >= HEAVY), "heavy")
    heavy_ = F.broadcast(heavy) if heavy.count() <= BROADCAST_CLASSES else heavy
    good_rows = keyed.where("h1 is not null").select("vec_id", "h1", "h2")
    many = good_rows.join(heavy_, ["h1", "h2"]).select("vec_id", "id", "mult")
    rest = good_rows.join(heavy_, ["h1", "h2"], "left_anti").join(ids.where(F.col("mult") < HEAVY), ["h1", "h2"]).select("vec_id", "id", "mult")
    own = st.write(many.unionByName(rest), "own")
    # Rows that share a vec_id are one node, so their classes are linked.
    twice = own.groupBy("vec_id").agg(F.min("id").alias("lo"), F.collect_set("id").alias("all")).where(F.size("all") > 1)
    edges = found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst")).union(twice.select("lo", F.explode("all")))
    comp = connected_components(edges, st)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    state = st.write(links.join(comp, links["id"] == comp["node"], "full").select(F.coalesce("id", "node").alias("id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component")), "state")
    of_heavy = state.join(heavy_.select("id"), "id", "left_semi")
    of_heavy = F.broadcast(of_heavy) if heavy.count() <= BROADCAST_CLASSES else of_heavy
    known = own.where(F.col("mult") >= HEAVY).join(of_heavy, "id", "left").unionByName(own.where(F.col("mult") < HEAVY).join(state, "id", "left"))
    good_out = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    bad = keyed.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    # A bad row whose vec_id stands on good rows too belongs to their component.
    twins = own.join(bad.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "id").join(state, "id", "left").groupBy("vec_id").agg(F.min(F.coalesce("component", "id")).alias("component_id"))
    bad_out = bad.join(twins, "vec_id", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    out = good_out.unionByName(bad_out)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
