"""MinHash near-duplicates: universal hash minima, banding, verification, star components.

The plan, with only ids and hashes moving through shuffles until pairs are to be confirmed:

1. One pass over the texts gives each document its set size, a 128-bit key of its shingle set, band
   keys and an 8-bit signature. Documents with equal sets form a class; its smallest id stands for it.
2. Each band bucket links its members to its smallest id (a star, never all pairs). Stars whose
   signatures agree enough are confirmed on the full shingle sets; confirmed links give components.
3. A bucket of three or more may still hold several components. Inside it, the documents outside its largest
   component are held against all, first by signature, then, those that have a likely partner of another component,
   on the full sets; both in blocks of bounded size, each pair only in the first bucket it shares. A block returns
   at most one link per document and component, so a group's pairs are never written out.
4. Components by alternating large-star and small-star, then back to every document of each class.

Handling of odd input (all cases give a row per input row): null or blank text has an empty set and
links with nothing; a text with fewer than k words is one shingle; rows sharing a doc_id are one node;
a null doc_id is linked with nothing, has a null component and is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.words import WordHashes, runs, scramble, shingle_set, slices, texts
from quillgraph.operators.components import connected_components
from quillgraph.plans.staging import Staging

#: Ids up to this many (8 bytes each) may be broadcast; beyond it they join by shuffle.
BROADCAST_IDS = 4_000_000
#: Documents of a bucket that a block holds, and those outside its largest component; shingles of either.
BLOCK_MEMBERS, BLOCK_STRAYS, BLOCK_SHINGLES = 2048, 512, 1_000_000


def band_plan(threshold: float, miss: float = 1e-5) -> tuple[int, int]:
    """(bands, rows): a pair right at the threshold shares no band with probability ``miss``."""
    rows = 8 if threshold >= 0.85 else 6 if threshold >= 0.75 else 4
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def _signer(k: int, bands: int, rows: int, seed: int):
    n = bands * rows
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1))[:, None]
    b = rng.integers(0, 2**32, n, dtype=np.uint32)[:, None]
    mix = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def minima(shingles: np.ndarray) -> np.ndarray:
        x, least = (shingles >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(x), 2048):
            part = (a * x[None, i : i + 2048] + b).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        return least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            size, key, keys, sigs = [], [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text, k, hashes)
                size.append(len(s))
                if not len(s):
                    key.append(None), keys.append(None), sigs.append(None)
                    continue
                m = minima(s)
                key.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(scramble((m.reshape(bands, rows).astype(np.uint64) * mix).sum(axis=1)).view(np.int64))
                sigs.append((scramble(m.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "sig"],
            )

    return run


def signatures(docs: DataFrame, k: int, bands: int, rows: int, seed: int = 11) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _signer(k, bands, rows, seed), "doc_id long, n_shingles long, set_key binary, bands array<bigint>, sig binary"
    )


def _set_emitter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(t, k, hashes).tobytes() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _bounded(ids: DataFrame, n: int) -> DataFrame:
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int, k: int) -> DataFrame:
    """(id, shingles as sorted 64-bit hashes) of the documents in ``ids``."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(_bounded(ids.select("id"), n_ids), "id", "left_semi")
    return wanted.mapInArrow(_set_emitter(k), "id long, shingles binary").dropDuplicates(["id", "shingles"])


def _overlap(a: bytes, b: bytes) -> tuple[int, int]:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, union = _overlap(a, b)
                ok.append(den * both >= num * union and union > 0)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _similar_signatures(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = [(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def _likely(least: float):
    """(band, bucket, id) of the documents with a likely partner of another component, by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in runs(batches, 4):
            band, bucket, ids, labels, lead, stray = (table[c].to_numpy() for c in ("band", "bucket", "id", "label", "lead", "stray"))
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
            keys = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            wanted = np.zeros(len(ids), bool)
            for lo, hi in zip(starts, ends, strict=True):
                members = lo + np.flatnonzero(~stray[lo:hi])
                for i in (lo + np.flatnonzero(stray[lo:hi])).tolist():
                    # Pairs with the bucket's lead are known from the stars.
                    if ids[i] == lead[i]:
                        continue
                    at = members[(labels[members] != labels[i]) & (ids[members] != lead[i])]
                    if len(at):
                        hit = (sigs[at] == sigs[i]).mean(axis=1) >= least
                        hit &= (keys[at] == keys[i]).argmax(axis=1) == band[i]
                        wanted[at[hit]] = True
                        wanted[i] |= hit.any()
            some = np.flatnonzero(wanted)
            yield pa.RecordBatch.from_arrays([pa.array(band[some], pa.int32()), pa.array(bucket[some], pa.int64()), pa.array(ids[some], pa.int64())], ["band", "bucket", "id"])

    return run


def _links_of(labels: np.ndarray, stray: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[list, list]:
    """Links of one block's strays with its members of other components, one per stray and component, as pairs of labels."""
    src, dst = [], []
    members, strays = np.flatnonzero(~stray), np.flatnonzero(stray)
    if len(members) and len(strays):
        size = np.array([len(s) for s in sets])
        every, codes = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size[members])[:-1]])
        for i in strays:
            at = np.minimum(np.searchsorted(every, sets[i]), len(every) - 1)
            mark = np.zeros(len(every), np.int32)
            mark[at[every[at] == sets[i]]] = 1
            both = np.add.reduceat(mark[codes], starts)
            hit = members[(den * both >= num * (size[i] + size[members] - both)) & (labels[members] != labels[i])]
            others = np.unique(labels[hit]).tolist()
            src += [labels[i]] * len(others)
            dst += others
    return src, dst


def _block_links(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts, ends in runs(batches, 4):
            labels, stray = (table[c].to_numpy() for c in ("label", "stray"))
            held = table["shingles"]
            src, dst = [], []
            for lo, hi in zip(starts, ends, strict=True):
                if hi - lo > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in held.slice(lo, hi - lo).to_pylist()]
                    a, b = _links_of(labels[lo:hi], stray[lo:hi], sets, num, den)
                    src += a
                    dst += b
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, seed: int = 11) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs`` (doc_id, text).

    Documents are linked when den * |A & B| >= num * |A | B| over distinct k-word shingles.
    """
    spark = docs.sparkSession
    st = Staging(spark, "minhash")
    bands, rows = band_plan(num / den)
    signed = st.write(signatures(docs, k, bands, rows, seed), "signed")
    live = signed.where("doc_id is not null and set_key is not null")

    # 1. classes of equal sets; the smallest id stands for each.
    classes = live.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    rep_of = st.write(live.select("doc_id", "set_key").join(classes, "set_key").select(F.col("doc_id").alias("id"), "rep"), "classes")
    reps = live.join(rep_of.where("id = rep").select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")

    # 2. buckets of two or more, and the star of each.
    slots = reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "bucket"))
    firsts = slots.groupBy("band", "bucket").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last")
    members = st.write(slots.join(firsts.drop("last"), ["band", "bucket"]), "members")
    stars = members.where("id <> lead").select(F.col("lead").alias("src"), F.col("id").alias("dst")).distinct()
    t = num / den
    floor = max(0.0, t - 5 * math.sqrt(t * (1 - t) / (bands * rows)))
    sig = reps.select("doc_id", "sig", "bands").dropDuplicates(["doc_id", "sig"])
    pairs = stars.join(sig.select(F.col("doc_id").alias("dst"), F.col("sig").alias("b")), "dst").join(sig.select(F.col("doc_id").alias("src"), F.col("sig").alias("a")), "src")
    pairs = st.write(pairs.select("src", "dst", "a", "b").mapInArrow(_similar_signatures(floor), "src long, dst long"), "pairs")
    ids = st.write(pairs.select(F.col("src").alias("id")).union(pairs.select(F.col("dst").alias("id"))).distinct(), "ids")
    sets = st.write(shingle_sets(docs, ids, ids.count(), k), "sets")
    held = pairs.join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst").join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src")
    links = st.write(held.select("src", "dst", "a", "b").mapInArrow(_confirm(num, den), "src long, dst long"), "links")
    st.drop(sets)
    # Equal ids with unequal texts are one node, so classes of equal sets are links as well.
    same = rep_of.where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    comp = st.write(connected_components(links.union(same), st), "comp")

    # 3. buckets that still hold several components, and pairs without their lead.
    labelled = members.join(comp, members.id == comp.node, "left").select("band", "bucket", "id", "lead", F.coalesce("component", "id").alias("label"))
    open_ = st.write(_open(labelled), "open")
    out = signed.select("doc_id", "n_shingles").join(comp, signed.doc_id == comp.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("label"))
    if not open_.isEmpty():
        # What is found now links components, so only these are joined anew.
        moved = connected_components(_across(docs, st, open_, live, sig, k, num, den, floor), st)
        moved = st.write(moved.select(F.col("node").alias("old"), F.col("component").alias("new")).where("old <> new"), "moved")
        out = out.join(_bounded(moved, 2 * moved.count()), F.col("label") == F.col("old"), "left").select("doc_id", "n_shingles", F.coalesce("new", "label").alias("label"))
    return out.select("doc_id", "n_shingles", F.col("label").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("label"), F.lit(True)).alias("kept"))


def _open(labelled: DataFrame) -> DataFrame:
    """The members, without the lead, of buckets that hold several components besides the lead: its pairs are known from the stars."""
    rest = labelled.where("id <> lead")
    mixed = rest.groupBy("band", "bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band", "bucket")
    return rest.join(mixed, ["band", "bucket"]).distinct()


def _blocks(rows: DataFrame, size: str | None) -> DataFrame:
    """(band, bucket, cut, part, stray, columns of ``rows``): each bucket's members, and those outside its largest
    component, dealt out so that each of these meets each of those in one block."""
    own = ["band", "bucket"]
    of = rows.groupBy(*own, "label").agg(F.count(F.lit(1)).alias("c"), (F.sum(size) if size else F.lit(0)).alias("n"))
    plan = of.groupBy(*own).agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.max(F.struct("c", "label", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    parts = lambda c, n, most: F.greatest(F.lit(1), F.ceil(c / most), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    plan = plan.select(*own, "main", parts(F.col("c"), F.col("n"), BLOCK_MEMBERS).alias("parts"), parts(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n"), BLOCK_STRAYS).alias("cuts"))
    full = rows.join(plan, own)
    slot = F.xxhash64("id", "bucket")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = [c for c in rows.columns if c not in own]
    members = full.select(*own, every("cuts").alias("cut"), F.pmod(slot, F.col("parts")).cast("int").alias("part"), F.lit(False).alias("stray"), *rest)
    strays = full.where("label <> main").select(*own, F.pmod(slot, F.col("cuts")).cast("int").alias("cut"), every("parts").alias("part"), F.lit(True).alias("stray"), *rest)
    return members.unionByName(strays)


def _once_an_id(rows: DataFrame, of: DataFrame) -> DataFrame:
    """``rows`` joined with what ``of`` has of their id: one row an id goes through the join, its places (at most one a
    band and block) are dealt out again behind it."""
    own = [c for c in rows.columns if c != "id"]
    places = rows.groupBy("id").agg(F.collect_list(F.struct(*own)).alias("places"))
    return places.join(of, "id").select("id", *[c for c in of.columns if c != "id"], F.inline("places"))


def _across(docs: DataFrame, st: Staging, open_: DataFrame, live: DataFrame, sig: DataFrame, k: int, num: int, den: int, floor: float) -> DataFrame:
    """Links between components inside the buckets ``open_``, by their labels."""
    signed = _once_an_id(open_, sig.withColumnRenamed("doc_id", "id")).select("band", "bucket", "id", "label", "lead", "sig", "bands")
    keys = ["band", "bucket", "cut", "part"]
    dealt = _blocks(signed, None).select(*keys, "stray", "id", "label", "lead", "sig", "bands").repartition(*keys).sortWithinPartitions(*keys)
    likely = dealt.mapInArrow(_likely(floor), "band int, bucket long, id long")
    likely = st.write(likely.distinct(), "likely")
    sizes = live.groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n"))
    wanted = st.write(_once_an_id(open_.drop("lead").join(likely, ["band", "bucket", "id"]), sizes), "wanted")
    ids = wanted.select("id").distinct()
    dealt = _once_an_id(_blocks(wanted, "n"), shingle_sets(docs, ids, ids.count(), k))
    dealt = dealt.select(*keys, "stray", "id", "label", "shingles").repartition(*keys).sortWithinPartitions(*keys)
    return st.write(dealt.mapInArrow(_block_links(num, den), "src long, dst long"), "across")
