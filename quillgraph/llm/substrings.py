"""Removal of passages that repeat across documents, by a compacted de Bruijn graph over words.

A window is ``WINDOW`` consecutive words of one document, an edge of the graph between its first and last
``WINDOW - 1`` words. Each word that lies in a window whose words also start in a document with a smaller doc_id is removed.
Windows are judged on the input, so the smallest document keeps the passage.

Only what can repeat is looked at, and paths, not edges, move:

1. Consecutive windows that share the smallest hash among their ``GRAM``-word grams (their key) are one segment, a path of up
   to ``WINDOW - GRAM + 1`` edges. Keys found in two documents or more are joined back to the segments (``hits``).
2. The segments under such keys are hashed whole. Of each distinct one the first document, the place there (its source
   coordinates) and the smallest and largest neighbours on both sides are aggregated.
3. Segments compact into paths: one is joined to the next if they stand next to each other at their source coordinates,
   and the first has no other successor, the second no other predecessor. Every document that has a segment of
   such a path then goes along it, so its occurrences group into spans by path and diagonal.
4. Segments whose key has several forms (an edit or the end of a passage within a segment) are taken apart into edges, which
   are joined one by one; runs of them on one diagonal are spans as well.
5. Each span is verified at its source: rolling sums of the words' hashes at both its ends, taken from the source text,
   are compared with those of the document's own words. A span that differs is not removed.

A key or segment that a third of the documents share is reduced before the shuffle, and joins meet it against one row, so
that Spark can split it. A task holds one text's word hashes at a time; words are split from pieces of a text.

Odd input: a null text has no words; texts under ``WINDOW`` words have no window; a null doc_id is neither smaller nor
larger than any, so its row keeps all words and removes none elsewhere; rows sharing a doc_id are judged each on its own text
against smaller ids only, so they do not remove each other; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.columns import at
from quillgraph.llm.words import rolling, scramble, slices, texts
from quillgraph.plans.staging import Staging

WINDOW, GRAM = 13, 5
#: Documents (16 bytes each) of which a list may be broadcast; longer lists join by shuffle.
BROADCAST_DOCS = 2_000_000
#: Bytes of text taken apart at a time; a longer word is taken whole.
PIECE = 1 << 18
SPACES = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")
SPACE = re.compile(rb"[\x09-\x0d\x20]")
#: Odd multiplier of the rolling sums, and what keeps them apart from the hashes of segments.
BASE, APART = np.uint64(0xD1342543DE82EF95), np.uint64(0xA5A5F00DC0FFEE11)

with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, BASE)]), dtype=np.uint64)
    INVERSES = np.cumprod(np.concatenate([[np.uint64(1)], np.full(PIECE, np.uint64(pow(int(BASE), -1, 2**64)))]), dtype=np.uint64)
#: Whether a byte is part of a word, and a fixed random value of each.
LETTER = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
BYTES = np.random.default_rng(13).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

HIT = "doc_id long, t long, start int, n int, key long, form long, next long, prev long"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces cut at white space, of at most PIECE bytes unless they are one longer word."""
    lo = 0
    while len(text) - lo > PIECE:
        cut = max(text.rfind(c, lo, lo + PIECE + 1) for c in SPACES)
        if cut < 0:
            found = SPACE.search(text, lo + PIECE)
            cut = found.start() if found else len(text)
        yield text[lo:cut]
        lo = cut + 1
    yield text[lo:]


def _hashed(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's words: sums of a value for each byte times BASE to its place in the word, mixed."""
    parts = []
    for piece in _pieces(text):
        if len(piece) > PIECE:
            parts.append(np.array([xxhash.xxh3_64_intdigest(piece)], np.uint64))
            continue
        raw = np.frombuffer(piece, np.uint8)
        edge = np.flatnonzero(np.diff(LETTER[raw], prepend=False, append=False))
        if len(edge):
            lo, hi = edge[::2], edge[1::2]
            with np.errstate(over="ignore"):
                sums = np.zeros(len(raw) + 1, np.uint64)
                np.cumsum(BYTES[raw] * POWERS[: len(raw)], out=sums[1:])
                parts.append(scramble((sums[hi] - sums[lo]) * INVERSES[lo] + (hi - lo).astype(np.uint64)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _segments(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key) of each segment of a text."""
    if len(h) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = rolling(h, gram)
    n = len(h) - window + 1
    # The low bits hold the place in the window, so that the first of equal grams counts.
    bits = np.uint64((window - gram).bit_length())
    slot = (grams >> bits) << bits
    least = slot[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(least, slot[j : j + n] | np.uint64(j), out=least)
    place = np.arange(n) + (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    return starts, np.diff(np.append(starts, n)), grams[place[starts]]


def _forms(h: np.ndarray, starts: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Hash of each segment's words: of its first and last window, which hold all of them."""
    edges = rolling(h, window)
    with np.errstate(over="ignore"):
        return scramble(edges[starts] * BASE + scramble(edges[starts + n - 1]) + n.astype(np.uint64))


def _sums(h: np.ndarray) -> np.ndarray:
    """Rolling sums before each word and after the last: of each word's hash times BASE to its place."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(h), BASE)]), dtype=np.uint64)
        return np.concatenate([[np.uint64(0)], np.cumsum(scramble(h ^ APART) * powers[:-1], dtype=np.uint64)])


def _key_lists(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [_segments(_hashed(x), window, gram)[2].view(np.int64) for x in texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "keys"])

    return run


def _hit_segments(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows, out = [], []
            for text, wanted in zip(texts(batch.column(2)), batch.column(3), strict=True):
                at_ = wanted.values.to_numpy(zero_copy_only=False)
                h = _hashed(text)
                starts, n, keys = _segments(h, window, gram)
                forms = np.zeros(len(starts) + 2, np.int64)  # a text's ends have no neighbour
                forms[1:-1] = _forms(h, starts, n, window).view(np.int64)
                rows.append(len(at_))
                out.append(np.stack([starts[at_], n[at_], keys.view(np.int64)[at_], forms[at_ + 1], forms[at_ + 2], forms[at_]]))
            start, n, key, form, after, before = np.concatenate(out, axis=1)
            row = np.repeat(np.arange(len(rows)), rows)
            side = lambda x: pa.array(x, pa.int64(), mask=x == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(form), side(after), side(before)],
                ["doc_id", "t", "start", "n", "key", "form", "next", "prev"],
            )

    return run


def _edges(window: int):
    """(doc_id, t, place, j, key, form, edge) of each window, the j-th of its segment, of the segments asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows, out = [], []
            for text, wanted in zip(texts(batch.column(2)), batch.column(3), strict=True):
                start, n, key, form = (wanted.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(start, n) + j
                rows.append(len(j))
                out.append(np.stack([place, j, np.repeat(key, n), np.repeat(form, n), rolling(_hashed(text), window).view(np.int64)[place]]))
            place, j, key, form, edge = np.concatenate(out, axis=1)
            row = pa.array(np.repeat(np.arange(len(rows)), rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(key), pa.array(form), pa.array(edge)],
                ["doc_id", "t", "place", "j", "key", "form", "edge"],
            )

    return run


def _sums_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, place, value): rolling sums of a text at the places asked for."""
    for batch in slices(batches, 256):
        rows, out = [], []
        for text, wanted in zip(texts(batch.column(2)), batch.column(3), strict=True):
            place = wanted.values.to_numpy(zero_copy_only=False).astype(np.int64)
            rows.append(len(place))
            out.append(np.stack([place, _sums(_hashed(text)).view(np.int64)[place]]))
        place, value = np.concatenate(out, axis=1)
        row = pa.array(np.repeat(np.arange(len(rows)), rows))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(place.astype(np.int32)), pa.array(value)], ["doc_id", "t", "place", "value"])


def _verified(h: np.ndarray, spans: pa.ListScalar) -> np.ndarray:
    """Whether each word lies in a span that equals its source."""
    gone = np.zeros(len(h) + 1, np.int64)
    lo, size, place, s0, s1 = (spans.values.field(k).to_numpy(zero_copy_only=False) for k in range(5))
    hi, sums, last = lo + size, _sums(h), np.maximum(lo, place)
    with np.errstate(over="ignore"):
        # A sum over [x, y) carries the power of x; both sides are raised to that of the later place.
        own = (sums[hi] - sums[lo]) * _power(last - lo)
        source = (s1.view(np.uint64) - s0.view(np.uint64)) * _power(last - place)
    same = own == source
    np.add.at(gone, lo[same], 1)
    np.add.at(gone, hi[same], -1)
    return np.cumsum(gone[:-1]) > 0


def _power(exponents: np.ndarray) -> np.ndarray:
    """BASE to each exponent, modulo 2 ** 64."""
    out, base, e = np.ones(len(exponents), np.uint64), BASE, exponents.astype(np.int64).copy()
    with np.errstate(over="ignore"):
        while e.any():
            out = np.where(e & 1 == 1, out * base, out)
            base = base * base
            e >>= 1
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 256):
        n_words, n_removed, digests = [], [], []
        for text, spans in zip(texts(batch.column(1)), batch.column(2), strict=True):
            digest = hashlib.sha256()
            gone = _verified(_hashed(text), spans) if spans.is_valid else None
            done, first = 0, True
            for piece in _pieces(text):
                words = piece.split()
                kept = words if gone is None else [w for w, g in zip(words, gone[done : done + len(words)].tolist(), strict=True) if not g]
                done += len(words)
                if kept:
                    digest.update((b"" if first else b" ") + b" ".join(kept))
                    first = False
            n_words.append(done)
            n_removed.append(0 if gone is None else int(gone.sum()))
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


class _Texts:
    """The documents, and the places in them that a step asks for."""

    def __init__(self, docs: DataFrame):
        text = at(docs, "text").cast("string")
        self.rows = docs.select(at(docs, "doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))

    def asked(self, wanted: DataFrame, value) -> DataFrame:
        """(doc_id, t, text, wanted): rows of which ``wanted`` names places."""
        per = wanted.groupBy(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).agg(F.collect_set(value).alias("wanted"))
        texts_ = self.rows.where("doc_id is not null")
        few = wanted.select("doc_id", "t").distinct()
        if few.count() <= BROADCAST_DOCS:
            texts_ = texts_.join(F.broadcast(few), ["doc_id", "t"], "left_semi")
        return texts_.join(per, (texts_.doc_id == F.col("of")) & (texts_.t == F.col("of_t"))).select("doc_id", "t", "text", "wanted")


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, t, lo, size, first, first_t, place): words [lo, lo + size) of a text (t: its hash) that stand from word ``place`` in the
    text ``first_t`` of a smaller document ``first``; not yet verified."""
    st = Staging(docs.sparkSession, "substrings")
    found = _Texts(docs)

    # 1. segments whose key stands in two documents or more.
    keyed = found.rows.where("doc_id is not null").mapInArrow(_key_lists(window, gram), "doc_id long, t long, keys array<bigint>")
    keyed = st.write(keyed.where(F.size("keys") > 0), "keys")
    shared = keyed.select("doc_id", F.explode("keys").alias("k")).groupBy("k").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k")
    shared = st.write(shared, "shared")
    slots = keyed.select("doc_id", "t", F.posexplode("keys").alias("i", "k"))
    hits = st.write(slots.join(shared, "k").select("doc_id", "t", "i"), "hits")
    segments = st.write(found.asked(hits, F.col("i")).mapInArrow(_hit_segments(window, gram), HIT), "segments")
    st.drop(keyed, shared, hits)

    # 2. distinct segments: first document, source coordinates, neighbours.
    own = ["key", "form", "n"]
    ends = [f(c).alias(f"{name}_{c}") for c in ("next", "prev") for name, f in (("lo", F.min), ("hi", F.max))]
    # Both come from one row of the first document; which of several does not matter.
    source = [F.min_by("t", "doc_id").alias("first_t"), F.min_by("start", "doc_id").alias("place")]
    forms = segments.groupBy(*own).agg(F.min("doc_id").alias("first"), *source, F.max("doc_id").alias("last"), *ends)
    alone = lambda c: F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}"))
    forms = forms.select(*own, "first", "first_t", "place", "last", F.when(alone("next"), F.col("lo_next")).alias("next"), F.when(alone("prev"), F.col("lo_prev")).alias("prev"))
    forms = st.write(forms, "forms")

    # 3. paths without branches, and their occurrences in later documents as spans.
    twice = forms.where("first < last")
    before = twice.select(F.col("first").alias("f"), F.col("first_t").alias("ft"), (F.col("place") + F.col("n")).alias("p"), F.col("next").alias("b"), F.col("form").alias("a"))
    joins = (F.col("first") == F.col("f")) & (F.col("first_t") == F.col("ft")) & (F.col("place") == F.col("p")) & (F.col("form") == F.col("b")) & (F.col("prev") == F.col("a"))
    linked = twice.join(before, joins, "left").withColumn("starts", F.when(F.col("f").isNull(), F.col("place")))
    along = Window.partitionBy("first", "first_t").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    paths = st.write(linked.select(*own, "first", "first_t", "place", F.last("starts", ignorenulls=True).over(along).alias("path")), "paths")
    later = segments.select("doc_id", "t", "start", *own).join(paths, own).where("doc_id > first")
    diagonal = (F.col("start") - F.col("place")).alias("diagonal")
    spans = later.groupBy("doc_id", "t", "first", "first_t", "path", diagonal).agg(F.min("start").alias("lo"), F.max(F.col("start") + F.col("n")).alias("end"), F.min("place").alias("place"))
    span = ["doc_id", "t", "lo", (F.col("end") - F.col("lo") + window - 1).alias("size"), "first", "first_t", "place"]
    spans = spans.select(*span)

    # 4. edges of segments that only share their key with others.
    many = st.write(forms.groupBy("key").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", "least"), "many")
    apart = st.write(forms.join(many, "key").select("first", "first_t", "place", "key", "form", "n"), "apart")
    asked = apart.select(F.col("first").alias("doc_id"), F.col("first_t").alias("t"), F.struct(F.col("place").alias("start"), "n", "key", "form").alias("w"))
    edges = st.write(found.asked(asked, F.col("w")).mapInArrow(_edges(window), "doc_id long, t long, place int, j int, key long, form long, edge long"), "edges")
    least = edges.groupBy(F.col("key").alias("k"), F.col("edge").alias("e")).agg(F.min("doc_id").alias("first"), F.min_by("t", "doc_id").alias("first_t"), F.min_by("place", "doc_id").alias("place"), F.max("doc_id").alias("last"))
    least = st.write(least.where("first < last").drop("last"), "least")
    st.drop(many, apart)
    partly = edges.select("doc_id", "j", "key", "form", "edge").join(least, (F.col("key") == F.col("k")) & (F.col("edge") == F.col("e"))).where("doc_id > first")
    partly = st.write(partly.select("doc_id", "key", "form", "j", "first", "first_t", "place"), "partly")
    st.drop(edges, least)
    # The first document of a segment may hold it more than once, and in several rows of its id.
    windows = segments.select("doc_id", "t", "start", "key", "form").join(partly, ["doc_id", "key", "form"])
    windows = windows.select("doc_id", "t", (F.col("start") + F.col("j")).alias("lo"), "first", "first_t", "place").distinct().withColumn("diagonal", F.col("lo") - F.col("place"))
    run = Window.partitionBy("doc_id", "t", "first", "first_t", "diagonal").orderBy("lo")
    runs = windows.withColumn("run", F.col("lo") - F.row_number().over(run)).groupBy("doc_id", "t", "first", "first_t", "diagonal", "run")
    runs = runs.agg(F.min("lo").alias("lo"), (F.max("lo") + 1).alias("end"), F.min("place").alias("place")).select(*span)
    out = st.write(spans.unionByName(runs), "spans")
    st.drop(segments, forms, paths, partly)
    return out


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row per row of ``docs`` (doc_id, text)."""
    st = Staging(docs.sparkSession, "spans")
    found = _Texts(docs)
    spans = repeated_spans(docs, window, gram)
    ends = spans.select(F.col("first").alias("doc_id"), F.col("first_t").alias("t"), F.explode(F.array("place", F.col("place") + F.col("size"))).alias("place")).distinct()
    sums = st.write(found.asked(ends, F.col("place")).mapInArrow(_sums_at, "doc_id long, t long, place int, value long").distinct(), "sums")
    end = lambda name: sums.select(F.col("doc_id").alias("first"), F.col("t").alias("first_t"), F.col("place").alias(f"at_{name}"), F.col("value").alias(name))
    checked = spans.withColumn("at_s0", F.col("place")).withColumn("at_s1", F.col("place") + F.col("size")).join(end("s0"), ["first", "first_t", "at_s0"]).join(end("s1"), ["first", "first_t", "at_s1"])
    per = st.write(checked.groupBy(F.col("doc_id").alias("of"), F.col("t").alias("of_t")).agg(F.collect_list(F.struct("lo", "size", "place", "s0", "s1")).alias("spans")), "checked")
    st.drop(spans, sums)
    rows = found.rows.join(per, (F.col("doc_id") == F.col("of")) & (F.col("t") == F.col("of_t")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")
