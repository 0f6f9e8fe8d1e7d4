"""Benchmark decontamination by template canonicalisation.

Every text is read in three forms. In two of them words become template tokens: a run of number and unit words
(``7.5``, ``1,250``, ``30 km``, ``30km``, ``twenty-five``) turns into one placeholder of its type (number, unit, or
measure), a run of names (capitalised words) into another, and everything else is lower-cased; the second form
leaves names as words, so that a copy in other letter case still matches. The third form is the words themselves.
Windows of ``window`` consecutive tokens are hashed and joined with the windows of the benchmark items; matches are
gathered per document, item, form and diagonal (neighbouring diagonals are merged). An item counts as found if

* ``cover`` of its words, or ``run`` of them in a row, stand in the document, compared one by one along the matches
  of the third form and the words around them; or
* matches of a template form cover ``cover`` of the template and its slots are consistent, on one diagonal or over
  all: each value of the item stands for one value of the document throughout. Other values in consistent slots
  mark a re-parameterised question.

Template windows that are mostly placeholders would match anything of their shape and are left to the words. So is
the whole template where such windows are over half of it or fewer than ``TEMPLATE_WORDS`` plain words remain.

Before the join, windows pass a bitmap over the benchmark's hashes, so only likely matches leave the tasks; the
bitmap has a bounded size, is put together in Spark, and can only let too many through, never too few.

Odd input: a null text is empty and clean; an item without words matches nothing; one with fewer than
``least_words`` words is found in a document that has just these words; an item shorter than a window is one window
of its own length; items repeated with other ids are all reported; every row gives a row, exact repeats included; a
null doc_id keeps its row, a null item_id drops the item; an empty benchmark finds nothing; extra columns are ignored.
Texts are read by some ``CHUNK`` bytes and hits leave by ``HITS`` rows; a longer text is held as numbers, about ten bytes
a byte of text.
Names are told by letter case: in capitals only, or in scripts without case, other names count as other words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.words import CACHE_WORDS, MIX, scramble, texts
from quillgraph.plans.staging import Staging

WINDOW, COVER, LEAST_WORDS = 5, 0.8, 4
#: Words verbatim in a row that make an item found however long it is; plain words that a template must have.
RUN, TEMPLATE_WORDS = 13, 4
#: Benchmark windows that may be broadcast (some 150 bytes each); beyond it each stands in ``SALTS`` copies, so that
#: documents with one common window are dealt to as many tasks.
BROADCAST_WINDOWS, SALTS = 500_000, 32
#: Largest bitmap in bits; bits for each window up to there; bits of one piece.
BITMAP_MOST, BITMAP_EACH, PIECE = 1 << 26, 256, 1 << 16
#: Bytes of text read at a time; hits that leave a task at a time.
CHUNK, HITS = 1 << 20, 1 << 13

# Words that are units.
UNITS = frozenset(
    b"mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons"
    b" ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years"
    b" cent cents dollar dollars euro euros usd eur gbp percent degree degrees mph kmh kph hz khz mhz watt watts volt volts".split()
)
# Words that are numbers.
NUMBERS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    b" twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)

#: Bytes that are neither digits nor letters nor beyond ASCII become blanks; letter case stays.
CASED = bytes(b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
THOUSANDS = re.compile(rb"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))")
MEASURED = re.compile(rb"[0-9]+([a-z]+)\Z")
# Kinds of words as bits, so that a run's kinds add up; the forms.
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 4
NAMED, PLAIN, VERBATIM, WHOLE = range(4)
SAYING = dict.fromkeys(UNITS, UNIT) | dict.fromkeys(NUMBERS, NUMBER)
SLOTS = np.array([xxhash.xxh3_64_intdigest(b"slot", seed=kind) for kind in range(8)], np.uint64)


class Words(dict):
    """word -> number; hashes and kinds by number. Remembers the words of this worker's current texts."""

    def __init__(self):
        self.hashes, self.kinds, self.words = np.empty(1024, np.uint64), np.empty(1024, np.uint8), []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        if n == len(self.kinds):
            self.hashes, self.kinds = np.resize(self.hashes, 2 * n), np.resize(self.kinds, 2 * n)
        low, kind = word, WORD
        if not (word.isalpha() and word.islower()):  # of ASCII only; else letter case and digits tell more
            text = word.decode("utf-8", "replace")
            low = text.lower().encode()
            if text[0].isdigit():
                measured = MEASURED.match(low)
                kind = NUMBER | UNIT if measured and measured[1] in UNITS else NUMBER
            elif len(text) > 1 and text[0].isupper() and text[1:].islower():
                kind = NAME
        if low in SAYING:
            kind = SAYING[low]
        self.words.append(low)
        self.hashes[n], self.kinds[n] = xxhash.xxh3_64_intdigest(low), kind
        return n

    def fresh(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.words.clear()

    def split(self, text: bytes) -> list[bytes]:
        return (THOUSANDS.sub(b"", text) if b"," in text else text).translate(CASED).split()


class Stream:
    """Several texts in one form: token hashes, with the text and the first word of each token."""

    def __init__(self, words: Words, ids: np.ndarray, owner: np.ndarray, form: int):
        self.words, self.ids, self.form = words, ids, form
        kinds = words.kinds[ids]
        if form == NAMED:
            slot = (kinds > 0) + (kinds == NAME).astype(np.uint8)
        elif form == PLAIN:
            slot = ((kinds & (NUMBER | UNIT)) > 0).astype(np.uint8)
        else:
            slot = np.zeros(len(ids), np.uint8)
        begins = np.ones(len(ids), bool)
        begins[1:] = (slot[1:] == 0) | (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1])
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(ids))
        self.owner, self.slot = owner[self.start], slot[self.start] > 0
        self.token = words.hashes[ids[self.start]]
        if self.slot.any():
            run = np.bitwise_or.reduceat(kinds, self.start)
            self.token = np.where(self.slot, SLOTS[run], self.token)
        self._values: dict[int, int] = {}

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, whether it lies in one text) of each run of k tokens."""
        n = max(0, len(self.token) - k + 1)
        out = self.token[:n].copy()
        for i in range(1, k):
            out = out * MIX + self.token[i : n + i]
        return scramble(out + np.uint64(k * 8 + min(self.form, VERBATIM))), self.owner[:n] == self.owner[k - 1 : n + k - 1]

    def crowded(self, k: int) -> np.ndarray:
        """Whether placeholders are over half of each run of k tokens."""
        sums = np.concatenate([[0], np.cumsum(self.slot)])
        return (sums[k:] - sums[:-k]) * 2 > k if len(self.slot) >= k else np.zeros(0, bool)

    def _value(self, at: int) -> int:
        """A slot's value, its type in the last three bits: its words without what stands between, but for two numbers in a row."""
        if at not in self._values:
            out, kind = b"", 0
            for i in self.ids[self.start[at] : self.end[at]].tolist():
                word = self.words.words[i]
                out += b"." + word if out[-1:].isdigit() and word[:1].isdigit() else word
                kind |= int(self.words.kinds[i])
            self._values[at] = xxhash.xxh3_64_intdigest(out) >> 4 << 3 | kind
        return self._values[at]

    def around(self, at: np.ndarray, k: int, reach: int) -> np.ndarray:
        """Words of the windows ``at`` and ``reach`` beyond; values of slots, else 0, in template forms; 0 outside the text."""
        i = at[:, None] + np.arange(-reach, k + reach)
        safe = np.clip(i, 0, len(self.token) - 1)
        same = (i == safe) & (self.owner[safe] == self.owner[at][:, None])
        if self.form == VERBATIM:
            return np.where(same, self.token[safe], 0).view(np.int64)
        out = np.zeros(i.shape, np.int64)
        slots = same & self.slot[safe]
        out[slots] = [self._value(x) for x in safe[slots].tolist()]
        return out


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of ``CHUNK`` bytes or a little more, cut at blanks, so that a long one's words need not all be held as objects."""
    at = 0
    while len(text) - at > CHUNK:
        end = text.find(b" ", at + CHUNK)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def streams(words: Words, chunk: list[bytes]) -> Iterator[Stream]:
    """The texts of a chunk in the first three forms, one after the other."""
    words.fresh()
    parts = [[np.fromiter(map(words.__getitem__, words.split(x)), np.int32) for x in _pieces(t)] for t in chunk]
    owner = np.repeat(np.arange(len(chunk), dtype=np.int32), [sum(map(len, ps)) for ps in parts])
    ids = np.concatenate([x for ps in parts for x in ps] or [np.empty(0, np.int32)])
    del parts
    for form in (NAMED, PLAIN, VERBATIM):
        yield Stream(words, ids, owner, form)


ROW = "gram long, item long, form int, ipos int, size int, n long, values array<bigint>"


def item_windows(item: int, text: str, words: Words, k: int, least_words: int) -> list[tuple]:
    """(gram, item, form, ipos, size, n, values) of an item's windows; n: words or template tokens to be covered."""
    out = []
    for s in streams(words, [(text or "").encode()]):
        n = len(s.token)
        if s.form == VERBATIM:
            if n and n < least_words:
                out.append((int(s.windows(n)[0].view(np.int64)[0]), item, WHOLE, 0, n, n, s.around(np.zeros(1, int), n, 0)[0].tolist()))
            elif n:
                size = min(k, n)
                at = np.arange(n - size + 1)
                out += [(int(g), item, VERBATIM, i, size, n, v) for g, i, v in zip(s.windows(size)[0].view(np.int64), at.tolist(), s.around(at, size, k - 1).tolist(), strict=True)]
            continue
        if n < least_words or (s.form == NAMED and not (s.words.kinds[s.ids] == NAME).any()):
            continue
        size = min(k, n)
        at = np.flatnonzero(~s.crowded(size))
        covered = np.zeros(n, bool)
        for i in at.tolist():
            covered[i : i + size] = True
        if covered.sum() * 2 >= n and (covered & ~s.slot).sum() >= TEMPLATE_WORDS:
            grams = s.windows(size)[0].view(np.int64)
            out += [(int(grams[i]), item, s.form, i, size, int(covered.sum()), v) for i, v in zip(at.tolist(), s.around(at, size, k - 1).tolist(), strict=True)]
    return out


def _cut(k: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = [r for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in item_windows(item, text, words, k, least_words)]
            if rows:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["gram", "item", "form", "ipos", "size", "n", "values"])

    return run


def _piece(table: pa.Table) -> pa.Table:
    bits = np.zeros(PIECE, bool)
    bits[table["slot"].to_numpy()] = True
    return pa.table({"piece": table["piece"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmap(grams: DataFrame, n: int) -> np.ndarray:
    """Packed bits over the upper bits of ``n`` hashes, at most ``BITMAP_MOST`` of them; one task sets a piece."""
    size = PIECE
    while size < min(n * BITMAP_EACH, BITMAP_MOST):
        size *= 2
    slot = F.shiftrightunsigned("gram", 64 - (size.bit_length() - 1))
    pieces = grams.select((slot / PIECE).cast("int").alias("piece"), (slot % PIECE).cast("int").alias("slot")).distinct().groupBy("piece").applyInArrow(_piece, "piece int, bits binary")
    out = np.zeros((size // PIECE, PIECE // 8), np.uint8)
    for r in pieces.toArrow().to_pylist():  # at most BITMAP_MOST / 8 bytes
        out[r["piece"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Rows of a batch by some ``CHUNK`` bytes of text; a longer text is a chunk of its own."""
    ids = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
    whole = texts(batch.column(batch.num_columns - 1))
    at = size = 0
    for i, n in enumerate(map(len, whole)):
        if size and size + n > CHUNK:
            yield ids[at:i], whole[at:i]
            at, size = i, 0
        size += n
    if at < len(ids):
        yield ids[at:], whole[at:]


FOUND = ["uid", "row", "doc_id", "dform", "pos", "dgram", "found"]


def _hits(s: Stream, form: int, at: np.ndarray, size: int, reach: int, grams: np.ndarray, first: np.ndarray, uid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows ``at`` as rows, at most ``HITS`` at a time."""
    for i in range(0, len(at), HITS):
        some = at[i : i + HITS]
        n, of = len(some), s.owner[some]
        found = s.around(some, size, reach)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid[of]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, form, np.int32)), pa.array((some - first[of]).astype(np.int32)), pa.array(grams[some].view(np.int64)), listed], FOUND
        )


def _finder(lengths: list[int], k: int, least_words: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        packed, known = shared.value
        bits = np.unpackbits(packed).view(bool)
        shift = np.uint64(64 - (len(bits).bit_length() - 1))
        for batch in batches:
            for ids, chunk in _chunks(batch):
                uid = np.array([i[0] for i in ids], np.int64)
                for s in streams(words, chunk):
                    first = np.searchsorted(s.owner, np.arange(len(chunk)))
                    for size in lengths:
                        grams, good = s.windows(size)
                        at = np.flatnonzero(good & bits[grams >> shift])
                        if known is not None:
                            near = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
                            at = at[known[near] == grams[at]]
                        form, reach = s.form, k - 1
                        if s.form == VERBATIM and size < least_words:
                            # The windows of such items are whole texts.
                            alone = np.bincount(s.owner, minlength=len(chunk))[s.owner[at]] == size
                            form, at, reach = WHOLE, at[alone], 0
                        yield from _hits(s, form, at, size, reach, grams, first, uid)
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), pa.array([i[1] for i in ids], pa.int64()), pa.array([i[2] for i in ids], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))], FOUND
                )

    return run


def row_key() -> F.Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, least_words: int = LEAST_WORDS, gap: int = 3, run: int = RUN) -> DataFrame:
    """row, doc_id, contaminated, n_items, items, coverage, reparameterised: one row per document.

    ``row`` is ``row_key()`` of the document, equal for exact repeats."""
    spark = docs.sparkSession
    st = Staging(spark, "decontaminate")
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    table = st.write(items.mapInArrow(_cut(window, least_words), ROW), "windows")
    n = table.count()
    lengths = [r["size"] for r in table.select("size").distinct().orderBy("size").collect()]  # at most ``window`` of them
    # The hashes themselves, where they may be broadcast, spare the join what the bitmap lets through.
    known = np.sort(table.select("gram").distinct().toArrow()["gram"].to_numpy().view(np.uint64)) if 0 < n <= BROADCAST_WINDOWS else None
    shared = spark.sparkContext.broadcast((bitmap(table.select("gram"), n), known))
    # The number of a row names it inside this job only; all that refers to it is in the one staged table.
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_finder(lengths, window, least_words, shared), "uid long, row long, doc_id long, dform int, pos int, dgram long, found array<bigint>")
    found = st.write(found, "found")
    hits = found.where("dgram is not null")
    same_window = (F.col("gram") == F.col("dgram")) & (F.col("form") == F.col("dform"))
    if n <= BROADCAST_WINDOWS:
        hits = hits.join(F.broadcast(table), same_window)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = hits.withColumn("dsalt", F.pmod(F.xxhash64("uid", "pos"), F.lit(SALTS)).cast("int")).join(salted, same_window & (F.col("salt") == F.col("dsalt")))

    verbatim = F.col("form") >= VERBATIM
    reach = F.when(F.col("form") == WHOLE, 0).otherwise(window - 1)
    zipped = lambda keep, give: F.array_compact(F.transform(F.arrays_zip("values", "found"), lambda x, i: F.when((x["values"] != 0) & keep(x), give(x, i))))
    words = zipped(lambda x: x["values"] == x["found"], lambda x, i: F.col("ipos") - reach + i)
    typed = F.sequence("ipos", F.col("ipos") + F.col("size") - 1)
    # Slots of a window's surroundings count where both texts have one of one type.
    pairs = zipped(lambda x: (x["found"] != 0) & (x["values"].bitwiseAND(7) == x["found"].bitwiseAND(7)), lambda x, i: F.struct(x["values"].alias("a"), x["found"].alias("b")))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    hits = hits.select("uid", "item", "form", "n", (F.col("pos") - F.col("ipos")).alias("diag"), F.when(verbatim, words).otherwise(typed).alias("at"), F.when(verbatim, none).otherwise(pairs).alias("pairs"))
    union = lambda c, of: F.array_distinct(F.flatten(of(c))).alias(c)
    share = F.least(F.lit(1.0), F.size("at") / F.col("n"))
    once = F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")
    other = F.exists("pairs", lambda x: x["a"] != x["b"])
    by = hits.groupBy("uid", "item", "form", "diag").agg(union("at", F.collect_set), union("pairs", F.collect_set), F.max("n").alias("n"))
    whole = ~verbatim & (share >= cover) & once
    by = by.withColumn("whole", whole).withColumn("whole_other", whole & other)
    w = Window.partitionBy("uid", "item", "form").orderBy("diag")
    fresh = F.lag("diag").over(w).isNull() | (F.col("diag") - F.lag("diag").over(w) > gap)
    spans = by.withColumn("cluster", F.sum(fresh.cast("int")).over(w)).groupBy("uid", "item", "form", "cluster").agg(
        union("at", F.collect_list), union("pairs", F.collect_list), F.max("n").alias("n"), F.max("whole").alias("whole"), F.max("whole_other").alias("whole_other")
    ).withColumn("at", F.array_sort("at"))
    in_a_row = F.coalesce(F.exists(F.transform("at", lambda x, i: F.get("at", i + run - 1) - x == run - 1), lambda x: x), F.lit(False))
    merged = ~verbatim & (share >= cover) & once
    spans = spans.withColumn("ok", F.when(verbatim, (share >= cover) | in_a_row).otherwise(F.col("whole") | merged))
    spans = spans.select("uid", "item", "ok", share.alias("share"), (F.col("whole_other") | (merged & other)).alias("other"))
    judged = spans.groupBy("uid").agg(
        F.max("ok").alias("ok"), F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("item")))).alias("items"), F.max("share").alias("share"), F.max("other").alias("other"),
    )
    every = found.where("dgram is null").select("uid", "row", "doc_id").join(judged, "uid", "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return every.select(
        "row", "doc_id", F.coalesce("ok", F.lit(False)).alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.coalesce("share", F.lit(0.0)).alias("coverage"), F.coalesce("other", F.lit(False)).alias("reparameterised"),
    )
