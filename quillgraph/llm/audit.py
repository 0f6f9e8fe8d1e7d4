"""Filter interaction audit: what each of five filters removes, in every order they can be applied in.

A document is reduced to five bits, the filters it fails, so all that the 120 orders do follows from how many documents
of a part fail each of the 32 sets of filters. Those histograms, of all documents, of good ones and of toxic ones, are
stacked as rows and multiplied by integer matrices of 32 masks by 600 pairs of order and step: for documents kept,
removed, removed before (redundant) and failing nothing else (unique).

Filters (a document fails if the condition holds; words are maximal runs without ASCII white space):
A under 200 words; B distinct words under half of the words; C over 3 % of the characters are A to Z; D any of
``#$%&*|``; E the text equals that of a smaller doc_id.

Only digests, masks and counts move: documents are counted by (text, doc_id, mask, part, labels), then by text, each step
combined before its shuffle, so a text that a third of the rows share costs each task one row. A part has at most 32 masks.

Odd input: a null text is the empty one, a null lang the part ''; a null doc_id is smaller or larger than none, so it never
fails E and makes none fail; rows sharing a doc_id are documents of their own, none smaller than the other; a document has
quality 1 (or is toxic) if any row of ``labels`` with its doc_id says so; without labels nothing is good or toxic; an empty
table has no parts and gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import at

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MASKS = 1 << len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
OUT = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in COUNTS)
SPACE = "[\\x20\\x09-\\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text, not null, fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


def outcome_matrices() -> dict[str, np.ndarray]:
    """Masks by pairs of order and step: 1 where a document with that mask has the outcome."""
    masks = np.arange(MASKS)
    out = {k: np.zeros((MASKS, STEPS), np.int64) for k in COUNTS[:4]}
    for o, order in enumerate(ORDERS):
        before = np.zeros(MASKS, bool)
        for s, name in enumerate(order):
            fails = masks >> FILTERS.index(name) & 1 == 1
            column = o * len(FILTERS) + s
            out["kept"][:, column] = ~(before | fails)
            out["removed"][:, column] = fails & ~before
            out["redundant"][:, column] = fails & before
            out["unique_fails"][:, column] = masks == 1 << FILTERS.index(name)
            before |= fails
    return out


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the set of filters they fail."""
    text = F.coalesce(at(docs, "text").cast("string"), F.lit(""))
    slim = docs.select(at(docs, "doc_id").cast("long").alias("id"), F.coalesce(at(docs, "lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("t"), text_mask(text).alias("m"))
    marks = labels.groupBy(at(labels, "doc_id").cast("long").alias("of")).agg(*[F.coalesce(F.max((at(labels, c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    slim = slim.join(marks, slim.id == marks.of, "left").select("id", "part", "t", "m", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")])
    kind = ["t", "m", "part", "quality", "toxic"]
    rows = slim.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("c"))
    # Of each text and kind: all documents, those without an id, the smallest id, and the documents that have it.
    kinds = rows.groupBy(*kind).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("without"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("first"))
    smallest = kinds.groupBy(F.col("t").alias("of")).agg(F.min("first.id").alias("least"))
    kinds = kinds.join(smallest, kinds.t == smallest.of)
    passes = F.col("without") + F.when(F.col("first.id") == F.col("least"), F.col("first.c")).otherwise(0)
    each = kinds.select("part", "quality", "toxic", F.explode(F.array(F.struct(F.col("m").alias("mask"), passes.alias("n")), F.struct((F.col("m") + 16).alias("mask"), (F.col("n") - passes).alias("n")))).alias("e"))
    # The masks of empty groups keep every part in the result.
    return each.groupBy("part", F.col("e.mask").alias("mask")).agg(F.sum("e.n").alias("docs"), F.sum(F.col("e.n") * F.col("quality")).alias("good"), F.sum(F.col("e.n") * F.col("toxic")).alias("toxic"))


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = outcome_matrices()
    steps = [(order, s + 1, name) for order in ORDERS for s, name in enumerate(order)]
    letter = np.array([FILTERS.index(name) for _, _, name in steps])
    for batch in batches:
        parts = batch.column(0).to_pylist()
        stacked = np.zeros((3, len(parts), MASKS), np.int64)
        for i, cells in enumerate(batch.column(1).to_pylist()):
            for cell in cells:
                stacked[:, i, cell["mask"]] = cell["docs"], cell["good"], cell["toxic"]
        docs, good, toxic = stacked
        got = {c: docs @ m for c, m in by.items()}
        got["good_lost"], got["toxic_lost"] = good @ by["removed"], toxic @ by["removed"]
        whole = np.stack([got["removed"][:, letter == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
        got["shapley"] = whole[:, letter]
        orders, at_step, names = zip(*steps, strict=True)
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p in parts for _ in range(STEPS)], pa.string()), pa.array(list(orders) * n, pa.string()), pa.array(list(at_step) * n, pa.int32()), pa.array(list(names) * n, pa.string()), *[pa.array(got[c].reshape(-1), pa.int64()) for c in COUNTS]],
            ["part", "filter_order", "step", "filter", *COUNTS],
        )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome counts of every part, order of filters and step; docs (doc_id, text, lang), labels (doc_id, quality, toxic)."""
    cells = mask_counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_multiplied, OUT)


def audit_sql(docs: str = "documents", labels: str = "labels") -> str:
    """DuckDB SQL for the same rows, document by document and step by step."""
    orders = ", ".join(f"('{o}')" for o in ORDERS)
    return f"""
with d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part, row_number() over () as rid from {docs}),
w as (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as least from d),
f as (select part, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
        + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as m,
        coalesce((select max((l.quality = 1)::int) from {labels} l where l.doc_id = w.doc_id), 0) as good, coalesce((select max((l.toxic = 1)::int) from {labels} l where l.doc_id = w.doc_id), 0) as toxic from w),
h as (select part, m, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, m),
o as (select filter_order, step, substr(filter_order, step, 1) as filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) as own,
        list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i::int, 1)) - 65))) as earlier
      from (values {orders}) as t(filter_order), unnest([1, 2, 3, 4, 5]) as s(step)),
r as (select part, filter_order, step, filter,
        sum(case when m & (own | coalesce(earlier, 0)::int) = 0 then n else 0 end)::bigint as kept,
        sum(case when m & own > 0 and m & coalesce(earlier, 0)::int = 0 then n else 0 end)::bigint as removed,
        sum(case when m & own > 0 and m & coalesce(earlier, 0)::int > 0 then n else 0 end)::bigint as redundant,
        sum(case when m = own then n else 0 end)::bigint as unique_fails,
        sum(case when m & own > 0 and m & coalesce(earlier, 0)::int = 0 then good else 0 end)::bigint as good_lost,
        sum(case when m & own > 0 and m & coalesce(earlier, 0)::int = 0 then toxic else 0 end)::bigint as toxic_lost
      from h, o group by part, filter_order, step, filter)
select part, filter_order, step::int as step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, filter))::bigint as shapley from r"""
