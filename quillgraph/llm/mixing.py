"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key (the MD5 of its id, or of its text where it has none), so a source in key order
is a random order that reruns repeat. Keys are uniform, so fixed key ranges cut each source into parts of like size:
the prefix sum of words is the sum of the earlier parts plus a running sum inside one part, and no window ever holds
more than a part. The cut falls at each source's exact budget: whole epochs first, then documents in key
order, the last one in part. Rows that are alike in all that counts are one row with a number of copies until the cut
is known, so that no number of repeats makes a window large.

Targets are filled like water: sources whose weighted share exceeds ``max_epochs`` times their size stop
there, and the rest is shared again by weight, until none is above; each round is one aggregation over the sources.

Odd input: a null text has size 0; sources are ordered by code point with null last (null is a source of
its own); rows sharing a doc_id are separate documents, ordered by size where keys tie; extra columns stay out; an
empty table gives an empty result. A source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.ranks import numbered
from quillgraph.plans.staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that one key range holds, about.
PART_ROWS = 20_000
#: Copies of a row that one task writes in a row.
COPIES = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), whatever the number of sources."""
    st = Staging(sizes.sparkSession, "targets")
    table = F.array(*[F.lit(float(x)) for x in weights])
    s = numbered(sizes, F.col("source").isNull(), F.col("source"), name="nth")
    s = st.write(s.select("source", "source_size", F.get(table, ((F.col("nth") - 1) % len(weights)).cast("int")).alias("weight")), "weights")
    cap = max_epochs * F.col("source_size")
    level, full = 0.0, -1
    while True:
        # Sources are full once their share at this level is above their cap; the level only rises.
        stop = F.lit(level) * F.col("weight") > cap
        one = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
        now = s.agg(F.count(F.when(stop, 1)).alias("n"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), one("source_size", stop).alias("full"), one("weight", ~stop).alias("open")).first()
        if now["n"] == full or not now["open"]:
            break
        full = now["n"]
        level = (share * now["total"] - max_epochs * now["full"]) / now["open"]
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight")) if now["open"] else cap.cast("double")
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words each document gives to the mix, repeats counted.

    Columns named in ``carry`` go along."""
    st = Staging(docs.sparkSession, "mix")
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.md5(F.concat(F.lit("text "), F.col("text").cast("string")).cast("binary")), F.lit(""))
    d = docs.select("doc_id", "source", (word_count(F.col("text").cast("string")) if size is None else size).alias("size"), *carry, key.alias("key"))
    d = st.write(d.groupBy("source", "key", "doc_id", "size", *carry).agg(F.count(F.lit(1)).alias("copies")), "sized")
    targets = source_targets(d.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, max_epochs)
    digits = 1
    n = d.count()
    while n > PART_ROWS * 16**digits and digits < 8:
        digits += 1
    d = d.withColumn("part", F.substring("key", 1, digits))
    words = F.col("size") * F.col("copies")
    parts = d.groupBy("source", "part").agg(F.sum(words).alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    parts = parts.withColumnsRenamed({"source": "s", "part": "p"}).join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t")))
    parts = st.write(parts.select("s", "p", "offset", "source_size", "target"), "parts")
    inside = Window.partitionBy("source", "part").orderBy("key", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    run = d.withColumn("inner", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    run = run.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    # The copies of a row one by one again, in runs of a bounded length.
    zero = F.lit(0).cast("long")
    run = run.withColumn("from_copy", F.explode(F.sequence(zero, F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    run = run.withColumn("nth", F.explode(F.sequence(F.col("from_copy"), F.least(F.col("copies"), F.col("from_copy") + COPIES) - 1)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inner") - F.col("nth") * F.col("size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mix_sql(docs: str = "documents", size: str | None = None) -> str:
    """DuckDB SQL for the same mix with the default weights."""
    words = size or r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
    return rf"""
with d as (select doc_id, source, {words}::bigint as size, coalesce(md5(doc_id::varchar), md5('text ' || text), '') as key from {docs}),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3.0::double, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as weight from s),
f as (select *, coalesce(sum(source_size) over before, 0)::double as full_, coalesce(sum(weight) over before, 0) as gone, sum(source_size) over () as total, sum(weight) over () as all_weights
      from w window before as (order by source_size / weight, source is null, source rows between unbounded preceding and 1 preceding)),
l as (select *, (1.5 * total - 2 * full_) / (all_weights - gone) as lev from f),
c as (select min_by(lev, full_) as lev from l where lev * weight <= 2 * source_size),
t as (select source, source_size, case when c.lev is null then 2.0 * source_size else least(2.0 * source_size, c.lev * weight) end as target from f left join c on true),
r as (select d.*, t.source_size, t.target, coalesce(sum(size) over (partition by d.source order by key, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before_
      from d join t on d.source is not distinct from t.source),
e as (select *, floor(target)::bigint as budget, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end as epochs from r)
select doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before_)))::bigint as taken from e"""
