"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if the pages of that host that contain it, divided by the host's pages,
exceed ``ratio`` and number at least ``least_pages``. For lines of ``LONG_CHARS`` or more, which never repeat by
chance, the ratio is ``long_ratio``. Lines are compared without the white space around them; blank lines are never
boilerplate. What is left keeps its order and its line breaks. Equal texts on a host count as one page.

Edited copies of a page are for near-duplicate removal, which needs their lines. They are told by what a page has beside
the lines above the ratio, so that a template cannot speak for itself: pages whose own words agree in the five words
of smallest MD5, and pages that agree in those of largest, are of one kind (the larger number of kinds is taken). A line
above the ratio whose pages are of fewer kinds than half their number stands in copies, and stays.

Only hashes and hosts move through the shuffle, combined before it; texts stay where they are: the hosts'
boilerplate hashes, of which each host has at most (lines of an average page) / ratio, go to the texts as one array
per host. Above ``BROADCAST_LINES`` of them they are joined by host instead, hosts with many rows dealt to
``SALTS`` parts.

Odd input: a null text stays null and counts as a page without lines; a null host is a host of its own; a
line repeated inside a page counts that page once; rows sharing a doc_id are separate pages; every other
column, whatever its name, passes through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import at, unused
from quillgraph.plans.staging import Staging

#: Share of a host's pages above which a line is boilerplate, for short lines and for long ones; least number of pages.
RATIO, LONG_RATIO, LEAST_PAGES = 0.02, 0.0001, 3
#: Characters from which a line is long.
LONG_CHARS = 200
#: Words that tell what a page has of its own.
OWN_WORDS = 5
#: Boilerplate lines (8 bytes each) that may be broadcast; parts of a host beyond that.
BROADCAST_LINES, SALTS = 2_000_000, 64
SPACES = " \t\r\x0b\x0c\n"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _key(line: Column) -> Column:
    """64-bit key of a trimmed line; its last bit tells long lines."""
    return F.xxhash64(line).bitwiseAND(F.lit(-2)).bitwiseOR((F.length(line) >= LONG_CHARS).cast("long"))


def _keys(text: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != ""), _key)


def frequent(docs: DataFrame, host: str, text: str, ratio: float, long_ratio: float, least_pages: int, st: Staging) -> DataFrame:
    """(h, k, n): keys of the lines above the ratio on a host, and their pages there."""
    pages = docs.select(at(docs, host).alias("h"), at(docs, text).cast("string").alias("text"))
    # The null entry is the page itself, counted among its lines: one aggregation gives both counts.
    entries = F.array_append(F.coalesce(F.array_distinct(_keys(F.col("text"))), F.array().cast("array<bigint>")), F.lit(None).cast("long"))
    pages = pages.select("h", F.xxhash64("text").alias("t"), entries.alias("l")).groupBy("h", "t").agg(F.any_value("l").alias("l"))
    counts = pages.select("h", F.explode("l").alias("k")).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    counts = st.write(counts.where((F.col("n") >= least_pages) | F.col("k").isNull()), "counts")
    totals = counts.where("k is null").select(F.col("h").alias("th"), F.col("n").alias("pages"))
    share = F.when(F.col("k").bitwiseAND(F.lit(1)) == 1, F.lit(long_ratio)).otherwise(F.lit(ratio))
    found = counts.where("k is not null").join(totals, F.col("h").eqNullSafe(F.col("th")))
    return st.write(found.where(F.col("n") > share * F.col("pages")).select("h", "k", "n"), "frequent")


def _with_lines(docs: DataFrame, host: str, text: str, lines: DataFrame, name: str, st: Staging) -> DataFrame:
    """``docs`` with the keys of its host's ``lines`` (h, k) in the array column ``name``, null if it has none."""
    by, salt, part = unused([*docs.columns, name], "by", "salt", "part")
    per = st.write(lines.groupBy(F.col("h").alias(by)).agg(F.collect_list("k").alias(name)), "per_host")
    if per.agg(F.coalesce(F.sum(F.size(name)), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_LINES:
        return docs.join(F.broadcast(per), at(docs, host).eqNullSafe(F.col(by)), "left")
    dealt = docs.withColumn(salt, F.pmod(F.xxhash64(at(docs, text)), F.lit(SALTS)))
    copies = per.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, at(dealt, host).eqNullSafe(F.col(by)) & (F.col(salt) == F.col(part)), "left")


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, long_ratio: float, least_pages: int, st: Staging) -> DataFrame:
    """(h, k): keys of the lines that are boilerplate on a host."""
    found = frequent(docs, host, text, ratio, long_ratio, least_pages, st)
    pages = docs.select(at(docs, host).alias("h"), at(docs, text).cast("string").alias("text"))
    pages = _with_lines(pages, "h", "text", found, "above", st).where("above is not null")
    pages = pages.select("h", "text", F.array_intersect(_keys(F.col("text")), "above").alias("hit")).where(F.size("hit") > 0)
    own = F.filter(F.transform(F.split("text", "\n"), _trimmed), lambda x: (x != "") & ~F.array_contains("hit", _key(x)))
    words = F.filter(F.split(F.array_join(own, " "), "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (OWN_WORDS - 1), F.lit(1))), lambda i: F.md5(F.array_join(F.slice(w, i, OWN_WORDS), " ").cast("binary")))
    pages = pages.select("h", "hit", words.alias("w")).select("h", "hit", runs(F.col("w")).alias("r"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.xxhash64(F.array_min("r")).alias("s")), F.struct(F.lit(1).alias("end"), F.xxhash64(F.array_max("r")).alias("s")))
    kinds = pages.select("h", "hit", F.explode(ends).alias("e")).select("h", F.explode("hit").alias("k"), "e.end", "e.s")
    kinds = kinds.groupBy("h", "k", "end", "s").agg(F.lit(1).alias("one")).groupBy("h", "k", "end").agg(F.count("one").alias("c"))
    kinds = kinds.groupBy(F.col("h").alias("kh"), F.col("k").alias("kk")).agg(F.max("c").alias("kinds"))
    return found.join(kinds, F.col("h").eqNullSafe(F.col("kh")) & (F.col("k") == F.col("kk"))).where("2 * kinds >= n").select("h", "k")


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, long_ratio: float = LONG_RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; all rows and columns stay."""
    st = Staging(docs.sparkSession, "lines")
    bad = unused(docs.columns, "bad")[0]
    d = _with_lines(docs, host, text, boilerplate(docs, host, text, ratio, long_ratio, least_pages, st), bad, st)
    kept = F.filter(F.split(at(d, text), "\n"), lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col(bad), _key(_trimmed(x))))
    return d.select(*[F.when(F.col(bad).isNull(), at(d, c)).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else at(d, c) for c in docs.columns])


def dedup_lines_sql(docs: str = "documents", ratio: float = RATIO, long_ratio: float = LONG_RATIO, least_pages: int = LEAST_PAGES) -> str:
    """DuckDB SQL for the texts after line dedup by source."""
    return f"""
with p as (select row_number() over () as rid, * from {docs}),
l as (select rid, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from p),
t as (select rid, source, i, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as k from l),
one as (select min(rid) as rid, source, text from p group by source, text),
u as (select distinct rid, source, k from t where k <> '' and rid in (select rid from one)),
pages as (select source, count(*) as pages from one group by source),
c as (select source, k, count(*) as n from u group by source, k),
above as (select c.source, k, n from c join pages on c.source is not distinct from pages.source
        where n >= {least_pages} and n > (case when length(k) >= {LONG_CHARS} then {long_ratio} else {ratio} end) * pages),
own as (select one.rid, string_agg(t.k, ' ' order by t.i) filter (t.k <> '' and a.k is null) as own from one join t using (rid)
        left join above a on a.source is not distinct from t.source and a.k = t.k group by one.rid),
w as (select rid, list_filter(regexp_split_to_array(coalesce(own, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from own),
r as (select rid, list_transform(range(1, greatest(len(w) - {OWN_WORDS - 1}, 1) + 1), lambda i: md5(array_to_string(w[i:i + {OWN_WORDS - 1}], ' '))) as r from w),
bad as (select a.source, a.k from above a join u on a.source is not distinct from u.source and a.k = u.k join r using (rid)
        group by a.source, a.k, a.n having 2 * greatest(count(distinct list_min(r)), count(distinct list_max(r))) >= a.n),
kept as (select rid, string_agg(line, chr(10) order by i) as text from t where not exists (select 1 from bad where bad.source is not distinct from t.source and bad.k = t.k) group by rid)
select p.doc_id, case when p.text is null then null else coalesce(kept.text, '') end as text, p.lang, p.source, length(case when p.text is null then null else coalesce(kept.text, '') end)::bigint as n_chars
from p left join kept using (rid)"""
