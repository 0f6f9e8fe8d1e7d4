"""URL filter by hashed host-suffix and path-prefix expressions, with DataFrame functions only.

Each distinct URL is expanded into the suffixes of its host at a dot that have no more labels than the longest
rule, times every prefix of its path of a length that some rule has. Expressions meet the rules by an equi-join on
the first four bytes of their SHA-256, the full digest confirms, and the longest fitting rule wins: by host, then by
path. Where no rule fits, the further rules (of lower precedence, same form) are asked, and then the verdict is
``default``. URLs that many pages share are judged once; their pages join the verdict by URL, the pages' side being
the one that adaptive execution splits where a URL is frequent.

Odd input: a null URL or one without ``://`` has an empty host and path and fits no rule; an empty rule list
fits nothing; pages repeated in the input repeat in the result; hosts of any number of labels cost time in
proportion to their length; extra columns pass through if named in ``keep``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.columns import unused

# The base rules, as (host, path, verdict).
BASE_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
# Further rules, asked only where no base rule fits: top-level domains for adult content and gambling.
FURTHER_RULES = tuple((host, "", "block") for host in ("xxx", "porn", "adult", "sex", "sexy", "casino", "bet", "poker", "bingo"))
#: Rules that may be broadcast (a digest and a short text each).
BROADCAST_RULES = 1_000_000
#: Rule path lengths as an expression; longer lists of lengths would repeat the URL too often.
PREFIX_BYTES = 4


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return _lower_ascii(host), path


def _rule_rows(rules, rank: int) -> list[tuple]:
    return [(host, path, verdict, rank) for host, path, verdict in rules]


def filter_urls(pages: DataFrame, rules=BASE_RULES, further=FURTHER_RULES, default: str = "allow", keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """keep..., url's host and path, rule (host + path of the base rule, else null), verdict, further_rule."""
    spark = pages.sparkSession
    rows = _rule_rows(rules, 0) + _rule_rows(further, 1)
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule_verdict string, rank int")
    table = table.withColumn("rule_digest", digest).withColumn("short", F.substring("rule_digest", 1, 2 * PREFIX_BYTES))
    table = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    lengths = sorted({len(r[1]) for r in rows})
    most = max((r[0].count(".") + 1 for r in rows), default=1)

    host, path = host_and_path(F.col("u"))
    urls = pages.select(F.col(url).cast("string").alias("u")).where("u is not null").distinct().select("u", host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda i: F.array_join(F.slice(labels, -i, i), "."))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) if n else F.lit("") for n in lengths] or [F.lit("")]))
    expanded = urls.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
    hashed = expanded.withColumn("digest", F.sha2(F.concat_ws("\n", "h", "p"), 256)).withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    fits = hashed.join(table, "short").where((F.col("digest") == F.col("rule_digest")) & (F.col("rank") >= 0))
    best = fits.groupBy("u").agg(
        F.min_by(F.struct("rule_host", "rule_path", "rule_verdict", "rank"), F.struct("rank", -F.length("rule_host"), -F.length("rule_path"), "rule_host", "rule_path")).alias("b")
    )
    at_url, u, b = unused([*keep], "at_url", "u", "b")
    best = best.toDF(u, b)
    out = pages.select(*keep, F.col(url).cast("string").alias(at_url)).join(best, F.col(at_url) == F.col(u), "left")
    host, path = host_and_path(F.col(at_url))
    name = F.concat(f"{b}.rule_host", f"{b}.rule_path")
    return out.select(
        *keep, host.alias("host"), path.alias("path"), F.when(F.col(f"{b}.rank") == 0, name).alias("rule"),
        F.coalesce(f"{b}.rule_verdict", F.lit(default)).alias("verdict"), F.when(F.col(f"{b}.rank") == 1, name).alias("further_rule"),
    )


def filter_urls_sql() -> str:
    """DuckDB SQL for the default rules."""
    base = ", ".join(f"('{h}', '{p}', '{v}', 0)" for h, p, v in BASE_RULES)
    more = ", ".join(f"('{h}', '{p}', '{v}', 1)" for h, p, v in FURTHER_RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with r(rh, rp, v, rank) as (values {base}, {more}),
x as (select row_number() over () as rid, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select rid, page_id, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1) as raw from x),
u as (select rid, page_id, translate(raw, '{upper}', '{lower}') as host, regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) as path from h),
b as (select rid, min_by({{'name': rh || rp, 'v': v, 'rank': rank}}, [rank, -length(rh), -length(rp)]) as b
      from u join r on (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp) group by rid)
select page_id, host, path, case when b.b.rank = 0 then b.b.name end as rule, coalesce(b.b.v, 'allow') as verdict, case when b.b.rank = 1 then b.b.name end as further_rule
from u left join b using (rid)"""
