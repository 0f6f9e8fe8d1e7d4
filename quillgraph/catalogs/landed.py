"""Files that Spark writes from the driver's tables and reads again: sealed logs, SQLite tables, boards, reports, pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import blocks, seals
from quillgraph.plans.staging import Staging
from quillgraph.plans.versions import chained
from quillgraph.sources import files, markdown, sqlite
from quillgraph.sources.lines import raw_lines
from quillgraph.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Events a log covers, so that a log stays small however large the table is, and lines of it that are not chained.
LOG, LEGACY = 250, 5


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


def _sealed_log(rows: pd.DataFrame) -> pd.DataFrame:
    """A log of events: some lines as text, a seal over them, chained lines, of which some are lost, torn, bare or edited later."""
    rows = rows.sort_values("event_id").reset_index(drop=True)
    log = int(rows["log"].iloc[0])
    legacy = [f"event {int(i)}: {t}\r".encode() for i, t in zip(rows["event_id"][:LEGACY], rows["event_type"][:LEGACY], strict=True)]
    seal = [seals.seal_entry(legacy)] if log % 4 != 3 and len(rows) > LEGACY else []
    ids = [int(i) for i in rows["event_id"][LEGACY:]]
    entries = chained([{"event": t, "id": i, "mark": 0} for i, t in zip(ids, rows["event_type"][LEGACY:], strict=True)], tip=json.loads(seal[0])["hash"] if seal else "")
    out = [x.decode() for x in legacy]
    if log % 4 == 1:
        out[1] = out[1].replace("event", "Event")
    out += [x.replace(f'"sealed_lines": {LEGACY}', '"sealed_lines": 1') if log % 4 == 2 else x for x in seal]
    for i, raw in zip(ids, entries, strict=True):
        if i % 61 == 3:
            continue
        out.append('{"id": ' if i % 89 == 11 else f'{{"id": {i}}}' if i % 83 == 13 else raw.replace('"mark": 0', '"mark": 1') if i % 50 == 7 else raw)
    return pd.DataFrame({"log": log, "line": range(1, len(out) + 1), "value": out})


@query("au01_sealed_logs", f"""with s as (select event_id // {LOG} as log, event_id, row_number() over (partition by event_id // {LOG} order by event_id) as p from events),
k as (select *, log % 4 <> 3 as sealed, case when p <= {LEGACY} then 'legacy' when event_id % 61 = 3 then 'lost' when event_id % 89 = 11 then 'torn' when event_id % 83 = 13 then 'bare' when event_id % 50 = 7 then 'edited' else 'link' end as kind from s),
c as (select *, lag(kind) over (partition by log order by p) as before from k),
l as (select *, row_number() over (partition by log order by p) + case when sealed and p > {LEGACY} then 1 else 0 end as line,
  sealed or coalesce(sum(case when kind in ('link', 'edited') then 1 else 0 end) over (partition by log order by p rows between unbounded preceding and 1 preceding), 0) > 0 as tip from c where kind <> 'lost')
select log, line, 'content changed' as problem from l where kind = 'edited' union all select log, line, 'unreadable' from l where kind = 'torn' and tip
union all select log, line, 'not part of the chain' from l where kind = 'bare' and tip union all select log, line, 'no chain start before it' from l where kind in ('link', 'edited') and not tip
union all select log, line, 'does not point to the entry before it' from l where kind in ('link', 'edited') and tip and before in ('lost', 'torn', 'bare')
union all select log, {LEGACY + 1}, case log % 4 when 1 then 'sealed lines changed' else 'seal altered' end from s where log % 4 in (1, 2) and p = {LEGACY + 1}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Events as log files with a sealed beginning, a file each, read back byte by byte and verified."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / LOG).alias("log"), "event_id", "event_type")
    lines = e.groupBy("log").applyInPandas(_sealed_log, "log long, line long, value string")
    path = f"{Staging(spark, 'logs').root}/logs"
    lines.repartition("log").sortWithinPartitions("log", "line").select("log", "value").write.option("lineSep", "\n").partitionBy("log").text(path)
    read = raw_lines(spark, path).withColumn("log", F.regexp_extract("log", r"/log=(\d+)/", 1).cast("long"))
    return seals.verify_log(read)


@query("sc07_sqlite_tables", "select c_custkey as id, c_name as name, c_acctbal as balance, c_mktsegment as kind, o.n as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) o on o_custkey = c_custkey where c_custkey >= 40 and c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Customers and orders as SQLite files, read by ranges of row ids with filters in the files, and joined."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    root = Staging(spark, "sqlite").root
    customers = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_mktsegment").alias("kind"))
    sqlite.write_sqlite(customers, f"{root}/customers", "entities").count()
    sqlite.write_sqlite(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer")), f"{root}/orders", "orders").count()
    entities = sqlite.read_sqlite(spark, f"{root}/customers", "entities", "id long, name string, balance double, kind string", rowids=1000)
    orders = sqlite.read_sqlite(spark, f"{root}/orders", "orders", "customer long", rowids=10_000)
    counted = orders.groupBy(F.col("customer").alias("id")).agg(F.count(F.lit(1)).alias("orders"))
    return entities.where("id >= 40").where(F.col("kind").isin("BUILDING", "MACHINERY")).join(counted, "id", "left")


_LETTERS = "translate({}::varchar, '0123456789', 'abcdefghij')"


def _letters(c) -> F.Column:
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


@query("sc14_headed_boards", f"""with o as (select o_custkey, o_orderkey, o_orderstatus, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select o_custkey::varchar as doc, 'Firm ' || {_LETTERS.format('o_custkey')} as company, (n + 6)::int as line, 'Ann ' || {_LETTERS.format('o_orderkey')} as person, 'Seat ' || o_orderstatus as role, 'table' as form from o where o_custkey % 3 > 0
union all select o_custkey::varchar, 'Hub Inc', 1, 'Bea Birch', 'board member (claimed)', 'pair' from o where n = 1
union all select o_custkey::varchar, unnest(['A' || {_LETTERS.format('o_custkey')} || ', Inc.', 'B Corp']), 1, 'Bea Birch', 'claimed link', 'pair' from o where n = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A text a customer: a claimed link between boards, and a table of people under a heading that names a firm or does not."""
    o, key = table(spark, d, "orders"), F.col("o_custkey")
    row = F.struct("o_orderkey", F.concat(F.lit("| **Ann "), _letters(F.col("o_orderkey")), F.lit("** (since 2001) | Seat "), F.col("o_orderstatus"), F.lit(" |")).alias("row"))
    firm = F.concat(F.lit("Firm "), _letters(key))
    lines = F.array(
        F.concat(F.lit("- **A"), _letters(key), F.lit(", Inc. & B Corp:** Connected solely through **Bea Birch (b. 1950)** on the **Hub Inc** board")),
        F.concat(F.lit("## 3. "), F.when(key % 3 == 0, F.concat(firm, F.lit(" leadership"))).otherwise(firm), F.lit(" (NYSE) - **Board of Directors**")),
        F.lit("| not | a table |"), F.lit("words between"), F.lit("| Director name | Role |"), F.lit("|:---|---|"),
    )
    texts = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    texts = texts.select(key.cast("string").alias("doc"), F.array_join(F.concat(lines, F.transform("rows", lambda x: x["row"]), F.array(F.lit("| Total | 12 |"), F.lit("end"))), "\n").alias("text"))
    tables = markdown.headed_tables(texts).select("doc", "company", "line", "person", "role", F.lit("table").alias("form"))
    return tables.unionByName(markdown.linked_pairs(texts).withColumn("form", F.lit("pair")))


@query("rp02_report_blocks", """with o as (select o_custkey, o_orderkey, o_orderstatus from orders),
g as (select o_custkey, string_agg('| ' || o_orderkey || ' | [' || o_orderstatus || '](https://x.org/' || o_orderkey || ') |', chr(10) order by o_orderkey) as md, string_agg('<tr><td>' || o_orderkey || '</td><td><a href="https://x.org/' || o_orderkey || '" rel="noopener noreferrer">' || o_orderstatus || '</a></td></tr>', '' order by o_orderkey) as rows from o group by 1)
select o_custkey::varchar as doc, '# Orders of <' || o_custkey || '>' || chr(10) || chr(10) || 'All **orders** & more than one line.' || chr(10) || chr(10) || '- first item goes on' || chr(10) || '- second' || chr(10) || chr(10) || '| Key | State |' || chr(10) || '|---|---|' || chr(10) || md || chr(10) as markdown,
  '<h1>Orders of &lt;' || o_custkey || '&gt;</h1><p>All <b>orders</b> &amp; more than one line.</p><ul><li>first item goes on</li><li>second</li></ul><table><thead><tr><th>Key</th><th>State</th></tr></thead><tbody>' || rows || '</tbody></table>' as html, true as same from g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A report a customer, loosely written: as blocks, as Markdown and as HTML; the Markdown's blocks are the same again."""
    key = F.col("o_orderkey").cast("string")
    row = F.struct("o_orderkey", F.concat(F.lit("|"), key, F.lit("|["), F.col("o_orderstatus"), F.lit("](https://x.org/"), key, F.lit(")|")).alias("row"))
    texts = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    head = F.concat(F.lit("#Orders of <"), F.col("o_custkey").cast("string"), F.lit(">\nAll **orders** & more\nthan one line.\n- first item\n    goes on\n- second\n| Key | State |\n|:--|--:|\n"))
    texts = texts.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(head, F.array_join(F.transform("rows", lambda x: x["row"]), "\n")).alias("text"))
    st = Staging(spark, "reports")
    parsed = st.write(blocks.to_blocks(texts), "blocks")
    written = st.write(blocks.to_markdown(parsed), "markdown")
    again = blocks.to_markdown(blocks.to_blocks(written, "doc", "markdown")).select("doc", F.col("markdown").alias("again"))
    return written.join(blocks.to_html(parsed), "doc").join(again, "doc", "left").select("doc", "markdown", "html", F.col("markdown").eqNullSafe(F.col("again")).alias("same"))


@query("sc09_landed_pages", "select o_orderkey::varchar as uuid, 2 as version, o_totalprice as amount from orders where o_orderkey % 3 = 0 union all select o_orderkey::varchar, 1, o_totalprice from orders where o_orderkey % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Orders as landed pages in which every third record comes again, newer and on another page."""
    o = table(spark, d, "orders")
    record = lambda version: (F.col("o_orderkey").cast("string").alias("uuid"), F.lit(version).alias("version"), F.col("o_totalprice").cast("double").alias("amount"))
    path = f"{Staging(spark, 'pages').root}/pages"
    o.select(*record(1)).unionByName(o.where("o_orderkey % 3 = 0").select(*record(2))).write.json(path)
    return files.read_json_pages(spark, path, "uuid string, version int, amount double", "uuid")


@query("sc16_front_matter", "select c_custkey::varchar as doc, c_name as title, case when c_custkey % 2 = 0 then 'true' else 'false' end as live, 'a, ' || c_mktsegment as tags from customer where c_custkey % 5 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Notes with a block of keys before their text, every fifth without."""
    c = table(spark, d, "customer")
    live = F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("no")
    block = F.concat(F.lit("---\ntitle: \""), F.col("c_name"), F.lit("\"\nlive: "), live, F.lit("\ntags:\n  - a\n  - "), F.col("c_mktsegment"), F.lit("\n---\nnote"))
    notes = c.select(F.col("c_custkey").cast("string").alias("doc"), F.when(F.col("c_custkey") % 5 != 0, block).otherwise("note").alias("text"))
    keys = notes.select("doc", files.front_matter("text").alias("k")).where("k is not null")
    return keys.select("doc", F.col("k")["title"].alias("title"), F.col("k")["live"].alias("live"), F.col("k")["tags"].alias("tags"))
