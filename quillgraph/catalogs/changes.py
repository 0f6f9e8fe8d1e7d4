"""Batches, filings, claims, patterns, reports and sources over the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from quillgraph.catalogs.identity import _cases, _cases_sql
from quillgraph.operators import audit, changes, claims, identity, integrity, patterns, records, review, textlint
from quillgraph.plans.graph import STANDARDS
from quillgraph.plans.staging import Staging
from quillgraph.sources import markdown
from quillgraph.sources.tables import AS_OF, graph_sql, live_graph, load_graph, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
BASE = graph_sql()


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _id(c: str):
    return F.col(c).cast("string")


@query("id09_batch_outcomes", """with cand as (select o_orderkey::varchar as edge_id, 'C' || o_custkey as source, case when o_orderkey % 11 = 0 then 'C' || o_custkey when o_orderkey % 13 = 0 then 'N99' else 'N' || (o_custkey % 25) end as target, o_orderstatus as relationship_type from orders),
held as (select distinct source, target, relationship_type from cand where edge_id::bigint % 5 = 0 and source <> target), fresh as (select edge_id, source, target, relationship_type from cand),
e as (select f.*, h.source is not null as there, f.source <> f.target and f.target <> 'N99' as good from fresh f left join held h using (source, target, relationship_type)),
first as (select source, target, relationship_type, min(edge_id) as first from e where good and not there group by all)
select 'edge' as kind, edge_id as id, case when there then 'already_present' when not good then 'rejected' when edge_id = first.first then 'added' else 'already_present' end as outcome from e left join first using (source, target, relationship_type)
union all select 'node', 'C' || c_custkey, case when c_custkey % 2 = 0 then 'already_present' else 'added' end from customer union all select 'node', 'N' || n_nationkey, 'added' from nation union all select 'node', 'R' || r_regionkey, 'rejected' from region""")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    target = F.when(F.col("o_orderkey") % 11 == 0, name("C", F.col("o_custkey"))).when(F.col("o_orderkey") % 13 == 0, "N99").otherwise(name("N", F.col("o_custkey") % 25))
    e = o.select(_id("o_orderkey").alias("edge_id"), name("C", F.col("o_custkey")).alias("source"), target.alias("target"), F.col("o_orderstatus").alias("relationship_type"))
    old = c.where("c_custkey % 2 = 0").select(name("C", F.col("c_custkey")).alias("id"), F.col("c_name").alias("label"))
    new = c.select(name("C", F.col("c_custkey")).alias("id"), F.col("c_name").alias("label")).unionByName(table(spark, d, "nation").select(name("N", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"))).unionByName(table(spark, d, "region").select(name("R", F.col("r_regionkey")).alias("id"), F.lit(" ").alias("label")))
    return changes.apply_batch(old, e.where("edge_id % 5 = 0 and source <> target"), new, e)


@query("id12_merged_filings", """with f as (select o_custkey::varchar as src, l_suppkey::varchar as dst, l_returnflag as relation, l_linestatus as qualifier, o_orderpriority as source, l_shipdate::date as filing_date, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_extendedprice as evidence_url, (l_discount * 100)::int as percent
  from lineitem join orders on o_orderkey = l_orderkey)
select sha256(src || '|' || dst || '|' || relation || '|' || qualifier || '|' || string_split(source, ' ')[1]) as dedupe_key, src, dst, relation, qualifier, min(filing_date)::varchar as first_seen, max(filing_date)::varchar as last_seen, count(*) as filings,
  max_by(percent, {'a': filing_date, 'b': evidence_url}) as percent, max_by(source, {'a': filing_date, 'b': evidence_url}) as source, max_by(evidence_url, {'a': filing_date, 'b': evidence_url}) as evidence_url
from f where src <> dst group by src, dst, relation, qualifier, string_split(source, ' ')[1]""")
def _(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    url = F.concat_ws("-", _id("l_orderkey"), _id("l_linenumber"), _id("l_partkey"), _id("l_extendedprice"))
    f = l.select(_id("o_custkey").alias("src"), _id("l_suppkey").alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("qualifier"), F.col("o_orderpriority").alias("source"), F.to_date("l_shipdate").alias("filing_date"), url.alias("evidence_url"), F.round(F.col("l_discount") * 100).cast("int").alias("percent"))
    return changes.merged_filings(f, facts=("percent",)).withColumns({"first_seen": _id("first_seen"), "last_seen": _id("last_seen")})


@query("id20_consolidated_nodes", BASE + """, m as (select id, 'PER_' || (substr(id, 5)::bigint // 5 * 5) as into_ from nodes where entity_type = 'PERSON' and substr(id, 5)::bigint % 5 = 3),
e as (select edge_id, source, target, relationship_type, m.into_ from edges left join m on m.id = source)
select edge_id, source, target, relationship_type, case when into_ is not null then edge_id || '~' end as superseded_by from e union all select edge_id || '~', into_, target, relationship_type, null from e where into_ is not null""")
def _(spark, d):
    g = load_graph(spark, d)
    k = F.substring("id", 5, 20).cast("long")
    merged = g.persons().where(k % 5 == 3).select("id", F.concat(F.lit("PER_"), (k - k % 5).cast("string")).alias("into"))
    return changes.consolidated(g.edges.select("edge_id", "source", "target", "relationship_type", F.lit(None).cast("string").alias("superseded_by")), merged)


@query("id22_confirmed_keys", "select o_orderkey::varchar as key, o_orderstatus from orders where o_orderkey % 4 = 0")
def _(spark, d):
    o = table(spark, d, "orders")
    mark = F.when(F.col("o_orderkey") % 4 == 0, "x").when(F.col("o_orderkey") % 4 == 1, " ").otherwise("y")
    line = F.concat(F.lit("- ["), mark, F.lit("] match `"), _id("o_orderkey"), F.lit("` found"))
    notes = o.groupBy(F.col("o_custkey").alias("note")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return changes.confirmed(o.select(_id("o_orderkey").alias("key"), "o_orderstatus"), notes)


@query("id19_accepted_people", "select c_custkey as id, case when c_custkey % 3 = 0 then 'address' else 'career' end as basis from customer where c_custkey % 3 = 0 or c_custkey % 5 = 0")
def _(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    address = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("1 Road, "), F.lower("n_name"), F.lit(" City"))).otherwise("elsewhere")
    text = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("worked at "), F.col("c_mktsegment"))).otherwise("")
    return changes.accepted(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), text.alias("text"), address.alias("address"), F.array("n_name", F.lit("")).alias("places"), F.array(F.lower("c_mktsegment")).alias("employers")))


@query("pj09_minted_ids", """with s as (select c_custkey as key, 'ENT_' || replace(n_name, ' ', '_') as slug from customer join nation on n_nationkey = c_nationkey), n as (select *, row_number() over (partition by slug order by key) + case when slug like '%3' then 1 else 0 end as nth from s)
select key, case when nth = 1 then slug else slug || '_' || nth end as id from n""")
def _(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    # Labels end in a letter here, so that a number at the end of an id is its own.
    label = F.concat(F.lit("x "), F.col("n_name"), F.lit(" y"))
    taken = n.where("n_name like '%3'").select(F.concat(F.lit("ENT_X_"), F.upper("n_name"), F.lit("_Y")).alias("id"))
    out = changes.minted_ids(c.select(F.col("c_custkey").alias("key"), label.alias("label")), taken)
    return out.select("key", F.regexp_replace(F.regexp_replace("id", "^ENT_X_", "ENT_"), "_Y(?=_[0-9]+$|$)", "").alias("id"))


@query("pj10_next_edge_ids", """with l as (select max(o_orderkey) as last from orders where o_orderstatus = 'F'), n as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as n from orders where o_orderstatus = 'O')
select o_orderkey, 'EDGE_' || case when length((last + n)::varchar) >= 3 then (last + n)::varchar else lpad((last + n)::varchar, 3, '0') end as edge_id from n, l""")
def _(spark, d):
    o = table(spark, d, "orders")
    known = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("EDGE_"), _id("o_orderkey")).alias("edge_id"))
    return changes.with_next_ids(o.where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), known, "o_orderdate", "o_orderkey").select("o_orderkey", "edge_id")


@query("pj11_known_aliases", "select p_partkey as id, p_name || ' works' as alias from part union all select p_partkey, 'Old ' || p_name from part where p_partkey % 2 = 0 union all select p_partkey, upper('old ' || p_name) from part where p_partkey % 2 = 1")
def _(spark, d):
    p = table(spark, d, "part")
    turned = F.concat_ws(", ", F.element_at(F.split("p_name", " "), -1), F.element_at(F.split("p_name", " "), 1))
    forms = F.array(F.upper(turned), F.upper(F.concat("p_name", F.lit(" works"))), F.concat("p_name", F.lit(" works")), F.upper(F.concat(F.lit("old "), "p_name")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Old "), "p_name")), F.lit(""))
    return identity.known_aliases(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), p.select(F.col("p_partkey").alias("id"), F.explode(forms).alias("alias")))


@query("id15_earlier_surnames", "select c_custkey as id, 'old' || lower(replace(n_name, '_', '')) as surname from customer join nation on n_nationkey = c_nationkey where c_custkey % 3 = 0 and c_custkey % 2 = 0")
def _(spark, d):
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    last = F.regexp_replace("n_name", "_", "")
    people = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("Ann "), last).alias("name"), F.create_map(F.lit("sec_cik"), F.when(F.col("c_custkey") % 3 == 0, _id("c_custkey")).otherwise("")).alias("ids"))
    aliases = c.select(F.col("c_custkey").alias("id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "Ann Old").otherwise("Bea Old"), last).alias("alias")).unionByName(c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("A. "), last).alias("alias")))
    return identity.earlier_surnames(people, aliases)


@query("jn15_by_any_identifier", "select c_custkey as key, 'node' || case when c_custkey % 4 = 0 then c_custkey + 1000000 else c_custkey end as id from customer where c_custkey % 5 > 0")
def _(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 5 > 0")
    wanted = c.select(F.col("c_custkey").alias("key"), F.explode(F.array(F.struct(F.lit("a").alias("scheme"), _id("c_custkey").alias("value")), F.struct(F.lit("b").alias("scheme"), _id("c_custkey").alias("value")))).alias("i")).select("key", "i.*")
    node = lambda n: F.concat(F.lit("node"), n.cast("string"))
    held = c.select(node(F.col("c_custkey")).alias("id"), F.lit("a").alias("scheme"), _id("c_custkey").alias("value")).unionByName(c.select(node(F.col("c_custkey") + 1000000).alias("id"), F.lit("b").alias("scheme"), _id("c_custkey").alias("value")))
    return identity.by_any_identifier(wanted, held, c.where("c_custkey % 4 = 0").select(node(F.col("c_custkey")).alias("id")))


@query("pt01_boardroom_after_office", BASE + """, office as (select id, 1990 + substr(id, 5)::bigint % 15 as left_, substr(id, 5)::bigint % 3 = 0 as gone from nodes where entity_type = 'PERSON' and substr(id, 5)::bigint % 2 = 0)
select distinct source as person, target as org, left_::int as "left", year(first_filing)::int as first, case when year(first_filing) >= left_ then (year(first_filing) - left_)::int end as years from live join office on office.id = source where gone and relationship_type <> 'BENEFICIAL_OWNER_OF'""")
def _(spark, d):
    g = load_graph(spark, d)
    k = F.substring("id", 5, 20).cast("long")
    offices = g.persons().where(k % 2 == 0).select(F.col("id").alias("person"), (k % 3 != 0).alias("active"), F.concat(F.lit("Senator (1980-"), (1990 + k % 15).cast("string"), F.lit(")")).alias("title"))
    return patterns.boardroom_after_office(offices, g.of("DIRECTOR_OF", "OFFICER_OF", "TEN_PERCENT_OWNER_OF").select(F.col("source").alias("person"), F.col("target").alias("org"), "active", "first_filing"))


LAWMAKERS = ("Ann Alder", "Bob Birch", "Cora Cedar", "Dan Dogwood", "Eva Elm")


@query("pt03_lobbyist_links", f"""with o as (select o_orderkey, o_custkey, (o_orderkey % 5 + 1)::int as k, o_orderkey % 4 as form, 'Client ' || (o_custkey % 7) as client, o_custkey % 7 as c from orders)
select distinct 'P' || o_custkey as person, 'L' || k as lawmaker, 'C' || c as client, 'COM' || k as committees from o where form < 3 and (k + c) % 3 = 0 and case when form = 1 then k <= 3 when form = 2 then k > 3 else true end""")
def _(spark, d):
    """Positions name lawmakers by surname, by senator's or representative's title, with short first names, or not at all."""
    o = table(spark, d, "orders")
    k = (F.col("o_orderkey") % 5).cast("int")
    pick = lambda values: F.array(*[F.lit(v) for v in values])[k]
    title = pick(["Senator", "Sen.", "Senator", "Rep.", "Congresswoman"])
    full = pick(["Ann Q. Alder", "Robert Birch", "Cora Cedar Jr.", "Daniel Dogwood", "Eva Elm"])
    other = F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("Chief, Senator "), pick([n.split()[1] for n in LAWMAKERS]))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Rep. "), pick([n.split()[1] for n in LAWMAKERS])))
    position = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Aide to "), title, F.lit(" "), full)).when(F.col("o_orderkey") % 4 == 3, "Senator Committee staff").otherwise(other)
    client = F.concat(F.lit("Client "), (F.col("o_custkey") % 7).cast("string"))
    edges = o.select(_id("o_orderkey").alias("edge_id"), F.concat(F.lit("P"), _id("o_custkey")).alias("person"), F.concat(F.lit("lobbies for "), client, F.lit("; former position (disclosed): "), position).alias("role_title"))
    makers = spark.createDataFrame([(f"L{i + 1}", n, "senator" if i < 3 else "representative") for i, n in enumerate(LAWMAKERS)], "id string, name string, chamber string")
    seats = spark.createDataFrame([(f"L{i}", f"COM{i}") for i in range(1, 6)], "lawmaker string, committee string")
    committees = spark.createDataFrame([(f"COM{i}", [f"DOM_{i % 3}"]) for i in range(1, 6)], "committee string, domains array<string>")
    orgs = spark.createDataFrame([(f"C{c}", f"Client {c}", [f"DOM_{-c % 3}"]) for c in range(7)], "id string, label string, domains array<string>")
    return patterns.lobbyist_links(edges, makers, seats, committees, orgs)


@query("pt05_signals_of_entities", "select 'C' || o_custkey as entity, o_orderkey as key, o_orderstatus as type from orders where o_custkey % 10 = 0")
def _(spark, d):
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("type"), F.array(F.concat(F.lit("C"), _id("o_custkey")), F.lit("other"), F.concat(F.lit("C"), _id("o_custkey"))).alias("subjects"))
    return patterns.signals_of(s, table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("C"), _id("c_custkey")).alias("id")))


@query("cl02_board_tables", f"""with t as (select o_orderkey as row, o_orderkey % 4 as kind, o_custkey % 6 as who, o_orderkey % 4 = 0 as pulled, o_custkey % 9 as p from orders)
select row, case kind when 0 then 'INGESTED' when 1 then 'NOT_INGESTED' when 2 then 'NO_SEC_COVERAGE' else 'UNRESOLVED_TABLE' end as company_status,
  case kind when 0 then case who when 0 then 'CONFIRMED' when 1 then 'CONFLICT' when 2 then 'CONFLICT' when 3 then 'AMBIGUOUS' else 'NOT_IN_FILINGS' end when 1 then 'NOT_INGESTED' when 2 then 'NO_SEC_COVERAGE' else 'UNRESOLVED_TABLE' end as status from t""")
def _(spark, d):
    o = table(spark, d, "orders")
    company = F.when(F.col("o_orderkey") % 4 == 0, "Alpha Works, Inc.").when(F.col("o_orderkey") % 4 == 1, "Beta Mills").when(F.col("o_orderkey") % 4 == 2, "Gamma Farms").otherwise("X")
    person = F.array(*[F.lit(n) for n in ("Mike Osei", "Ann Lund", "Bea Moe", "Cy Poe", "Unknown Person", "Single")])[(F.col("o_custkey") % 6).cast("int")]
    filers = spark.createDataFrame(
        [("A", 1, "Michael J. Osei", "2001-10-01", 1), ("A", 1, "Michael Osei", "1999-10-01", 0), ("A", 2, "Ann Lund", "1999-01-01", 1), ("A", 3, "Bea Moe", "2001-10-01", 0), ("A", 4, "Cy Poe", "2001-10-01", 1), ("A", 5, "Cy B. Poe", "2001-10-01", 1)],
        "org string, person_id long, name string, last_seen string, is_current int",
    ).withColumn("last_seen", F.to_date("last_seen"))
    return claims.check_boards(
        o.select(F.col("o_orderkey").alias("row"), company.alias("company"), person.alias("person")), spark.createDataFrame([("A", "ALPHA WORKS CORP")], "org string, label string"), filers,
        spark.createDataFrame([("Beta Mills Ltd",), ("Alpha Works",)], "label string"), F.lit(AS_OF).cast("date"),
    )


@query("cl03_master_claims", BASE + """, c as (select edge_id as claim_id, source, target, ('0x' || substr(md5(edge_id), 1, 6))::bigint % 4 as k from live where source like 'PER%')
select claim_id, case k when 0 then 'CONFIRMED' when 1 then 'ORG_NOT_FOUND' when 2 then 'PERSON_NOT_FOUND' else case when exists (select 1 from live l where l.source = c.source and l.target = 'ORG_1') then 'CONFIRMED' else 'NO_EDGE' end end as status from c""")
def _(spark, d):
    """Claims made of live edges: as they are, with another organisation, another person, or at the first supplier.

    Labels are turned into names: each person's is two words of its number in letters."""
    g = live_graph(spark, d)
    letters = lambda c: F.translate(F.regexp_extract(c, r"([0-9]+)$", 1), "0123456789", "abcdefghij")
    person, org = lambda c: F.concat(F.lit("Ann x"), letters(c)), lambda c: F.concat(F.lit("Firm "), letters(c), F.lit(" Inc"))
    nodes = g.nodes.select("id", "entity_type", F.when(F.col("entity_type") == "PERSON", person(F.col("id"))).otherwise(org(F.col("id"))).alias("label"))
    k = F.conv(F.substring(F.md5(F.col("edge_id").cast("binary")), 1, 6), 16, 10).cast("long") % 4
    e = g.edges.where("source like 'PER%'")
    c = e.select(F.col("edge_id").alias("claim_id"), F.when(k == 2, "Zoe Nobody").otherwise(person(F.col("source"))).alias("person"), F.when(k == 1, "Firm unknown").when(k == 3, org(F.lit("ORG_1"))).otherwise(org(F.col("target"))).alias("org"))
    return claims.check_master(c, nodes, g.edges)


@query("jn13_contained_names", "select p_partkey, w.word from part, (select distinct string_split(p_name, ' ')[1] as word from part) w where contains(p_name, w.word)")
def _(spark, d):
    p = table(spark, d, "part")
    return records.contained_names(p.select("p_partkey", "p_name"), "p_name", p.select(F.element_at(F.split("p_name", " "), 1).alias("word")).distinct(), "word").select("p_partkey", "word")


@query("id01_identity_index", "select 'lei' as scheme, (c_custkey // 2)::varchar as value, min(c_custkey) as id, count(*) as holders from customer where c_custkey % 7 > 0 group by c_custkey // 2")
def _(spark, d):
    c = table(spark, d, "customer")
    ids = c.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("lei"), F.floor(F.col("c_custkey") / 2).cast("string"), F.lit("none"), F.lit("")).alias("identity"), (F.col("c_custkey") % 7 == 0).alias("merged"))
    return identity.index_of(ids)


@query("id16_surname_changes", "select 2 * k as a, 2 * k + 1 as b, 1::bigint as shared from (select distinct c_custkey // 2 as k from customer where c_custkey % 2 = 1) where k % 3 = 0")
def _(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "customer").select((F.col("c_custkey") - F.col("c_custkey") % 2).alias("even"), (F.col("c_custkey") % 2).alias("odd")).where("odd = 1"), F.col("c_custkey") - F.col("c_custkey") % 2 == F.col("even"))
    half = F.translate(F.floor(F.col("c_custkey") / 2).cast("string"), "0123456789", "abcdefghij")
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Ann q"), half)).otherwise(F.concat(F.lit("Ann Q"), half, F.lit(" New"), half))
    people = c.select(F.col("c_custkey").alias("id"), name.alias("name"))
    ties = c.select(F.col("c_custkey").alias("person"), F.when(F.floor(F.col("c_custkey") / 2) % 3 == 0, half).otherwise(_id("c_custkey")).alias("org"))
    return identity.surname_change_pairs(people, ties)


@query("id17_retyped_persons", "select p_partkey::varchar as id, p_name || case when p_partkey % 3 = 0 then ' Capital' when p_partkey % 3 = 1 then ' LLC' else '' end as label from part where p_partkey % 3 < 2 and p_partkey % 2 = 0")
def _(spark, d):
    p = table(spark, d, "part")
    return identity.retyped(p.select(_id("p_partkey").alias("id"), F.concat("p_name", _cases(F.col("p_partkey"), (" Capital", " LLC", ""))).alias("label"), F.when(F.col("p_partkey") % 2 == 0, "PERSON").otherwise("ORGANIZATION").alias("entity_type")))


@query("id18_resolved_people", """select c_custkey as claim, case when c_custkey % 4 < 3 then c_custkey end as id, case when c_custkey % 4 = 0 then 'high' when c_custkey % 4 = 1 then case when c_custkey % 3 = 0 then 'high' else 'name_only' end when c_custkey % 4 = 2 then case when c_custkey % 3 = 0 then 'high' else 'name_only' end else 'unlinked' end as confidence from customer""")
def _(spark, d):
    """Names unique to each customer; one kind has the filed city, one a bare initial, one no person at all."""
    c = table(spark, d, "customer")
    last = F.concat(F.lit("q"), F.translate(_id("c_custkey"), "0123456789", "abcdefghij"))
    k = F.col("c_custkey") % 4
    claimed = c.select(F.col("c_custkey").alias("id"), F.concat(F.when(k == 2, "A. ").otherwise("Ann "), last).alias("name"), F.when(k == 0, "Oslo ").when(k == 2, "Oslo").alias("city"), (F.col("c_custkey") % 3 == 0).alias("backed"))
    people = c.where("c_custkey % 4 < 3").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Ann "), last).alias("name"), F.lit("OSLO, NO").alias("city"))
    return identity.resolve_people(claimed, people)


@query("id14_same_person", """with k as (select distinct c_custkey // 2 as k from customer where c_custkey % 2 = 1) select 2 * k as a, 2 * k + 1 as b, 'first_last' as match, case when k % 3 = 0 and k % 5 > 0 then 'merge' else 'held' end as decision, case when k % 2 = 0 and k % 5 > 0 then 2 * k else 2 * k + 1 end as keep from k where k % 5 > 0 or k % 3 = 0""")
def _(spark, d):
    """Pairs of records with one name: sharing an organisation or not; the even record, or the longer odd one, is official;
    every fifth pair has two official ids that differ."""
    c = table(spark, d, "customer")
    k = F.floor(F.col("c_custkey") / 2)
    half = F.concat(F.lit("q"), F.translate(k.cast("string"), "0123456789", "abcdefghij"))
    even = F.col("c_custkey") % 2 == 0
    official = F.when((k % 5 == 0) | F.when(k % 2 == 0, even).otherwise(~even), _id("c_custkey")).otherwise("")
    pair = c.join(c.where("c_custkey % 2 = 1").select(F.floor(F.col("c_custkey") / 2).alias("kk")), k == F.col("kk"))
    people = pair.select(F.col("c_custkey").alias("id"), F.concat(F.when(even, "Bob ").otherwise("Robert "), half).alias("name"), F.create_map(F.lit("sec_cik"), official).alias("ids"))
    ties = pair.select(F.col("c_custkey").alias("person"), F.when(k % 3 == 0, half).otherwise(_id("c_custkey")).alias("org"))
    return identity.same_person(people, ties)


@query("tx04_report_structure", "select o_orderkey as doc, case when o_orderkey % 3 = 0 then '## 5. Limits; All sources' else '' end as missing, (case when o_orderkey % 2 = 0 then 1 else 0 end + case when o_orderkey % 3 = 0 then 1 else 0 end)::int as unlinked from orders")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("Signals for review, not findings of wrongdoing\n## 2. Scope\n## 3. Method\n## 4. Findings\n| What | x |\n| a | [s](http://x) |\n"), F.when(k % 2 == 0, "| b | none |\n").otherwise(""), F.when(k % 3 > 0, "## 5. Limits\n").otherwise("## 5b\n"), F.lit("| c | after |\n## 6. Right of reply\n"), F.when(k % 3 > 0, "All sources").otherwise(""))
    return review.check_structure(table(spark, d, "orders").select(k.alias("doc"), text.alias("text")))


@query("tx05_reply_windows", f"select o_orderkey as doc, 'Acme' as org, case when o_orderkey % 5 = 0 then 'not_contacted' when o_orderkey % 5 = 1 then 'done' when o_orderdate::date <= date '{AS_OF}' - 14 then 'done' else 'waiting' end as status from orders")
def _(spark, d):
    k = F.col("o_orderkey")
    row = F.when(k % 5 == 0, "| Acme | | |").when(k % 5 == 1, "| Acme | 2001-11-03 | no comment |").otherwise(F.concat(F.lit("| Acme | sent "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | |")))
    o = table(spark, d, "orders").select(k.alias("doc"), F.concat(F.lit("## 6. Right of reply\n| Org | Contacted | Response |\n"), row, F.lit("\n## 7. x\n| Acme | x | y |")).alias("text"))
    return review.reply_status(o, o.select("doc", F.lit("Acme").alias("org")), F.lit(AS_OF).cast("date"))


@query("tx07_source_checks", "select o_orderkey as source, case when o_orderkey % 5 = 0 or o_orderkey % 3 = 0 then 'block' when o_orderkey % 2 = 0 then 'warn' else 'ok' end as status from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    text = F.when(k % 5 > 0, F.concat(F.lit("filing "), F.when(k % 3 == 0, "other").otherwise(k.cast("string")), F.lit(" by "), F.when(k % 2 == 0, "nobody").otherwise(F.lpad(F.col("o_custkey").cast("string"), 10, "0"))))
    return review.check_sources(o.select(k.alias("source"), F.concat(F.lit("filing "), k.cast("string")).alias("ref"), text.alias("text")), o.select(k.alias("source"), _id("o_custkey").alias("cik")))


@query("rp04_stale_reviews", "select doc_id as doc from documents where doc_id % 3 > 0")
def _(spark, d):
    x = table(spark, d, "documents")
    reviews = x.select(F.col("doc_id").alias("doc"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("sha256"))
    return review.stale_reviews(reviews, x.where("doc_id % 3 < 2").select(F.col("doc_id").alias("doc"), "text"))


@query("rp05_reports_due", "with r as (select c_custkey as id, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer) select id, rank from r where rank <= 100 and id % 3 > 0")
def _(spark, d):
    from quillgraph.plans.ranks import numbered

    c = table(spark, d, "customer")
    ranked = numbered(c.select(F.col("c_custkey").alias("id"), "c_acctbal"), F.desc("c_acctbal"), "id")
    prints = c.select(F.col("c_custkey").alias("id"), F.sha2(_id("c_custkey"), 256).alias("sha256"))
    return review.reports_due(ranked, prints.withColumn("sha256", F.when(F.col("id") % 3 == 0, F.col("sha256")).otherwise("old")).where("id % 3 < 2"), prints, 100)


@query("rp06_rendered_reports", "select o_custkey as doc, '## Orders' || chr(10) || string_agg(o_orderkey || ' \\| ' || o_orderstatus, chr(10) order by o_orderkey) || chr(10) || chr(10) || '## Total' || chr(10) || count(*) as text from orders where o_custkey % 10 = 0 group by 1")
def _(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 10 = 0")
    rows = o.select(F.col("o_custkey").alias("doc"), F.lit(1).alias("section"), F.lit("Orders").alias("heading"), F.col("o_orderkey").alias("line"), F.concat_ws(" | ", _id("o_orderkey"), "o_orderstatus").alias("text"))
    total = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.lit(2).alias("section"), F.lit("Total").alias("heading"), F.lit(1).cast("long").alias("line"), F.count(F.lit(1)).cast("string").alias("text"))
    return review.rendered(rows.unionByName(total))


@query("ss05_due_again", f"select c_custkey as key from customer left join (select o_custkey, max(o_orderdate::date) as d from orders group by 1) on o_custkey = c_custkey where d is null or date '{AS_OF}' - d > 30")
def _(spark, d):
    done = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"))
    return review.due_again(done, table(spark, d, "customer").select(F.col("c_custkey").alias("key")), F.lit(AS_OF).cast("date"))


@query("au01_chain_verification", """with e as (select event_id as seq, 'log' || (event_id // 12) as shard, event_id % 97 = 0 as altered, event_id % 89 = 0 as gone from events), k as (select *, lag(seq) over (partition by shard order by seq) as before_, lag(gone) over (partition by shard order by seq) as lost from e),
n as (select *, min(seq) filter (not gone) over (partition by shard) as first from k where true)
select shard, seq, 'content changed' as problem from n where altered and not gone union all select shard, seq, 'does not point to the entry before it' from n where not gone and lost and seq <> first""")
def _(spark, d):
    """Chains of a dozen events each; some events altered after they were hashed, some taken out."""
    import json

    import pandas as pd

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = tip = None
        for rows in batches:
            out = []
            for k, at, event in zip(rows["k"], rows["event_id"], rows["event_type"], strict=True):
                if k != chain:
                    chain, tip = k, None
                body = {"event_id": int(at), "event": event, "prev": tip}
                body["hash"] = tip = integrity._sha(integrity.canonical(body, compact=True))
                if at % 97 == 0:
                    body["event"] += " altered"
                if at % 89:
                    out.append((f"log{k}", int(at), json.dumps(body)))
            yield pd.DataFrame(out, columns=["shard", "seq", "raw"])

    e = table(spark, d, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 12).alias("k"))
    # Chains follow one another in a task's rows: a group of its own for each dozen events costs far more than its hashes.
    chains = e.repartition("k").sortWithinPartitions("k", "event_id").mapInPandas(build, "shard string, seq long, raw string")
    return integrity.verify_chain(chains, shard="shard")


@query("au02_missing_anchors", "select event_id as line, md5(event_id::varchar) as tip from events where event_id % 10 = 0 and event_id % 3 = 0")
def _(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.md5(_id("event_id").cast("binary"))).alias("hash"))
    return integrity.missing_anchors(e.where("event_id % 10 = 0").select(F.col("event_id").alias("line"), F.md5(_id("event_id").cast("binary")).alias("tip")), log)


@query("sk04_change_fingerprints", "select o_custkey, count(*) as rows, sha256(count(*) || ':' || sum(('0x' || substr(m, 1, 15))::hugeint) || ':' || sum(('0x' || substr(m, 16, 15))::hugeint)) as sha256 from (select o_custkey, md5(o_orderkey || '|' || o_orderstatus) as m from orders) group by 1")
def _(spark, d):
    return integrity.fingerprint(table(spark, d, "orders"), "o_custkey", ["o_orderkey", "o_orderstatus"])


@query("sc01_graph_documents", BASE + "select edge_id, source, target, relationship_type from edges")
def _(spark, d):
    """The table graph written as JSON documents, a file each, and read again."""
    from quillgraph.sources import graph_json

    e = Staging(spark, "documents").write(load_graph(spark, d).edges.select("edge_id", "source", "target", "relationship_type"), "edges")
    docs = graph_json.documents(e)
    path = f"{Staging(spark, 'json').root}/graph"
    docs.write.partitionBy("shard").json(path)
    return graph_json.read_graph(spark, path, AS_OF).edges.select("edge_id", "source", "target", "relationship_type")


@query("sc08_csv_rows", "select c_custkey::varchar as id, c_name || ' é' as name from customer")
def _(spark, d):
    from quillgraph.sources import files

    path = f"{Staging(spark, 'csv').root}/rows"
    table(spark, d, "customer").select(_id("c_custkey").alias("id"), F.concat("c_name", F.lit(" é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_csv(spark, path, "id string, name string").select("id", "name")


@query("sc13_pipe_tables", "select o_custkey::varchar as doc, 'Orders of ' || o_custkey as heading, o_orderkey::varchar || ',' || o_orderstatus as cells from orders where o_custkey % 5 = 0 union all select distinct o_custkey::varchar, 'Orders of ' || o_custkey, 'Key,Status' from orders where o_custkey % 5 = 0")
def _(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 5 = 0")
    rows = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("| "), _id("o_orderkey"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" |")))), "\n").alias("r"))
    docs = rows.select(_id("o_custkey").alias("doc"), F.concat(F.lit("# Orders of "), _id("o_custkey"), F.lit("\n| Key | Status |\n|---|---|\n"), F.col("r"), F.lit("\nend")).alias("text"))
    return markdown.pipe_tables(docs).select("doc", "heading", F.array_join("cells", ",").alias("cells"))


@query("set02_sector_crossings", BASE + """, two as (select x.source as per, x.target as a, y.target as b from live x join live y on x.source = y.source and x.target < y.target where x.relationship_type = 'DIRECTOR_OF' and y.relationship_type = 'DIRECTOR_OF')
select distinct a || '>' || per || '>' || b as way, array_to_string(list_sort(list_filter(p.domains, lambda d: not list_contains(q.domains, d))), ',') as leaving, array_to_string(list_sort(list_filter(q.domains, lambda d: not list_contains(p.domains, d))), ',') as entering, not list_has_any(p.domains, q.domains) as full_boundary
from two join nodes p on p.id = a join nodes q on q.id = b where list_sort(p.domains) <> list_sort(q.domains)""")
def _(spark, d):
    """Crossings on every way from a board over a director to another board."""
    from quillgraph.operators import paths

    g = live_graph(spark, d)
    s = g.of("DIRECTOR_OF").select(F.col("source").alias("per"), F.col("target").alias("org"), "weight")
    two = s.select("per", F.col("org").alias("a"), F.col("weight").alias("wa")).join(s.select("per", F.col("org").alias("b"), F.col("weight").alias("wb")), "per").where("a < b")
    way = F.concat_ws(">", "a", "per", "b")
    step = lambda pos, node, w: F.struct(F.lit(pos).alias("pos"), node.alias("id"), w.alias("weight"))
    walk = two.select(way.alias("end"), F.explode(F.array(step(0, F.col("a"), F.lit(None).cast("double")), step(1, F.col("per"), F.col("wa")), step(2, F.col("b"), F.col("wb")))).alias("s")).select("end", "s.*")
    return paths.crossings(walk, g).select(F.col("end").alias("way"), "leaving", "entering", "full_boundary").distinct()


@query("id08_graph_audit", """with n as (select c_custkey, c_custkey % 4 as k, c_custkey % 3 as z from customer), e as (select *, o_orderkey % 6 as k from orders),
live as (select * from e where k <> 0)
select 'node' as kind, c_custkey::varchar as id, 'Identity' as core, 'error' as severity, 'no canonical identifier' as message from n where k = 1 union all
select 'node', c_custkey::varchar, 'Identity', 'error', 'not valid: sec_cik' from n where k = 2 union all select 'node', c_custkey::varchar, 'Identity', 'warning', 'unknown domain DOM_X' from n where z = 0 union all
select 'edge', o_orderkey::varchar, 'Integrity', 'resolved', 'replaced by next' from e where k = 0 union all select 'edge', o_orderkey::varchar, 'Identity', 'error', 'target is no node: nobody' from live where k = 1 union all
select 'edge', o_orderkey::varchar, 'Transparency', 'warning', 'cites in free text: Form 4' from live where k = 2 union all select 'edge', o_orderkey::varchar, 'Transparency', 'error', 'no accepted source type' from live where k = 3 union all
select 'edge', o_orderkey::varchar, 'Transparency', 'warning', 'missing citation_url, source_reference' from live where k = 4 union all select 'edge', o_orderkey::varchar, 'Integrity', 'error', 'weight missing or out of range' from live where k = 5 union all
select 'edge', o_orderkey::varchar, 'Integrity', 'error', 'edited after it was recorded' from live where o_custkey % 2 = 0 union all select 'edge', o_orderkey::varchar, 'Integrity', 'info', 'no verification hash' from live where o_custkey % 2 = 1""")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    k, e = F.col("c_custkey"), F.col("o_orderkey") % 6
    nodes = c.select(_id("c_custkey").alias("id"), F.when(k % 3 == 0, F.array(F.lit("DOM_A"), F.lit("DOM_X"))).otherwise(F.array(F.lit("DOM_A"))).alias("domains"))
    ids = c.where(k % 4 != 1).select(_id("c_custkey").alias("id"), F.lit("sec_cik").alias("scheme"), F.when(k % 4 == 2, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.lpad(k.cast("string"), 10, "0")).alias("value"))
    edges = o.select(
        _id("o_orderkey").alias("id"), _id("o_custkey").alias("source"), F.when(e == 1, "nobody").otherwise(_id("o_custkey")).alias("target"), F.when(e == 0, "next").alias("superseded_by"),
        F.when(e == 2, "see form 4 of May").when(e == 3, "hearsay").otherwise("Form 4").alias("verification_source"), F.when(e == 4, "").otherwise("https://x").alias("citation_url"), F.lit("2001-01-01").alias("document_date"),
        F.when(e != 4, "r").alias("source_reference"), F.when(e == 5, 1.5).otherwise(0.5).alias("weight"), F.when(F.col("o_custkey") % 2 == 0, "h").alias("hash"), F.lit("g").alias("real_hash"),
    )
    return audit.audit(nodes, ids, edges, ["DOM_A"], ["Form 4"])


@query("au05_evidence_gaps", "select o_orderkey as edge_id, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'no evidence,undated' when o_orderkey % 3 = 0 then 'no evidence' else 'undated' end as gaps from orders where o_orderkey % 3 = 0 or o_orderkey % 2 = 0")
def _(spark, d):
    o = table(spark, d, "orders")
    return audit.evidence_gaps(o.select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderkey") % 3 > 0, F.array(F.lit("https://x"))).alias("evidence"), F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderdate")).alias("filing_date"), F.lit(None).cast("string").alias("start_date")))


@query("au03_saved_hashes", "select true as ok")
def _(spark, d):
    """The hash logged last is that of the table in another order."""
    from quillgraph.plans import versions

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    saved = versions.content_hash(o.limit(10)).select(F.lit(1).alias("seq"), "sha256").unionByName(versions.content_hash(o.repartition(5)).select(F.lit(2).alias("seq"), "sha256"))
    return versions.graph_matches_log(saved, versions.content_hash(o))


@query("sc03_filtered_edges", "select o_orderkey, json_extract_string(props, '$.k')::bigint as k from orders join events on event_id = o_orderkey where o_orderstatus = 'F' and json_extract_string(props, '$.k')::bigint > 50")
def _(spark, d):
    """Edges by a condition, with their attributes read out of JSON."""
    from quillgraph.sources import tables

    e = table(spark, d, "orders").join(table(spark, d, "events").select("event_id", "props"), F.col("o_orderkey") == F.col("event_id"))
    return tables.edges_where(e, "o_orderstatus = 'F'", "props", {"k": "long"}).where("k > 50").select("o_orderkey", "k")


@query("sc04_by_identifier", "select c_custkey % 3 as k, lpad((c_custkey * 2)::varchar, 10, '0') as value, o.id from customer join (select c_custkey as id from customer) o on o.id = c_custkey * 2")
def _(spark, d):
    c = table(spark, d, "customer")
    pad = lambda x: F.lpad(x.cast("string"), 10, "0")
    wanted = c.select((F.col("c_custkey") % 3).alias("k"), F.lit("sec_cik").alias("scheme"), pad(F.col("c_custkey") * 2).alias("value"))
    return identity.find_by_identifier(wanted, c.select(F.lit("sec_cik").alias("scheme"), pad(F.col("c_custkey")).alias("value"), F.col("c_custkey").alias("id"))).select("k", "value", "id")


@query("sc15_headed_lists", "select o_custkey::varchar as doc, 'Orders of ' || o_custkey as header, 'Order ' || o_orderkey as item, o_orderstatus as role from orders where o_custkey % 5 = 0")
def _(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 5 = 0")
    rows = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- Order "), _id("o_orderkey"), F.lit(": "), F.col("o_orderstatus")))), "\n").alias("r"))
    docs = rows.select(_id("o_custkey").alias("doc"), F.concat(F.lit("intro line\n\nOrders of "), _id("o_custkey"), F.lit(":\n"), F.col("r")).alias("text"))
    return markdown.headed_list(docs).where("header is not null and item is not null").select("doc", "header", "item", "role").where("header like 'Orders%'")


@query("sc17_watchlists", "select o_custkey::varchar as doc, 'sec' as kind, o_orderkey::varchar as arg from orders where o_orderkey % 2 = 0")
def _(spark, d):
    line = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("- sec: "), _id("o_orderkey"))).otherwise(F.concat(F.lit("```\n- sec: "), _id("o_orderkey"), F.lit("\n```")))
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(line), "\n").alias("text")).select(_id("o_custkey").alias("doc"), "text")
    return markdown.watchlist(docs).select("doc", "kind", "arg")


@query("set03_flagged_population", BASE + """, t as (select source as id from live where relationship_type = 'DIRECTOR_OF' and (last_filing - first_filing) / 365.25 > 4 union select target from live where relationship_type = 'DIRECTOR_OF' and (last_filing - first_filing) / 365.25 > 4),
o as (select source as id from live where relationship_type = 'DIRECTOR_OF' and source like 'PER%' group by 1 having count(distinct target) > 3) select id, string_agg(kind, ',' order by kind) as kinds from (select id, 'tenure' as kind from t union all select id, 'overboarding' from o) group by 1""")
def _(spark, d):
    from quillgraph.operators import measures

    g = live_graph(spark, d)
    return measures.flagged({"tenure": measures.long_tenure(g, 4.0).select(F.explode(F.array("person", "org")).alias("id")), "overboarding": measures.overboarding(g, 3, 99).select(F.col("person").alias("id"))})


@query("set07_union_of_pulls", "select o_custkey, o_orderkey, min(o_orderstatus) as status from orders group by 1, 2")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"))
    return records.union_of([o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), o], ["o_custkey", "o_orderkey"])


@query("st07_match_order", "select p_partkey, row_number() over (order by p_partkey % 3, p_size % 2, p_name, p_partkey) as rank from part")
def _(spark, d):
    p = table(spark, d, "part")
    from quillgraph.operators import enforcement

    m = p.select("p_partkey", _cases(F.col("p_partkey"), ("title", "text", "list")).alias("place"), F.when(F.col("p_size") % 2 == 0, "ORGANIZATION").otherwise("PERSON").alias("entity_type"), F.col("p_name").alias("label"))
    return enforcement.ranked_matches(m, "p_partkey").select("p_partkey", "rank")


@query("st08_first_breaks", "select event_id as seq, event_type as problem from events where event_id % 7 = 0 order by event_id limit 50")
def _(spark, d):
    return integrity.first_breaks(table(spark, d, "events").where("event_id % 7 = 0").select(F.lit("log").alias("shard"), F.col("event_id").alias("seq"), F.col("event_type").alias("problem"))).select("seq", "problem")
