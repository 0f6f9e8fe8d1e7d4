"""Identity, validation, staging and tallies over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import labels, predicates
from quillgraph.operators import audit, identity, review, tallies
from quillgraph.plans.staging import Staging
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


def _cases(column, values):
    out = None
    for n, v in enumerate(values):
        out = F.when(column % len(values) == n, v) if out is None else out.when(column % len(values) == n, v)
    return out


def _cases_sql(column, values):
    quoted = ["null" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return "case " + " ".join(f"when {column} % {len(values)} = {n} then {v}" for n, v in enumerate(quoted)) + " end"


SOURCES = ("SEC Form 4", "sec form 3/a", "SEC Form D", "IRS Form 990", "UK Companies House", "SEC Schedule 13G", "SEC 13F-HR", "NIH RePORTER", "newspaper", None, "SEC Form 45")
TYPES = ("Form 3/4/5", "Form 3/4/5", "Form D", "Form 990", "UK Companies House", "Schedule 13D/13G", "13F-HR", "NIH RePORTER Grant ID", None, None, None)


@query("fl07_source_types", f"select {_cases_sql('o_orderkey', TYPES)} as source_type, count(*) as n from orders group by 1")
def _(spark, d):
    o = table(spark, d, "orders").select(_cases(F.col("o_orderkey"), SOURCES).alias("s"))
    return o.groupBy(predicates.source_type(F.col("s")).alias("source_type")).agg(F.count(F.lit(1)).alias("n"))


@query("fl05_recent_filings", f"""select l_orderkey, l_linenumber from lineitem where l_linenumber <> 2 and case when l_quantity > 40 then null else l_shipdate::date end >= date '{AS_OF}' - 456
union all select l_orderkey, l_linenumber from lineitem where l_linenumber <> 2 and l_quantity > 40 and l_quantity < 50 and l_shipdate::date - 30 >= date '{AS_OF}' - 456""")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("day"))
    last, filed = F.when(F.col("l_quantity") <= 40, F.col("day")), F.when(F.col("l_quantity") < 50, F.date_sub("day", 30))
    current = F.when(F.col("l_linenumber") == 2, 0).when(F.col("l_linenumber") == 1, 1)
    return x.where(predicates.is_recent(current, last, filed, F.lit(AS_OF).cast("date"))).select("l_orderkey", "l_linenumber")


NAME_SQL = "trim(array_to_string(regexp_extract_all(line, '[A-Za-z0-9]+'), ' '))"


@query("fl12_name_kinds", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), n as (select doc_id, {NAME_SQL} as name from l), k as (select doc_id, name, len(string_split(name, ' ')) as words from n where name <> ''),
j as (select doc_id, regexp_matches(name, '(?i)\\b(""" + "|".join(predicates.ORG_WORDS) + """)\\b') as org, (words between 2 and 6 and not regexp_matches(name, '(?i)\\b(""" + "|".join(predicates.NOT_NAMES) + """)\\b')
  and not regexp_matches(name, '[0-9]') and length(string_split(name, ' ')[-1]) > 1) as person from k)
select doc_id, count(*) as lines, count(*) filter (org) as orgs, count(*) filter (person) as persons from j group by 1""")
def _(spark, d):
    """Every line of every document, taken as a name."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = lines.select("doc_id", F.array_join(F.regexp_extract_all("line", F.lit("[A-Za-z0-9]+"), 0), " ").alias("name")).where("name <> ''")
    k = n.select("doc_id", predicates.looks_like_org(F.col("name")).alias("org"), predicates.plausible_person(F.col("name")).alias("person"))
    return k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("org"), 1)).alias("orgs"), F.count(F.when(F.col("person"), 1)).alias("persons"))


FORMS = (" Inc.", " & Sons, LLC", " (UK) Holdings", " Global Foods Group", "/DE/", " Co. Ltd", " The N.A. Trust")
KEYS = ("", " and sons", "", " global foods", "", "", " n a trust")


@query("sf10_org_keys", f"select s_suppkey, trim(lower(replace(s_name, '#', ' ')) || {_cases_sql('s_suppkey', KEYS)}) as key from supplier")
def _(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", labels.org_key(F.concat("s_name", _cases(F.col("s_suppkey"), FORMS))).alias("key"))


@query("id11_merged_by_identifier", """with recursive known as (select p_partkey as id, 'a' as scheme, p_brand || p_size || p_type as value from part union all select p_partkey, 'b', p_name from part),
least_of as (select scheme, value, min(id) as lo from known group by 1, 2 having count(*) > 1), link as (select id as u, lo as v from known join least_of using (scheme, value) where id <> lo),
both_ways as (select u, v from link union select v, u from link), reach as (select id as n, id as r from (select distinct id from known) union select n, v from reach join both_ways on r = u)
select n as id, min(r) as keep from reach group by 1""")
def _(spark, d):
    p = table(spark, d, "part")
    one = p.select(F.col("p_partkey").alias("id"), F.lit("a").alias("scheme"), F.concat("p_brand", F.col("p_size").cast("string"), "p_type").alias("value"))
    ids = one.unionByName(p.select(F.col("p_partkey").alias("id"), F.lit("b").alias("scheme"), F.col("p_name").alias("value")))
    return identity.merged_by_identifier(ids, Staging(spark, "merge"))


@query("id13_apply_merges", BASE + """, m as (select id, 'PER_' || (substr(id, 5)::bigint // 3 * 3) as keep from nodes where entity_type = 'PERSON'),
e as (select coalesce(a.keep, source) as source, coalesce(b.keep, target) as target, relationship_type from edges left join m a on a.id = source left join m b on b.id = target)
select source, target, relationship_type, count(*) as seen from e where source <> target group by 1, 2, 3""")
def _(spark, d):
    g = load_graph(spark, d)
    key = F.substring("id", 5, 20).cast("long")
    merges = g.persons().select("id", F.concat(F.lit("PER_"), (key - key % 3).cast("string")).alias("keep"))
    return identity.apply_merges(g.edges, merges)


@query("sc05_find_by_name", """with w as (select distinct n_name as name from nation union select 'CUSTOMER  ' || lpad(r_regionkey::varchar, 9, '0') from region), e as (select c_name as id, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) as k from customer),
a as (select c_name as id, lower(n_name) as k from customer join nation on n_nationkey = c_nationkey), x as (select name, lower(regexp_replace(name, '\\s+', ' ', 'g')) as k from w), direct as (select name, id, 'name' as by from x join e using (k))
select * from direct union select name, id, 'alias' from x join a using (k) where name not in (select name from direct)""")
def _(spark, d):
    c = table(spark, d, "customer")
    n = table(spark, d, "nation")
    w = n.select(F.col("n_name").alias("name")).union(table(spark, d, "region").select(F.concat(F.lit("CUSTOMER  "), F.lpad(F.col("r_regionkey").cast("string"), 9, "0"))))
    aliases = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_name").alias("id"), F.col("n_name").alias("alias"))
    return identity.find_by_name(w, c.select(F.col("c_name").alias("id"), F.col("c_name").alias("label")), aliases)


@query("sc06_assembled_entities", """with i as (select l_suppkey as id, l_returnflag as scheme, max(l_orderkey)::varchar as value from lineitem group by 1, 2), m as (select id, string_agg(scheme || '=' || value, ',' order by scheme) as ids from i group by 1),
a as (select l_suppkey as id, string_agg(distinct l_linestatus, ',' order by l_linestatus) as aliases from lineitem group by 1) select s_suppkey as id, s_name as label, ids, aliases from supplier left join m on m.id = s_suppkey left join a on a.id = s_suppkey""")
def _(spark, d):
    x = table(spark, d, "lineitem")
    ids = x.groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("scheme")).agg(F.max("l_orderkey").cast("string").alias("value"))
    out = identity.assemble(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")), ids, x.select(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("alias")))
    return out.select("id", "label", F.array_join(F.transform(F.map_entries("ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("ids"), F.array_join("aliases", ",").alias("aliases"))


@query("pj06_canonical_ids", """with i as (select c_custkey as id, c_custkey % 4 as k from customer)
select id, case when k = 0 then 'sec_cik:' || id when k = 1 then 'lei:L' || id when k = 2 then 'ein:E' || id else 'alpha:A' || id end as canonical from i""")
def _(spark, d):
    c = table(spark, d, "customer")
    rows = F.array(*[
        F.struct(F.lit(s).alias("scheme"), F.when(cond, F.concat(F.lit(tag), F.col("c_custkey").cast("string"))).alias("value"))
        for s, tag, cond in (("sec_cik", "", F.col("c_custkey") % 4 == 0), ("lei", "L", F.col("c_custkey") % 4 <= 1), ("ein", "E", F.col("c_custkey") % 4 <= 2), ("zeta", "Z", F.lit(True)), ("alpha", "A", F.lit(True)))
    ])
    ids = c.select(F.col("c_custkey").alias("id"), F.explode(rows).alias("r")).select("id", "r.*")
    return identity.canonical_id(ids)


@query("id04_identity_additions", """with held as (select c_name as id, 'sec_cik' as scheme, lpad(c_custkey::varchar, 10, '0') as value from customer where c_custkey % 3 = 0),
w as (select c_name as id, 'sec_cik' as scheme, case when c_custkey % 6 = 0 then lpad(c_custkey::varchar, 10, '0') when c_custkey % 7 = 0 then 'x' || c_custkey when c_custkey % 5 = 0 then '0000000003' else lpad((c_custkey * 3 + 1)::varchar, 10, '0') end as value from customer)
select w.id, w.scheme, w.value, case when h.value = w.value then 'already_set' when h.value is not null then 'overwrite' when exists (select 1 from held o where o.value = w.value and o.id <> w.id) then 'taken'
  when not regexp_full_match(w.value, '[0-9]{10}') then 'invalid' else 'added' end as status from w left join held h on h.id = w.id""")
def _(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    held = c.where(k % 3 == 0).select(F.col("c_name").alias("id"), F.lit("sec_cik").alias("scheme"), F.lpad(k.cast("string"), 10, "0").alias("value"))
    value = F.when(k % 6 == 0, k.cast("string")).when(k % 7 == 0, F.concat(F.lit("x"), k)).when(k % 5 == 0, F.lit(" 3 ")).otherwise((k * 3 + 1).cast("string"))
    return identity.identity_additions(c.select(F.col("c_name").alias("id"), F.lit("sec_cik").alias("scheme"), value.alias("value")), held)


@query("id03_validate_nodes", """with u as (select 'ENT_C' || c_custkey as id, c_custkey as k from customer)
select id, array_to_string(list_sort(list_filter([case when k % 5 = 0 then 'domains' end, case when k % 13 = 0 then 'id' end, case when k % 7 = 0 then 'identity.sec_cik' end,
  case when k % 4 = 0 then 'label' end], lambda x: x is not null)), ',') as errors from u""")
def _(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        F.concat(F.lit("ENT_C"), k).alias("id"), F.when(k % 4 == 0, " ").otherwise(F.col("c_name")).alias("label"), F.lit("CORPORATION").alias("entity_type"),
        F.when(k % 5 == 0, F.array(F.lit("DOM_A"), F.lit("DOM_Z"))).otherwise(F.array(F.lit("DOM_A"))).alias("domains"),
        F.create_map(F.lit("sec_cik"), F.when(k % 7 == 0, "no number").otherwise(k.cast("string"))).alias("identity"),
    )
    nodes = table(spark, d, "customer").where(k % 13 == 0).select(F.concat(F.lit("ENT_C"), k).alias("id"))
    held = spark.createDataFrame([], "scheme string, value string")
    return identity.validate_nodes(c, nodes, held, ["DOM_A", "DOM_B"])


@query("id23_inherited_domains", BASE + """, p as (select distinct source as person, domain from live join sectors on sectors.id = target where relationship_type in ('DIRECTOR_OF', 'OFFICER_OF'))
select person, string_agg(domain, ',' order by domain) || case when count(*) >= 2 then ',BRIDGE_HUMAN' else '' end as domains from p group by 1""")
def _(spark, d):
    g = live_graph(spark, d)
    return identity.inherited_domains(g.of("DIRECTOR_OF", "OFFICER_OF"), g.nodes).withColumn("domains", F.array_join("domains", ","))


@query("id24_choose_org", """with h as (select l_partkey as name, l_suppkey as id, count(*) as hits from lineitem where l_quantity >= 25 group by 1, 2), r as (select *, row_number() over (partition by name order by hits desc, id) as rn, lead(hits) over (partition by name order by hits desc, id) as nx from h)
select name, id, hits from r where rn = 1 and (nx is null or nx < hits)""")
def _(spark, d):
    h = table(spark, d, "lineitem").where("l_quantity >= 25").groupBy(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return identity.choose_org(h)


@query("au05_likely_duplicates", """with k as (select p_partkey as id, p_brand as type, lower(trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) as name from part) select type, name, string_agg(id::varchar, ',' order by id) as ids from k group by 1, 2 having count(*) > 1""")
def _(spark, d):
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"), F.concat("p_type", F.lit(" Inc.")).alias("label"))
    return audit.likely_duplicates(e).withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("au04_source_recheck", "select doc_id::varchar as url, case when doc_id % 5 = 0 then 'gone' when doc_id % 7 = 0 then 'changed' else 'unchanged' end as status from documents")
def _(spark, d):
    k = F.col("doc_id")
    x = table(spark, d, "documents").select(k, k.cast("string").alias("url"), F.sha2("text", 256).alias("sha256"))
    now = x.where(k % 5 != 0).select("url", F.when(k % 7 == 0, F.sha2(F.col("url"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return audit.recheck_sources(x.select("url", "sha256"), now)


@query("cl04_staged_evidence", f"""select l_orderkey, l_linenumber, case when {_cases_sql('l_orderkey', TYPES)} is null or l_linenumber = 5 or l_linenumber = 6 then 'lead' when l_linenumber = 4 or l_tax = 0 then 'blocked' else 'edge' end as outcome,
  not (l_linestatus = 'O' and l_quantity > 40) and l_discount <> 0 and l_shipdate::date >= date '{AS_OF}' - 456 as active from lineitem""")
def _(spark, d):
    n = F.col("l_linenumber")
    e = table(spark, d, "lineitem").select(
        "l_orderkey", n, predicates.source_type(_cases(F.col("l_orderkey"), SOURCES)).alias("source_type"), (n != 5).alias("relation_known"), F.when(n == 6, "name_only").alias("confidence"), (n != 4).alias("source_id_ok"),
        F.lit(True).alias("target_id_ok"), F.when(F.col("l_tax") != 0, "ref").alias("reference"), F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40), 0).alias("is_current"),
        F.col("l_discount").alias("percent"), F.to_date("l_shipdate").alias("last_seen"), F.lit(None).cast("date").alias("filing_date"),
    )
    return review.stage_evidence(e, F.lit(AS_OF).cast("date")).select("l_orderkey", "l_linenumber", "outcome", "active")


@query("tx08_record_check", "select l_orderkey * 10 + l_linenumber as claim, case when o_orderkey % 11 = 0 then 'block' when o_orderkey % 7 = 0 then 'warn' when o_orderkey % 5 = 0 then 'warn' else 'ok' end as status from lineitem join orders on l_orderkey = o_orderkey")
def _(spark, d):
    k = F.col("o_orderkey")
    edges = table(spark, d, "orders").where(k % 11 != 0).select(k.cast("string").alias("edge_id"), F.when(k % 7 == 0, "later").alias("superseded_by"), F.when(k % 5 == 0, "b").otherwise("a").alias("hash"))
    c = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim"), F.col("l_orderkey").cast("string").alias("edge_id"), F.lit("a").alias("hash"))
    return review.check_records(c, edges)


@query("rp01_numbered_sources", """with s as (select l_suppkey as doc, case when l_linenumber = 1 then 'url' || l_partkey else 'ref' || l_partkey end as source, max(l_shipdate::date) as date, count(*) as cited from lineitem group by 1, 2)
select doc, row_number() over (partition by doc order by date desc, source) as number, source, cited from s""")
def _(spark, d):
    x = table(spark, d, "lineitem")
    ref = F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit("ref"), "l_partkey"))
    return review.numbered_sources(x.select(F.col("l_suppkey").alias("doc"), ref.alias("ref"), F.concat(F.lit("url"), "l_partkey").alias("url"), F.to_date("l_shipdate").alias("date")))


@query("ag12_shared_funders", BASE + "select source, count(distinct target) as funded from edges where relationship_type = 'TEN_PERCENT_OWNER_OF' group by 1 having count(distinct target) >= 2")
def _(spark, d):
    return tallies.shared_funders(load_graph(spark, d).of("TEN_PERCENT_OWNER_OF"))


@query("ag17_committee_totals", "select * from (select o_orderpriority as committee, o_custkey as name, sum(case when o_orderstatus = 'O' then round(o_totalprice * 100)::bigint else 0 end)::bigint as cents from orders group by 1, 2) where cents > 0")
def _(spark, d):
    cents = F.when(F.col("o_orderstatus") == "O", F.round(F.col("o_totalprice") * 100).cast("long")).otherwise(0)
    return tallies.committee_totals(table(spark, d, "orders").select(F.col("o_orderpriority").alias("committee"), F.col("o_custkey").alias("name"), cents.alias("cents")))


@query("ag19_client_trail", "select l_partkey as client, count(*) as filings, count(distinct l_suppkey) as firms, strftime(max(l_shipdate), '%Y-%m-%d') as latest from lineitem group by 1")
def _(spark, d):
    return tallies.client_trail(table(spark, d, "lineitem").select(F.col("l_partkey").alias("client"), F.col("l_suppkey").alias("firm"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date")))


@query("ag22_position_gaps", "select source, count(*) as n, count(*) filter (where toxic is null) as missing from documents left join labels using (doc_id) group by 1")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return tallies.gaps(x, "source", F.col("toxic").isNull())


@query("ag28_bridge_persons", BASE + """, r as (select source as person, target as org, sic from live join nodes on id = target where relationship_type in ('DIRECTOR_OF', 'OFFICER_OF'))
select * from (select person, count(distinct case when sic < 3000 then org end) as corporate, count(distinct case when sic >= 3000 then org end) as nonprofit from r group by 1) where corporate > 0 and nonprofit > 0""")
def _(spark, d):
    g = live_graph(spark, d)
    r = g.of("DIRECTOR_OF", "OFFICER_OF").join(g.nodes.select(F.col("id").alias("target"), "sic"), "target").select(F.col("source").alias("person"), F.col("target").alias("org"), "sic")
    return tallies.bridge_persons(r, F.col("sic") < 3000, F.col("sic") >= 3000)


@query("ag31_confirmed_bridges", BASE + "select source as person, count(distinct target) as companies from live where percent >= 3 and target like 'ORG_%' group by 1 having count(distinct target) >= 2")
def _(spark, d):
    e = live_graph(spark, d).edges
    return tallies.confirmed_bridges(e.select(F.col("source").alias("person"), F.col("target").alias("company"), F.when(F.col("percent") >= 3, "CONFIRMED").otherwise("OPEN").alias("status")))


@query("set05_first_signals", "select user_id, event_type, min(event_id) as key from events group by 1, 2")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), F.col("event_type").alias("type"), F.array("user_id").alias("subjects"))
    return tallies.first_signals(e).select(F.col("subjects")[0].alias("user_id"), F.col("type").alias("event_type"), "key")


@query("en01_release_mentions")
def _(spark, d):
    """Documents that mention one of a few names at least twice."""
    from quillgraph.operators.enforcement import release_matches

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), F.lit("").alias("title"), "text")
    names = spark.createDataFrame([("N1", "Thanedble Inc.", "ORGANIZATION"), ("N2", "Disgusting Holdings", "ORGANIZATION"), ("N3", "MIT License", "PERSON"), ("N4", "Target", "ORGANIZATION")], "id string, label string, entity_type string")
    return release_matches(docs, names)
