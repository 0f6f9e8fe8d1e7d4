"""Records, identity, classification, texts and events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import scalars
from quillgraph.functions.names import match_people
from quillgraph.operators import central, claims, classify, integrity, records, tallies, textlint
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


def _shipments(spark, d):
    """Filings of (person, organisation, type) with a date and a key."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), F.col("l_quantity").cast("long").alias("q"))
    line = line.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select("o_custkey", "l_suppkey", "l_returnflag", "d", "q", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_linenumber")


SHIP = "with ship as (select o_custkey, l_suppkey, l_returnflag, strftime(l_shipdate, '%Y-%m-%d') as d, l_quantity::bigint as q, l_orderkey * 10 + l_linenumber as key, l_linenumber from lineitem join orders on l_orderkey = o_orderkey)\n"


@query("wn01_newest_record", SHIP + "select o_custkey, l_suppkey, l_returnflag, d, key from (select *, row_number() over (partition by o_custkey, l_suppkey, l_returnflag order by d desc, key desc) as rn from ship) where rn = 1")
def _(spark, d):
    return records.newest(_shipments(spark, d), ["o_custkey", "l_suppkey", "l_returnflag"], "d", "key").select("o_custkey", "l_suppkey", "l_returnflag", "d", "key")


@query("ag32_merge_evidence", SHIP + """, e as (select l_suppkey, l_returnflag, array_agg(distinct {'d': d, 'k': key}) as ev, min(d) as first_seen, max(d) as last_seen, count(*) as seen, max_by(q, {'d': d, 'k': key}) as q from ship group by 1, 2),
s as (select *, list_sort(ev) as es from e)
select l_suppkey, l_returnflag, first_seen, last_seen, seen, q, array_to_string(list_transform(es[greatest(1, len(es) - 24):], lambda x: x.k), ',') as evidence from s""")
def _(spark, d):
    m = records.merge_evidence(_shipments(spark, d), ["l_suppkey", "l_returnflag"], "d", "key", ["q"])
    return m.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x["url"].cast("string")), ","))


@query("id10_upsert", SHIP + """, cur as (select l_suppkey, o_custkey, max(d) as was from ship where l_linenumber = 1 group by 1, 2), inc as (select l_suppkey, o_custkey, max(d) as now from ship where l_linenumber = 2 group by 1, 2)
select l_suppkey, o_custkey, case when was is null then 'new' when now is null then 'kept' when now > was then 'superseding' else 'unchanged' end as action, greatest(was, now) as date
from cur full join inc using (l_suppkey, o_custkey)""")
def _(spark, d):
    s = _shipments(spark, d)
    cur = s.where("l_linenumber = 1").groupBy("l_suppkey", "o_custkey").agg(F.max("d").alias("d"))
    return records.upsert(cur, s.where("l_linenumber = 2"), ["l_suppkey", "o_custkey"], "d")


@query("gr17_supersession_chains", "select event_id as id, max(event_id) over (partition by user_id, event_type) as live from events")
def _(spark, d):
    from quillgraph.operators.paths import follow_supersession

    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return follow_supersession(table(spark, d, "events").select(F.col("event_id").alias("id"), F.lead("event_id").over(w).alias("superseded_by")))


@query("set04_roster_difference", BASE + """, rec as (select distinct source, target from live where relationship_type = 'DIRECTOR_OF'), ros as (select distinct source, target from edges where relationship_type = 'OFFICER_OF' and filings_seen >= 1 and percent >= 5)
select source, target, 'left' as change from rec where not exists (select 1 from ros where ros.source = rec.source and ros.target = rec.target)
union all select source, target, 'joined' from ros where not exists (select 1 from rec where ros.source = rec.source and ros.target = rec.target)""")
def _(spark, d):
    g = load_graph(spark, d)
    return records.roster_difference(g.of("DIRECTOR_OF"), g.of("OFFICER_OF").where("percent >= 5"), ["source", "target"])


@query("jn03_dangling_endpoints", BASE + """, part_nodes as (select id from nodes where id not like '%7') select edge_id, 'source' as side, source as id from edges where source not in (select id from part_nodes)
union all select edge_id, 'target', target from edges where target not in (select id from part_nodes)""")
def _(spark, d):
    g = load_graph(spark, d)
    return records.dangling(g.edges, g.nodes.where("id not like '%7'"))


@query("id02_duplicate_identifiers", "select * from (select 'desk' as scheme, c_nationkey || '-' || c_mktsegment as value, c_name as id, lag(c_name) over (partition by c_nationkey, c_mktsegment order by c_name) as other from customer) where other is not null")
def _(spark, d):
    c = table(spark, d, "customer").select(F.lit("desk").alias("scheme"), F.concat_ws("-", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("value"), F.col("c_name").alias("id"))
    return records.duplicate_identifiers(c)


CANDIDATES = """, cand as (select 'C' || (l_orderkey * 10 + l_linenumber) as edge_id, case when l_linenumber = 3 then 'PER_0' else 'PER_' || o_custkey end as source, 'ORG_' || l_suppkey as target,
  case when l_linenumber = 4 then 'bad type' else case l_returnflag when 'A' then 'DIRECTOR_OF' when 'R' then 'OFFICER_OF' else 'TEN_PERCENT_OWNER_OF' end end as relationship_type,
  case when l_tax > 0.05 then 'http://x' else 'https://x.org/' || l_orderkey end as citation_url, case when l_linenumber = 2 then '2001-13-01' else strftime(l_shipdate, '%Y-%m-%d') end as document_date,
  case when l_quantity = 10 then '0.123' when l_quantity = 11 then 'x' else '0.5' end as weight, case when l_quantity > 25 then 'a reason that is long enough' else '' end as reason
  from lineitem join orders on l_orderkey = o_orderkey)
"""


@query("id05_validate_edges", BASE + CANDIDATES + """, t as (select distinct source, target, relationship_type from live),
v as (select cand.edge_id, list_sort(list_filter([case when cand.source not in (select id from nodes) then 'source' end, case when cand.target not in (select id from nodes) or cand.source = cand.target then 'target' end,
  case when not regexp_full_match(cand.relationship_type, '[A-Z][A-Z0-9_]{2,60}') then 'relationship_type' end, case when not starts_with(citation_url, 'https://') then 'citation_url' end,
  case when try_cast(document_date as date) is null or try_cast(document_date as date) > date '""" + AS_OF + """' then 'document_date' end,
  case when try_cast(cand.weight as double) is null or cand.weight = '0.123' then 'conflict_weight' end, case when t.source is not null and len(reason) < 10 then 'supersedes' end], lambda x: x is not null)) as errs
  from cand left join t using (source, target, relationship_type))
select edge_id, array_to_string(errs, ',') as errors, case when len(errs) = 0 then 201 when errs = ['supersedes'] then 409 else 422 end::int as status from v""")
def _(spark, d):
    g = load_graph(spark, d)
    line = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "A", "DIRECTOR_OF").when(F.col("l_returnflag") == "R", "OFFICER_OF").otherwise("TEN_PERCENT_OWNER_OF")
    cand = line.select(
        F.concat(F.lit("C"), F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.when(F.col("l_linenumber") == 3, "PER_0").otherwise(F.concat(F.lit("PER_"), "o_custkey")).alias("source"),
        F.concat(F.lit("ORG_"), "l_suppkey").alias("target"), F.when(F.col("l_linenumber") == 4, "bad type").otherwise(kind).alias("relationship_type"),
        F.when(F.col("l_tax") > 0.05, "http://x").otherwise(F.concat(F.lit("https://x.org/"), "l_orderkey")).alias("citation_url"),
        F.when(F.col("l_linenumber") == 2, "2001-13-01").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("document_date"),
        F.when(F.col("l_quantity") == 10, "0.123").when(F.col("l_quantity") == 11, "x").otherwise("0.5").alias("weight"), F.when(F.col("l_quantity") > 25, "a reason that is long enough").otherwise("").alias("reason"),
    )
    return records.validate_edges(cand, g.nodes, load_graph(spark, d, live=True).edges, F.lit(AS_OF).cast("date"))


@query("jn17_corroborated_ties", BASE + ", r as (select distinct source as person, target as org from edges where relationship_type in ('DIRECTOR_OF', 'OFFICER_OF')) select distinct edge_id, x.person from edges join r x on x.org = source join r y on y.org = target and y.person = x.person where relationship_type = 'BENEFICIAL_OWNER_OF'")
def _(spark, d):
    g = load_graph(spark, d)
    return records.corroborated(g.of("DIRECTOR_OF", "OFFICER_OF"), g.of("BENEFICIAL_OWNER_OF"))


TOKENS = "regexp_extract_all(text, '[A-Za-z]+')"


@query("jn14_all_tokens_match", f"""with tok as (select distinct doc_id as doc, lower(unnest({TOKENS})) as token from documents),
want as (select distinct item_id as name, lower(unnest({TOKENS})) as token from benchmark), need as (select name, count(*) as n from want group by 1)
select doc, name from tok join want using (token) join need using (name) group by doc, name, n having count(*) = n""")
def _(spark, d):
    words = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0), lambda x: F.lower(x))
    tok = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(words)).alias("token")).distinct()
    want = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), F.explode(F.array_distinct(words)).alias("token"))
    return records.all_tokens_match(tok, want)


RANGES = ", ".join(f"({lo}, {hi}, '{','.join('DOM_' + c for c in letters)}', {n})" for n, (lo, hi, letters) in enumerate(classify.SIC_RANGES))


@query("jn08_sic_range_classify", BASE + f", rng(lo, hi, doms, ord) as (values {RANGES}) select id, sic, doms as domains from (select id, sic, doms, row_number() over (partition by id order by hi - lo, ord) as rn from nodes join rng on sic between lo and hi) where rn = 1")
def _(spark, d):
    out = classify.classify_by_range(load_graph(spark, d).nodes, classify.range_frame(spark))
    return out.select("id", "sic", F.array_join("range_domains", ",").alias("domains"))


@query("jn10_classify_ladder", f"""with rng(lo, hi, doms, ord) as (values {RANGES}), o as (select 'P' || p_partkey as id, p_name as label, case when p_size % 3 = 0 then 1000 + p_size * 150 end as sic, case when p_size % 3 = 1 then chr(65 + p_size % 26) end as ntee from part),
x as (select o.*, (select doms from rng where sic between lo and hi order by hi - lo, ord limit 1) as doms from o)
select id, coalesce(doms, case when ntee is not null then 'DOM_' || substr('{''.join(classify.NTEE.values())}', ascii(ntee) - 64, 1) end, case when regexp_matches(label, '(?i)\\b(fund|capital|partners|trust|acquisition)\\b') then 'DOM_C' end) as sectors,
case when doms is not null then 'industry' when ntee is not null then 'nonprofit' when regexp_matches(label, '(?i)\\b(fund|capital|partners|trust|acquisition)\\b') then 'name' else 'none' end as basis from x""")
def _(spark, d):
    p = table(spark, d, "part")
    orgs = p.select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 3 == 0, 1000 + F.col("p_size") * 150).cast("int").alias("sic"),
        F.when(F.col("p_size") % 3 == 1, F.chr((65 + F.col("p_size") % 26).cast("long"))).alias("ntee"),
    )
    return classify.classify(orgs, classify.range_frame(spark)).withColumn("sectors", F.array_join("sectors", ","))


@query("sf_name_keys", """select c_name as label, trim(regexp_replace(regexp_replace(replace(lower(c_name), '&', ' and '), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as norm,
  'ENT_' || trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', '_', 'g'), '_') as slug, lpad(c_custkey::varchar, 10, '0') as cik from customer""")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_name").alias("label"), scalars.norm_name(F.col("c_name")).alias("norm"), scalars.slug_id(F.col("c_name")).alias("slug"), scalars.pad_cik(F.col("c_custkey")).alias("cik"))


@query("ag15_holdings_rollup", """with h as (select l_partkey, sum(round(l_extendedprice * 100)::bigint)::bigint as cents, sum(l_quantity)::bigint as shares from lineitem group by 1)
select l_partkey, cents, shares, round(cents * 100.0 / sum(cents) over (), 6) as percent, row_number() over (order by cents desc, l_partkey) as rank from h qualify rank <= 50""")
def _(spark, d):
    h = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.sum("l_quantity").cast("long").alias("shares"))
    total = h.agg(F.sum("cents").alias("t"))
    top = h.orderBy(F.desc("cents"), "l_partkey").limit(50).crossJoin(F.broadcast(total))  # one row
    return top.select("l_partkey", "cents", "shares", F.round(F.col("cents") * 100.0 / F.col("t"), 6).alias("percent"), F.row_number().over(Window.orderBy(F.desc("cents"), "l_partkey")).alias("rank"))


@query("ag16_awards_by_year", "with y as (select l_suppkey, year(l_shipdate) as y, count(*) as n from lineitem group by 1, 2) select l_suppkey, string_agg(y || ':' || n, ',' order by y) as years, sum(n)::bigint as total from y group by 1")
def _(spark, d):
    y = table(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("y", "n"))), lambda x: F.concat_ws(":", x["y"].cast("string"), x["n"].cast("string")))
    return y.groupBy("l_suppkey").agg(F.array_join(pairs, ",").alias("years"), F.sum("n").alias("total"))


@query("ag18_order_trail", """select o_custkey, count(*) as orders, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) as latest,
  array_to_string(list_reverse(list_sort(array_agg({'d': o_orderdate, 'k': o_orderkey})))[1:12].list_transform(lambda x: x.k), ',') as trail from orders group by 1""")
def _(spark, d):
    o = table(spark, d, "orders")
    return tallies.newest_trail(o, "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority").withColumnsRenamed({"n": "orders", "kinds": "priorities"})


@query("ag20_top_countries", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1 order by n desc, n_name limit 40")
def _(spark, d):
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "n_name").limit(40)


@query("ag21_status_tally", "select o_orderstatus as status, count(*) as n from orders group by 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


CLAIMS = """, claim as (select ('0x' || substr(md5(edge_id), 1, 8))::bigint as n, edge_id as claim_id, source as person, target as org, relationship_type as role from edges where percent >= 9),
cl as (select claim_id, case when n % 11 = 0 then 'PER_0' else person end as person, case when n % 7 = 0 then 'ORG_999999' else org end as org, case when n % 5 = 0 then 'TRUSTEE_OF' else role end as role from claim)
"""


def _claims(g):
    c = g.edges.where("percent >= 9").select(F.conv(F.substring(F.md5(F.col("edge_id").cast("binary")), 1, 8), 16, 10).cast("long").alias("n"), F.col("edge_id").alias("claim_id"), F.col("source").alias("person"), F.col("target").alias("org"), F.col("relationship_type").alias("role"))
    return c.select("claim_id", F.when(F.col("n") % 11 == 0, "PER_0").otherwise(F.col("person")).alias("person"), F.when(F.col("n") % 7 == 0, "ORG_999999").otherwise(F.col("org")).alias("org"), F.when(F.col("n") % 5 == 0, "TRUSTEE_OF").otherwise(F.col("role")).alias("role"))


@query("cl01_claims_check", BASE + CLAIMS + """select claim_id, case when org not in (select id from nodes where entity_type <> 'PERSON') then 'NO_COVERAGE' when person not in (select source from edges) then 'PERSON_NOT_FOUND'
  when exists (select 1 from edges where source = person and target = org and relationship_type = role) then 'CONFIRMED' when exists (select 1 from edges where source = person and target = org) then 'CONFLICT' else 'NOT_FILED' end as status from cl""")
def _(spark, d):
    g = load_graph(spark, d)
    return claims.check_claims(_claims(g), g)


@query("cl01_unmentioned_roles", BASE + CLAIMS + "select distinct source as person, target as org, relationship_type from live where source in (select person from cl) and not exists (select 1 from cl where person = source and org = target)")
def _(spark, d):
    g = load_graph(spark, d)
    return claims.unmentioned_roles(_claims(g), g)


@query("pt02_oversight_overlap", BASE + """select distinct x.source as person, x.target as office, y.target as seat, array_to_string(list_sort(list_intersect(a.domains, b.domains)), ',') as shared from live x join live y on x.source = y.source and x.target <> y.target
  join nodes a on a.id = x.target join nodes b on b.id = y.target where x.relationship_type = 'OFFICER_OF' and y.relationship_type = 'DIRECTOR_OF' and len(list_intersect(a.domains, b.domains)) > 0""")
def _(spark, d):
    return claims.oversight_overlap(live_graph(spark, d))


@query("pt04_enforcement_proximity", BASE + "select distinct x.target as flagged, y.target as other, x.source as person from live x join live y on x.source = y.source and x.target <> y.target where x.relationship_type = 'DIRECTOR_OF' and y.relationship_type = 'DIRECTOR_OF' and x.target like '%3'")
def _(spark, d):
    g = live_graph(spark, d)
    return claims.enforcement_proximity(g, g.nodes.where("id like 'ORG_%3'"))


@query("gr07_betweenness")
def _(spark, d):
    return central.betweenness(live_graph(spark, d))


@query("gr11_single_points")
def _(spark, d):
    return central.single_points(live_graph(spark, d))


@query("sc11_html_links", "select page_id, h.u as href, count(*) as n from pages, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as h(u) group by 1, 2")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


UNESCAPED = "x"
for _name, _char in scalars.ENTITIES:
    UNESCAPED = f"replace({UNESCAPED}, '{_name}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("sf14_html_title", f"select page_id, trim(regexp_replace({UNESCAPED}, '\\s+', ' ', 'g')) as title from (select page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', ' ', 'g') as x from pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.strip_html(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("sc19_event_tail", "select event_id, event_type, user_id from events order by event_id desc limit 100")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("event_id")).limit(100).select("event_id", "event_type", "user_id")


@query("wn03_event_chain", "select user_id, event_id, prev, event_id - prev as gap from (select user_id, event_id, lag(event_id) over (partition by user_id order by event_id) as prev from events) where prev is not null")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.lag("event_id").over(w).alias("prev")).where("prev is not null").withColumn("gap", F.col("event_id") - F.col("prev"))


@query("ss02_hourly_activity", "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H') as hour, event_type, count(*) as n from events group by 1, 2")
def _(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sk07_changed_since", "with seen as (select user_id, event_type, count(*) as n from events where event_id % 3 <> 0 group by 1, 2), now as (select user_id, event_type, count(*) as n from events group by 1, 2) select now.* from now where not exists (select 1 from seen where seen.user_id = now.user_id and seen.event_type = now.event_type and seen.n = now.n)")
def _(spark, d):
    e = table(spark, d, "events")
    state = lambda x: x.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return state(e).join(state(e.where("event_id % 3 <> 0")), ["user_id", "event_type", "n"], "left_anti").select("user_id", "event_type", "n")


@query("hs05_claims_fingerprint", BASE + """, m as (select target, md5(edge_id || '|' || active::varchar || '|' || filings_seen) as m from edges)
select target, count(*) as rows, sha256(count(*) || ':' || sum(('0x' || substr(m, 1, 15))::hugeint) || ':' || sum(('0x' || substr(m, 16, 15))::hugeint)) as sha256 from m group by 1""")
def _(spark, d):
    return integrity.fingerprint(load_graph(spark, d).edges, "target", ["edge_id", "active", "filings_seen"])


@query("hs04_text_sha256", "select doc_id, sha256(text) as sha256 from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def _rule_sql(name: str, severity: str, pattern: str) -> str:
    said = "text" if severity == "private" else "said"
    if name == "phone":  # no look-behind there
        found = r"regexp_extract_all(text, '(?:^|[^0-9-])((?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.]\d{3}[\s.-]\d{4})\b', 1)"
    else:
        found = f"regexp_extract_all({said}, '(?i){pattern}')"
    kept = "" if severity in ("block", "private") else " where not starts_with(raw, '|')"
    return f"select doc, line, '{name}' as rule, '{severity}' as severity, unnest({found}) as word from l{kept}"


TX01 = r"""with r as (select doc_id as doc, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
c as (select doc, line, regexp_replace(regexp_replace(raw, '\]\([^)]*\)', ']', 'g'), '`[^`]*`', '', 'g') as raw from r),
q as (select doc, line, raw, regexp_replace(raw, '"[^"]*"|“[^”]*”', ' ', 'g') as text from c),
l as (select *, array_to_string(list_transform(regexp_split_to_array(text, '\.|[!?;:]\s'), lambda s: regexp_replace(s, '(?is)\b(NEGATIONS)\b.*$', '')), chr(10)) as said from q)
""".replace("NEGATIONS", "|".join(textlint.NEGATIONS).replace("'", "''"))


@query("tx01_wording_review", TX01 + " union all ".join(_rule_sql(*r) for r in textlint.LEXICON))
def _(spark, d):
    return textlint.wording(table(spark, d, "documents"))


@query("tx02_long_sentences", """with s as (select doc_id as doc, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|' || chr(10)), lambda s: len(list_filter(regexp_split_to_array(trim(s), '[ \\t]+'), lambda w: w <> ''))), lambda n: n > 45) as s from documents)
select doc, len(s) as sentences, list_max(s) as longest from s where len(s) > 0""")
def _(spark, d):
    return textlint.long_sentences(table(spark, d, "documents"))


@query("tx10_private_details", r"""with c as (select text, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+')) as email, len(regexp_extract_all(text, '\(\d{3}\) \d{3}-\d{4}')) as phone from documents)
select 'email' as rule, count(*) as docs, sum(email)::bigint as hits from c where email > 0 union all select 'phone', count(*), sum(phone)::bigint from c where phone > 0""")
def _(spark, d):
    return textlint.rule_counts(table(spark, d, "documents"), {"email": r"[\w.+-]+@[\w-]+\.[\w.]+", "phone": r"\(\d{3}\) \d{3}-\d{4}"})


@query("tx06_terms_present", r"select 'license' as rule, count(*) as docs, sum(len(regexp_extract_all(text, '(?i)\blicense')))::bigint as hits from documents where regexp_matches(text, '(?i)\blicense')")
def _(spark, d):
    return textlint.rule_counts(table(spark, d, "documents"), {"license": r"(?i)\blicense"})


FIRSTS = {"Robert": "robert", "Bob": "bob robert", "Ann": "ann", "Anna": "anna", "R.": "r", "Elizabeth": "elizabeth", "Liz": "liz elizabeth", "A.": "a"}
MIDDLES = ("", "J. ", "James ", "K. ")


def _person(index_first, index_middle, nation):
    pick = lambda values, i: F.array(*[F.lit(v) for v in values])[i.cast("int")]
    return F.concat(pick(FIRSTS, index_first % len(FIRSTS)), F.lit(" "), pick(MIDDLES, index_middle % len(MIDDLES)), F.initcap(F.replace(nation, F.lit(" "), F.lit(""))))


def _nicks(first, last):
    """DuckDB: whether two first names meet: equal in some form, or one the start of the other, or by initial."""
    return f"""case when len({first}[1]) = 1 or len({last}[1]) = 1 then list_has_any(list_transform({first}, lambda f: f[1:1]), list_transform({last}, lambda f: f[1:1]))
  else list_has_any({first}, {last}) or list_has_any(list_transform({first}, lambda f: f[1:3]), list_transform({last}, lambda f: f[1:3])) end"""


@query("jn11_person_name_match", f"""with c as (select c_custkey, replace(n_name, ' ', '') as last, c_custkey // 10 as k from customer join nation on n_nationkey = c_nationkey),
p as (select c_custkey as id, last, [{", ".join(str(f.split()) for f in FIRSTS.values())}][(k % 8 + 1)::int] as f, (k // 8 % 4)::int as m from c),
x as (select * from p where id % 10 = 0), y as (select * from p where id % 10 = 1)
select x.id as left_id, y.id as right_id, case when len(x.f[1]) = 1 or len(y.f[1]) = 1 then 'initial' when x.m = 0 or y.m = 0 then 'first_last' else 'full' end as kind from x join y using (last) where {_nicks("x.f", "y.f")}
  and (len(x.f[1]) = 1 or len(y.f[1]) = 1 or x.m = 0 or y.m = 0 or (x.m = 3) = (y.m = 3))""")
def _(spark, d):
    """Names made of short forms, initials and middle names, every tenth customer against every other tenth; the three
    letters of any two first names differ unless one begins the other."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.floor(F.col("c_custkey") / 10)
    names = c.select(F.col("c_custkey").alias("id"), _person(k, F.floor(k / 8), F.col("n_name")).alias("name"))
    return match_people(names.where("id % 10 = 0"), names.where("id % 10 = 1"))
