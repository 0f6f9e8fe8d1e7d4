"""Scalar functions, predicates and projections over the driver's tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.catalogs.identity import SOURCES, _cases, _cases_sql
from quillgraph.functions import labels, predicates, scalars, texts, weights
from quillgraph.operators import changes, identity, integrity, patterns, review, textlint
from quillgraph.sources.tables import AS_OF, graph_sql, load_graph, table

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


def scalar(name: str, source: str, key: str, value: Callable[[], Column], sql: str) -> None:
    """One value per row of a table."""
    QUERIES[name] = lambda spark, d: table(spark, d, source).select(key, value().alias("value"))
    ORACLE_SQL[name] = f"select {key}, {sql} as value from {source}"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


KEY = "p_partkey"
TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"
joined = lambda c: F.array_join(c, ",")

scalar("sf02_loose_names", "part", KEY, lambda: scalars.loose_name(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), (" Inc.", " Group, LLC", " & Co", " of the North", "")))), f"p_name || {_cases_sql('p_partkey', ('', '', ' and', ' of north', ''))}")
scalar("sf03_readable_names", "part", KEY, lambda: labels.readable_name(F.upper(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), (" llc", " o'neil", " /de/"))))), TITLE.format("p_name") + f" || {_cases_sql('p_partkey', (' LLC', chr(32) + 'O' + chr(39) + 'Neil', ''))}")
scalar("sf04_person_order", "part", KEY, lambda: labels.person_in_order(F.upper(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), ("", " J", " JR"))))),
       f"(select case p_partkey % 3 when 0 then t[2] || ' ' || t[1] when 1 then t[2] || ' J ' || t[1] else t[2] || ' ' || t[1] || ' Jr' end from (select string_split({TITLE.format('p_name')}, ' ') as t))")
scalar("sf09_name_forms", "part", KEY, lambda: F.array_join(labels.name_forms(_text("Ann ", _cases(F.col("p_partkey"), ("Lund", "K.", "van")), " ", F.initcap(F.element_at(F.split(F.col("p_name"), " "), 1)))), ";"),
       "(select case p_partkey % 3 when 0 then 'Ann Lund ' || w || ';Ann Lund' when 1 then 'Ann K. ' || w else 'Ann van ' || w end from (select upper(p_name[1:1]) || string_split(p_name, ' ')[1][2:] as w))")
scalar("sf11_issuer_keys", "part", KEY, lambda: texts.issuer_key(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), (" (old) L.P.", ", The Company", " Holdings")))), f"p_name || {_cases_sql('p_partkey', ('', '', ' holdings'))}")
scalar("sf11_register_keys", "part", KEY, lambda: texts.register_key(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), (" Limited", " LLP & Sons", " Inc")))), f"p_name || {_cases_sql('p_partkey', ('', ' and sons', ' inc'))}")
scalar("sf11_claimed_keys", "part", KEY, lambda: texts.claimed_key(F.concat(F.col("p_name"), _cases(F.col("p_partkey"), (" Foundation (US)", "'s Fund", " Group")))), f"p_name || {_cases_sql('p_partkey', ('', 's', ' group'))}")
scalar("sf11_org_match", "part", KEY, lambda: texts.org_match(F.col("p_name"), F.concat(_cases(F.col("p_partkey"), ("The ", "Other ", "")), F.when(F.col("p_partkey") % 4 == 1, F.lit("thing")).otherwise(F.col("p_name")), F.lit(" Holdings"))), "p_partkey % 4 <> 1")
scalar("sf08_first_names_meet", "part", KEY, lambda: texts.first_names_meet(_text(_cases(F.col("p_partkey"), ("Robert", "Bob", "Roberta", "Liz", "Elizabeth", "Eli")), " Moe"), _text(_cases(F.floor(F.col("p_partkey") / 6), ("Bob", "Elizabeth (Liz)", "B.")), " ", _cases(F.floor(F.col("p_partkey") / 18), ("Moe", "Moe Jr.", "Poe")))),
       "(p_partkey // 18 % 3) < 2 and case p_partkey // 6 % 3 when 0 then p_partkey % 6 < 3 when 1 then p_partkey % 6 >= 3 else false end")
scalar("sf12_org_patterns", "part", KEY, lambda: F.regexp_count(_text("So ", F.col("p_name"), " agrees. But ", F.col("p_name"), " Other won. ", F.upper(F.col("p_name")), " paid; ", F.col("p_name"), " Inc paid"), labels.org_pattern(F.concat(F.col("p_name"), F.lit(" Inc")))).cast("long"), "3::bigint")
scalar("sf13_release_kinds", "part", KEY, lambda: labels.release_kind(_cases(F.col("p_partkey"), ("Firm Pleads Guilty", "US Files Complaint", "Court Judgment", "Firm Agrees to Pay", "A day in court"))), _cases_sql("p_partkey", ("criminal case", "complaint", "court judgment", "civil settlement", "press release")))
scalar("sf16_domain_letters", "part", KEY, lambda: joined(scalars.us_title_domains(_text("Domains ", F.chr(65 + F.col("p_partkey") % 7), "/", F.chr(65 + F.col("p_partkey") * 3 % 7), ", ", F.chr(65 + F.col("p_partkey") * 5 % 7), "; domain ", F.chr(65 + F.col("p_partkey") * 2 % 7)))),
       "array_to_string(list_sort(list_distinct([chr((65 + p_partkey % 7)::int), chr((65 + p_partkey * 3 % 7)::int), chr((65 + p_partkey * 5 % 7)::int), chr((65 + p_partkey * 2 % 7)::int)])), ',')")
scalar("sf17_owner_roles", "part", KEY, lambda: joined(F.transform(texts.owner_roles(_cases(F.col("p_partkey"), ("director", "director, officer: CFO", "10 percent owner", "other: advisor", "Director, other: x", ""))), lambda r: F.concat_ws(":", r["relation"], r["title"]))),
       _cases_sql("p_partkey", ("director_of", "director_of,officer_of:CFO", "ten_percent_owner_of", "related_to:advisor", "director_of", "")))
def D() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


scalar("sf18_partial_dates", "orders", "o_orderkey", lambda: texts.partial_date(F.when(F.col("o_orderkey") % 3 == 0, _text(F.substring(D(), 1, 4), "-00-00")).when(F.col("o_orderkey") % 3 == 1, _text(F.substring(D(), 1, 7), "-00")).otherwise(D())),
       "case o_orderkey % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%Y-%m') else strftime(o_orderdate, '%Y-%m-%d') end")
scalar("sf18_us_dates", "orders", "o_orderkey", lambda: scalars.iso_from_us(F.when(F.col("o_orderkey") % 5 == 0, "13/40/2000").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))).cast("string"), "case when o_orderkey % 5 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end")
def LEI18() -> Column:
    return F.concat(F.lit("5299"), F.lpad(F.col("o_orderkey").cast("string"), 14, "0"))


def CHECK() -> Column:
    return (98 - (F.concat(LEI18(), F.lit("00")).cast("decimal(38,0)") % 97).cast("int") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))


scalar("sf19_lei_checks", "orders", "o_orderkey", lambda: scalars.lei_ok(F.concat(LEI18(), F.lpad(CHECK().cast("string"), 2, "0"))), "o_orderkey % 3 <> 0")
scalar("sf20_clean_identifiers", "part", KEY, lambda: F.concat_ws("=", _cases(F.col("p_partkey"), ("sec_cik", "gleif_lei", "doi", "other")), identity.clean_value(_cases(F.col("p_partkey"), ("sec_cik", "gleif_lei", "doi", "other")), F.when(F.col("p_partkey") % 4 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 4 == 1, _text(" ab", F.col("p_partkey").cast("string"))).when(F.col("p_partkey") % 4 == 2, _text("https://doi.org/10.1000/X", F.col("p_partkey").cast("string"))))),
       "case p_partkey % 4 when 0 then 'sec_cik=' || lpad(p_partkey::varchar, 10, '0') when 1 then 'gleif_lei=AB' || p_partkey when 2 then 'doi=10.1000/x' || p_partkey else 'other' end")
scalar("sf24_own_parts", "part", KEY, lambda: texts.own_part(F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(_text("x <!--own-->", F.col("p_name"), _cases(F.col("p_partkey"), ("", "<!--end-->", " ")), "y")), "<!--own-->", "<!--end-->"), "case when p_partkey % 3 = 1 then p_name end")
scalar("sf25_rounded_shares", "part", KEY, lambda: F.bround(F.col("p_size") / 4, 0).cast("long"), "round_even(p_size / 4, 0)::bigint")
scalar("sf27_merged_maps", "part", KEY, lambda: joined(F.transform(F.array_sort(F.map_entries(texts.merged_map(F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type")), F.create_map(F.lit("b"), F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_brand")), F.lit("c"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")))))), lambda e: F.concat_ws("=", e["key"], e["value"]))),
       "'a=' || p_name || ',b=' || case when p_partkey % 2 = 0 then p_type else p_brand end || case when p_partkey % 3 > 0 then ',c=' || p_brand else '' end")
scalar("sf28_surnames", "part", KEY, lambda: texts.surname(F.concat(F.initcap(F.col("p_name")), _cases(F.col("p_partkey"), ("", ", Jr.", " III")))), "string_split(p_name, ' ')[-1]")
scalar("sf30_states", "part", KEY, lambda: texts.state_of_role(_cases(F.col("p_partkey"), ("U.S. Senator for OH", "Rep. for the people for TX-3", "none"))), _cases_sql("p_partkey", ("OH", "TX", None)))
scalar("sf31_search_hits", "part", KEY, lambda: texts.search_hit(_cases(F.col("p_partkey"), ("wid", "WIDGETEN", "zzz", "wídget")), F.col("p_name")), "list_bool_or(list_transform(string_split(p_name, ' '), lambda w: case p_partkey % 4 when 2 then false when 1 then starts_with(w, 'widgeten') or (starts_with('widgeten', w) and 8 - length(w) <= 2) when 3 then starts_with(w, 'widget') or (starts_with('widget', w) and 6 - length(w) <= 2) else starts_with(w, 'wid') or (starts_with('wid', w) and 3 - length(w) <= 2) end))")
scalar("pj05_entity_types", "part", KEY, lambda: identity.entity_type(_cases(F.col("p_partkey"), ("person", "grant", "organization", "work")), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0, F.col("p_size") % 5 == 0),
       "case when p_size % 5 = 0 then 'NONPROFIT' when p_size % 3 = 0 then 'PRIVATE_COMPANY' when p_partkey % 4 = 2 and p_size % 2 = 0 then 'CORPORATION' else ['PERSON', 'RESEARCH_GRANT', 'ORGANIZATION', 'SCIENTIFIC_STUDY'][(p_partkey % 4 + 1)::int] end")
scalar("pj12_role_phrases", "part", KEY, lambda: F.concat_ws(" ", texts.status_word(F.when(F.col("p_partkey") % 3 == 0, False).when(F.col("p_partkey") % 3 == 1, True)), texts.role_phrase(_cases(F.col("p_partkey"), ("DIRECTOR_OF", "TRUSTEE_OF")), F.when(F.col("p_partkey") % 5 == 0, F.col("p_name")))),
       "case when p_partkey % 3 = 0 then 'historical' else 'current' end || ' ' || case p_partkey % 2 when 0 then 'director' else 'trustee of' end || case when p_partkey % 5 = 0 then ' (' || p_name || ')' else '' end")
RELATION = [r for r, _, _ in weights.RELATIONS] + ["unheard_of"]
scalar("pj07_conflict_weights", "part", KEY, lambda: weights.conflict_weight(_cases(F.col("p_partkey"), RELATION), F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 4 > 0, F.col("p_size") - 1)),
       f"(select round(case when r in ('beneficial_owner_of', 'holds_shares_of', 'owns') and p_size % 4 > 0 then case when p_size = 1 then 0 else least(1.0, v * (0.6 + (p_size - 1) / 25.0)) end else v end, 3)::double from (select r, (case when p_size % 3 = 0 then w / 2 else w end)::double as v from (select {_cases_sql('p_partkey', RELATION)} as r, {[w for _, _, w in weights.RELATIONS] + [0.3]}[(p_partkey % {len(RELATION)} + 1)::int]::double as w)))")
scalar("ud02_control_classes", "part", KEY, lambda: weights.control_class(F.upper(_cases(F.col("p_partkey"), RELATION))), f"{[c for _, c, _ in weights.RELATIONS] + ['soft']}[(p_partkey % {len(RELATION)} + 1)::int]")
scalar("fl04_current_records", "lineitem", "l_orderkey", lambda: predicates.is_current(F.when(F.col("l_linenumber") == 2, 0).when(F.col("l_linenumber") == 1, 1), F.when(F.col("l_quantity") > 10, F.to_date("l_shipdate")), F.lit(AS_OF).cast("date")),
       f"l_linenumber <> 2 and (l_quantity <= 10 or l_shipdate::date >= date '{AS_OF}')")
scalar("fl06_primary_sources", "orders", "o_orderkey", lambda: predicates.is_primary(_cases(F.col("o_orderkey"), SOURCES), _cases(F.floor(F.col("o_orderkey") / 11), (None, "high", "name_only", "registry"))),
       f"coalesce(regexp_matches(upper({_cases_sql('o_orderkey', SOURCES)}), '^(SEC FORM|IRS FORM 990|UK COMPANIES HOUSE)'), false) and o_orderkey // 11 % 4 <> 2")
scalar("fl14_allowed_hosts", "pages", "page_id", lambda: predicates.host_allowed(F.col("url"), ["example.com", "example.org"]), "starts_with(url, 'https://') and regexp_matches(lower(url), '^https://([^/:?#@]+[.])?example[.](com|org)([/:?#]|$)')")
def E() -> Column:
    return F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")


scalar("fl16_tenure_dates", "orders", "o_orderkey", lambda: predicates.tenure_ok(F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(D()), F.when(F.col("o_orderkey") % 5 == 0, "").when(F.col("o_orderkey") % 11 == 0, F.lit("1980-01-01")).otherwise(E()), F.col("o_orderstatus") == "O", F.lit(AS_OF).cast("date")),
       f"o_orderkey % 7 <> 0 and (o_orderkey % 5 = 0 or (o_orderkey % 11 <> 0 and not (o_orderstatus = 'O' and o_orderdate::date + 30 < date '{AS_OF}')))")
scalar("tx03_claims_signs", "part", KEY, lambda: F.regexp_count(_text("Medicare ", F.col("p_name"), " and ", F.when(F.col("p_partkey") % 2 == 0, "federal grants").otherwise("x")), F.lit(textlint.CLAIM_SIGNS)).cast("long"), "case when p_partkey % 2 = 0 then 2 else 1 end::bigint")
scalar("tx09_verdicts", "part", KEY, lambda: textlint.verdict(F.col("p_size") % 7 == 0, F.col("p_size") % 5, F.col("p_size") % 3, F.col("p_size") % 2), "case when p_size % 7 = 0 then 'ON HOLD' when p_size % 5 > 0 then 'BLOCKED' when p_size % 3 > 0 then 'NEEDS ATTENTION' when p_size % 2 > 0 then 'VERIFIED' else 'READY' end")
def RAW() -> Column:
    return _text('{"edge_id": "', F.col("p_partkey").cast("string"), '", "note": "', F.col("p_name"), '", "integrity": {"recorded_at": "x", "conflict_weight": 0.5, "superseded_by": null}, "a": [1, 2]}')


scalar("hs01_edge_hashes", "part", KEY, lambda: integrity.edge_hash(RAW()), """sha256('{"a": [1, 2], "edge_id": "' || p_partkey || '", "integrity": {"conflict_weight": 0.5}, "note": "' || p_name || '"}')""")
scalar("hs03_entry_hashes", "part", KEY, lambda: integrity.entry_hash(_text('{"seq": ', F.col("p_partkey").cast("string"), ', "hash": "h", "event": "', F.col("p_name"), '"}')), """sha256('{"event":"' || p_name || '","seq":' || p_partkey || '}')""")
scalar("hs02_filing_hashes", "part", KEY, lambda: changes.filing_hash({"from": F.lit("p:1"), "to": F.concat(F.lit("o:"), F.col("p_partkey").cast("string")), "relation": F.lit("director_of"), "source": F.col("p_name"), "percent": F.col("p_size") / 2, "qualifier": F.when(F.col("p_partkey") % 2 == 0, F.lit('a "b"')).otherwise("")}),
       """sha256('{"amount": null, "end_date": null, "evidence_url": null, "filing_date": null, "from": "p:1", "percent": ' || (p_size / 2)::double || ', "qualifier": ' || case when p_partkey % 2 = 0 then '"a \\"b\\""' else 'null' end || ', "relation": "director_of", "source": "' || p_name || '", "source_sha256": null, "start_date": null, "to": "o:' || p_partkey || '"}')""")


@query("pj02_hop_directions", BASE + "select edge_id, source as a, target as b, 'forward' as direction from live union all select edge_id, target, source, 'reverse' from live")
def _(spark, d):
    return load_graph(spark, d).live().adjacency().select("edge_id", "a", "b", "direction")


@query("pj03_citations", "select o_orderkey::varchar as edge_id, o_orderpriority as source, 'https://x.org/' || o_custkey as url, strftime(o_orderdate, '%Y-%m-%d') as date from orders where o_custkey % 3 > 0 and o_orderstatus <> 'P'")
def _(spark, d):
    o = table(spark, d, "orders")
    url = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 3 > 0, F.concat(F.lit("https://x.org/"), F.col("o_custkey").cast("string"))).otherwise(""))
    return review.citations(o.select(F.col("o_orderkey").cast("string").alias("edge_id"), F.col("o_orderpriority").alias("verification_source"), url.alias("citation_url"), D().alias("document_date")))


@query("pj04_exported_identity", """select c_custkey, case c_custkey % 5 when 0 then 'sec_cik=' || lpad(c_custkey::varchar, 10, '0') when 1 then 'canonical_id=UKCH:' || c_custkey when 2 then 'irs_ein=12-' || lpad(c_custkey::varchar, 7, '0')
  when 3 then 'canonical_id=ORCID:X' || c_custkey else '' end as ids from customer""")
def _(spark, d):
    k = F.col("c_custkey").cast("string")
    ids = F.create_map(*[x for s, v in (("sec_cik", F.when(F.col("c_custkey") % 5 == 0, k)), ("uk_company", F.when(F.col("c_custkey") % 5 == 1, k)), ("ein", F.when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("12"), F.lpad(k, 7, "0")))), ("orcid", F.when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("x"), k)))) for x in (F.lit(s), v)])
    out = identity.export_identity(F.col("ids"))
    return table(spark, d, "customer").select("c_custkey", ids.alias("ids")).select("c_custkey", joined(F.transform(F.array_sort(F.map_entries(out)), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("ids"))


@query("sf29_lobbying_roles", "select o_orderkey::varchar as edge_id, o_custkey::varchar as person, o_orderpriority as client, 'Aide to Sen. ' || o_orderstatus as position from orders where o_orderkey % 2 = 0")
def _(spark, d):
    o = table(spark, d, "orders")
    role = F.when(F.col("o_orderkey") % 2 == 0, _text("lobbies for ", F.col("o_orderpriority"), "; former position (disclosed): Aide to Sen. ", F.col("o_orderstatus"))).otherwise("advises")
    return patterns.lobbying_roles(o.select(F.col("o_orderkey").cast("string").alias("edge_id"), F.col("o_custkey").cast("string").alias("person"), role.alias("role_title")))


@query("fl02_not_merged", BASE + "select edge_id from live where source not like '%7' and target not like '%7'")
def _(spark, d):
    from dataclasses import replace

    g = load_graph(spark, d)
    g = replace(g, nodes=g.nodes.withColumn("merged_into", F.when(F.col("id").endswith("7"), "X")))
    return g.live().edges.select("edge_id")


@query("fl08_strict_edges", BASE + "select edge_id from live where relationship_type <> 'nothing' and weight >= 0.6")
def _(spark, d):
    return load_graph(spark, d).strict(hard_only=True, current_only=True, min_weight=0.6).edges.select("edge_id")


@query("fl09_edges_of_sectors", BASE + ", n as (select id from nodes where list_has_any(domains, ['DOM_A', 'DOM_C'])) select edge_id from edges where source in (select id from n) and target in (select id from n)")
def _(spark, d):
    return load_graph(spark, d).strict(domains=("DOM_A", "DOM_C")).edges.select("edge_id")


@query("fl15_reference_forms", "select o_orderkey::varchar as edge_id, o_orderstatus in ('F', 'O') and (o_orderkey % 2 = 0) = (o_orderstatus = 'F') as ok from orders")
def _(spark, d):
    forms = spark.createDataFrame([("F", r"^[0-9]{10}-[0-9]{2}$"), ("O", "SECTION[0-9]"), ("F", "^NEVER$")], "source_type string, pattern string")
    o = table(spark, d, "orders")
    ref = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit(" - 97"))).otherwise("see section 4")
    return review.references_ok(o.select(F.col("o_orderkey").cast("string").alias("edge_id"), F.col("o_orderstatus").alias("source_type"), ref.alias("reference")), forms)
