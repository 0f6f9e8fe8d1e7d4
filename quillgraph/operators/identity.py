"""Who is who: identifiers, assembled entities, merges, the two-fact rule for persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.names import match_people, parsed
from quillgraph.functions.predicates import ID_FORMS, NODE_ID, TYPE_FORM, identifier_ok, looks_like_org
from quillgraph.functions.scalars import ID_PRIORITY, norm_name, pad_cik
from quillgraph.functions.texts import alias_key
from quillgraph.operators.components import connected_components
from quillgraph.operators.paths import follow_supersession
from quillgraph.plans.staging import Staging

OFFICIAL = ("sec_cik", "uk_officer", "lei")


def clean_value(scheme: Column, value: Column) -> Column:
    """A value in its scheme's usual form: padded CIK, upper-case LEI and canonical id, bare lower-case DOI; null if empty."""
    v = F.btrim(value)
    out = (
        F.when((scheme == "sec_cik") & v.rlike(r"^[0-9]+\z"), pad_cik(v)).when(scheme.isin("gleif_lei", "canonical_id"), F.upper(v))
        .when(scheme == "doi", F.lower(F.regexp_replace(v, r"(?i)^https?://(dx\.)?doi\.org/", ""))).otherwise(v)
    )
    return F.when(out != "", out)


def export_identity(ids: Column) -> Column:
    """Map of registry identifiers as they are published; empty if an entity has none (it is then blocked)."""
    has = lambda s: F.coalesce(ids[s], F.lit("")) != ""
    strong = has("sec_cik") | has("lei") | has("doi")
    house, officer = ~strong & has("uk_company"), ~strong & ~has("uk_company") & has("uk_officer")
    rest = ~strong & ~has("uk_company") & ~has("uk_officer") & ~has("ein")
    canonical = (
        F.when(house, F.concat(F.lit("UKCH:"), ids["uk_company"])).when(officer, F.concat(F.lit("UKCH-OFFICER:"), F.upper(ids["uk_officer"])))
        .when(rest & has("orcid"), F.concat(F.lit("ORCID:"), F.upper(ids["orcid"]))).when(rest & has("nih_project"), F.concat(F.lit("NIH-PROJECT:"), F.upper(ids["nih_project"])))
        .when(rest & has("nih_pi"), F.concat(F.lit("NIH-PI:"), ids["nih_pi"]))
    )
    ein = F.concat(F.substring(ids["ein"], 1, 2), F.lit("-"), F.substring(ids["ein"], 3, 1 << 20))
    found = {
        "sec_cik": F.when(has("sec_cik"), pad_cik(ids["sec_cik"])), "gleif_lei": F.when(has("lei"), ids["lei"]), "doi": F.when(has("doi"), ids["doi"]),
        "canonical_id": canonical, "uk_officer_id": F.when(officer, ids["uk_officer"]), "irs_ein": F.when(has("ein"), ein),
    }
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def entity_type(kind: Column, listed: Column, private: Column, nonprofit: Column) -> Column:
    """Published type: nonprofit, then private issuer, then listed company with an industry, then the kind's own."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    own = F.when(kind == "person", "PERSON").when(kind == "grant", "RESEARCH_GRANT").when(kind == "work", "SCIENTIFIC_STUDY").otherwise("ORGANIZATION")
    return F.when(yes(nonprofit), "NONPROFIT").when(yes(private), "PRIVATE_COMPANY").when((kind == "organization") & yes(listed), "CORPORATION").otherwise(own)


def assemble(entities: DataFrame, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """entities with ids (map; the largest value of a repeated scheme) and aliases (sorted, distinct)."""
    one = ids.where("scheme is not null").groupBy("id", "scheme").agg(F.max("value").alias("value"))
    m = one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scheme", "value")))).alias("ids"))
    a = aliases.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return entities.join(m, "id", "left").join(a, "id", "left")


def find_by_name(wanted: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id, by): entities of a normalised name; aliases only where no entity has the name itself."""
    w = wanted.select("name", norm_name(F.col("name")).alias("k")).where("k <> ''").distinct()
    direct = w.join(entities.select("id", norm_name(F.col("label")).alias("k")), "k").select("name", "id", F.lit("name").alias("by"))
    rest = w.join(direct.select("name").distinct(), "name", "left_anti")
    other = rest.join(aliases.select("id", norm_name(F.col("alias")).alias("k")), "k").select("name", "id", F.lit("alias").alias("by"))
    return direct.unionByName(other).distinct()


def find_by_identifier(wanted: DataFrame, ids: DataFrame) -> DataFrame:
    return wanted.join(ids.select("scheme", "value", "id"), ["scheme", "value"])


def canonical_id(ids: DataFrame) -> DataFrame:
    """(id, canonical) by the schemes' order of preference, other schemes after them by name."""
    rank = F.coalesce(*[F.when(F.col("scheme") == s, F.lit(n)) for n, s in enumerate(ID_PRIORITY)], F.lit(len(ID_PRIORITY)))
    first = F.min(F.struct(rank.alias("rank"), "scheme", "value"))
    return ids.where("value <> ''").groupBy("id").agg(first.alias("f")).select("id", F.concat_ws(":", "f.scheme", "f.value").alias("canonical"))


def merged_by_identifier(ids: DataFrame, staging: Staging) -> DataFrame:
    """(id, keep): records that share any identifier, directly or through others, with the smallest id of each group.

    An identifier links its holders to its smallest one, so a shared one makes links, not pairs."""
    known = ids.where("value <> ''").select("scheme", "value", "id").distinct()
    least = known.groupBy("scheme", "value").agg(F.min("id").alias("lo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    links = known.join(least, ["scheme", "value"]).select(F.col("id").alias("src"), F.col("lo").alias("dst"))
    found = connected_components(links, staging)
    return known.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("keep"))


def apply_merges(edges: DataFrame, merges: DataFrame, keys: tuple[str, ...] = ("relationship_type",)) -> DataFrame:
    """(source, target, keys, seen): edges with merged ends moved, loops gone, equal ones counted together."""
    e = edges
    # Merges are hashed, not sorted with the edges: a task then holds its merges, of which an id has one, and no edges.
    moved = merges.where("id <> keep").hint("shuffle_hash")
    for end in ("source", "target"):
        m = moved.select(F.col("id").alias(end), F.col("keep").alias(f"__{end}"))
        e = e.join(m, end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return e.where("source <> target").groupBy("source", "target", *keys).agg(F.count(F.lit(1)).alias("seen"))


def _shared_orgs(pairs: DataFrame, ties: DataFrame) -> DataFrame:
    t = ties.select("person", "org").distinct()
    a = pairs.join(t.withColumnRenamed("person", "a"), "a").join(t.withColumnRenamed("person", "b"), ["b", "org"])
    return a.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


def same_person(people: DataFrame, ties: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(a, b, match, decision, keep): pairs of records with one name, merged only with a second fact.

    people: id long, name, ids map; ties: person, org; listed: (a, b) pairs whose filing lists the official record.
    Equal official ids: no row; different ones: held, and only if they share an organisation. Otherwise a shared
    organisation or a listing merges, where initials alone need the organisation; the rest is held. ``keep`` is the official record, else
    the longer name, else the smaller id. A record takes part in one merge: the first by (keep, other) of either."""
    found = match_people(people.select("id", "name"), people.select("id", "name"), facts=True).where("left_id < right_id").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "kind")
    official = lambda c: F.map_filter(F.coalesce(c, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*OFFICIAL) & (v != ""))
    facts = people.select("id", "name", F.length("name").alias("long"), F.array_join(F.array_sort(F.transform(F.map_entries(official(F.col("ids"))), lambda x: F.concat_ws(":", x["key"], x["value"]))), ",").alias("off"))
    for end in ("a", "b"):
        found = found.join(facts.withColumnsRenamed({"id": end, "name": f"name_{end}", "long": f"long_{end}", "off": f"off_{end}"}), end)
    found = found.join(_shared_orgs(found.select("a", "b"), ties), ["a", "b"], "left")
    found = found.join(listed.select("a", "b", F.lit(True).alias("listing")), ["a", "b"], "left") if listed is not None else found.withColumn("listing", F.lit(None).cast("boolean"))
    both, one = (F.col("off_a") != "") & (F.col("off_b") != ""), (F.col("off_a") != "") != (F.col("off_b") != "")
    decision = (
        F.when(both & (F.col("off_a") == F.col("off_b")), None).when(both, F.when(F.col("shared").isNotNull(), "held"))
        .when(F.col("shared").isNotNull(), "merge").when(one & F.col("listing") & (F.col("kind") != "initials"), "merge").otherwise("held")
    )
    first = F.when(both | (F.col("off_a") == "") & (F.col("off_b") == ""), (F.col("long_a") >= F.col("long_b"))).otherwise(F.col("off_a") != "")
    found = found.select("a", "b", F.col("kind").alias("match"), decision.alias("decision"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep")).where("decision is not null")
    rank = F.struct("keep", "a", "b")
    merges = found.where("decision = 'merge'")
    least = merges.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r")).groupBy("id").agg(F.min("r").alias("r"))
    for end in ("a", "b"):
        merges = merges.join(least.select(F.col("id").alias(end), F.col("r").alias(f"r_{end}")), end)
    now = (F.col("r_a") == rank) & (F.col("r_b") == rank)
    merges = merges.withColumn("decision", F.when(now, "merge").otherwise("later")).select("a", "b", "match", "decision", "keep")
    return merges.unionByName(found.where("decision = 'held'"))


def first_matching(pairs: DataFrame, staging: Staging) -> DataFrame:
    """The pairs (a, b, keep) that one after the other in the order (keep, a, b) would take if a record were in one pair only.

    Each round takes all pairs that come first for both their records, and drops those that touch them; that is the
    same choice as the sequential one."""
    rank = F.struct("keep", "a", "b")
    left, taken = staging.write(pairs.select("a", "b", "keep").distinct(), "left"), []
    while not left.isEmpty():
        least = left.select(F.explode(F.array("a", "b")).alias("id"), rank.alias("r")).groupBy("id").agg(F.min("r").alias("r"))
        now = left
        for end in ("a", "b"):
            now = now.join(least.select(F.col("id").alias(end), F.col("r").alias(f"r_{end}")), end)
        taken.append(staging.write(now.where((F.col("r_a") == rank) & (F.col("r_b") == rank)).select("a", "b", "keep"), "taken"))
        used = taken[-1].select(F.explode(F.array("a", "b")).alias("id"))
        for end in ("a", "b"):
            left = left.join(used.select(F.col("id").alias(end)), end, "left_anti")
        left = staging.write(left.select("a", "b", "keep"), "left")
    return staging.together(taken) if taken else left


def settle_people(people: DataFrame, ties: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(id, keep): each record and the one it is merged into in the end, itself if none.

    Runs of ``same_person`` go on until one merges nothing. In each run the merges are taken in order, a record in one of
    them; then ties, listings and identifiers of the records that went are those of the ones that stay (whose own
    values come first), so that what two records know together can bring in a third."""
    st = Staging(people.sparkSession, "settle")
    now = st.write(people.select("id", "name", F.coalesce("ids", F.create_map().cast("map<string,string>")).alias("ids")), "people")
    ties = st.write(ties.select("person", "org").distinct(), "ties")
    moves = []
    while True:
        found = st.write(same_person(now, ties, listed).where("decision in ('merge', 'later')"), "found")
        pairs = st.write(first_matching(found, st), "pairs")
        if pairs.isEmpty():
            break
        moved = st.write(pairs.select(F.when(F.col("keep") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("gone"), "keep"), "moved")
        moves.append(moved)
        at = lambda c: F.coalesce(f"to_{c}", c)
        to = lambda c: moved.select(F.col("gone").alias(c), F.col("keep").alias(f"to_{c}"))
        ties = st.write(ties.join(to("person"), "person", "left").select(at("person").alias("person"), "org").distinct(), "ties")
        if listed is not None:
            both = listed.join(to("a"), "a", "left").join(to("b"), "b", "left").select(at("a").alias("x"), at("b").alias("y")).where("x <> y")
            listed = st.write(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "listed")
        given = now.join(moved.withColumnRenamed("gone", "id"), "id").select(F.col("keep").alias("id"), F.col("ids").alias("more"))
        missing = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("ids", k))
        now = now.join(moved.select(F.col("gone").alias("id")), "id", "left_anti").join(given, "id", "left").select("id", "name", F.map_concat("ids", missing).alias("ids"))
        now = st.write(now, "people")
    links = people.select("id").distinct()
    if not moves:
        return links.select("id", F.col("id").alias("keep"))
    links = links.join(st.together(moves).withColumnsRenamed({"gone": "id", "keep": "superseded_by"}), "id", "left")
    return follow_supersession(links).select("id", F.col("live").alias("keep"))


def surname_change_pairs(people: DataFrame, ties: DataFrame) -> DataFrame:
    """(a, b, shared): one first name, other surnames, one of which is the other's middle name, and shared organisations.

    people: id, name. Candidates meet on (first name, surname as middle name), never on the first name alone."""
    w = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("name", F.lit("")), r"\(.*?\)|[.,]", " ")), r"\s+"), lambda x: x != "")
    p = people.select("id", w.alias("w")).where("size(w) >= 2").select("id", F.col("w")[0].alias("first"), F.try_element_at("w", F.lit(-1)).alias("last"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))).alias("middle"))
    x = p.select(F.col("id").alias("x"), "first", F.col("last").alias("x_last"), F.explode(F.array_distinct("middle")).alias("last"))
    y = p.select(F.col("id").alias("y"), "first", "last")
    pairs = x.join(y, ["first", "last"]).where("x <> y and not arrays_overlap(split(x_last, '-'), split(last, '-'))")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _shared_orgs(pairs, ties)


def retyped(nodes: DataFrame) -> DataFrame:
    """(id, label): persons whose name is an organisation's."""
    return nodes.where(F.col("entity_type") == "PERSON").where(looks_like_org(F.col("label"))).select("id", "label")


def resolve_people(claimed: DataFrame, people: DataFrame) -> DataFrame:
    """(claim, id, confidence): high for the one match with a second fact (same city, or a claimed tie, which alone
    serves a bare initial), name_only for the one match without, unlinked for none or several.

    claimed: id, name, city, backed (boolean); people: id, name, city."""
    m = match_people(claimed.select("id", "name"), people.select("id", "name")).withColumnsRenamed({"left_id": "claim", "right_id": "id"})
    n = m.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.min("kind").alias("kind"))
    c = claimed.select(F.col("id").alias("claim"), F.lower(F.btrim("city")).alias("city"), F.coalesce("backed", F.lit(False)).alias("backed")).join(n, "claim", "left")
    c = c.join(people.select("id", F.lower(F.btrim(F.substring_index("city", ",", 1))).alias("filed")), "id", "left")
    same = F.coalesce((F.col("city") != "") & (F.col("city") == F.col("filed")), F.lit(False))
    sure = F.col("backed") | (same & (F.col("kind") != "initial"))
    confidence = F.when(F.coalesce(F.col("n"), F.lit(0)) != 1, "unlinked").when(sure, "high").otherwise("name_only")
    return c.select("claim", F.when(F.col("n") == 1, F.col("id")).alias("id"), confidence.alias("confidence"))


def choose_org(candidates: DataFrame) -> DataFrame:
    """(name, id, hits) of (name, id, hits): the candidate most claimed people were found at, if at least one and no tie."""
    w = Window.partitionBy("name").orderBy(F.desc("hits"), "id")
    return candidates.select("name", "id", "hits", F.lead("hits").over(w).alias("next"), F.row_number().over(w).alias("rn")).where("rn = 1 and hits >= 1 and (next is null or next < hits)").select("name", "id", "hits")


def validate_nodes(candidates: DataFrame, nodes: DataFrame, held: DataFrame, domains: list[str]) -> DataFrame:
    """(id, errors): the fields of new nodes that fail, sorted and joined; empty where none does.

    candidates: id, label, entity_type, domains, identity map; nodes: id; held: scheme, value of existing nodes."""
    c = candidates.select("id", "label", "entity_type", F.coalesce("domains", F.array().cast("array<string>")).alias("domains"), F.coalesce("identity", F.create_map().cast("map<string,string>")).alias("identity"))
    c = c.join(nodes.select("id", F.lit(True).alias("exists")).distinct(), "id", "left")
    one = c.select("id", F.explode("identity").alias("scheme", "raw")).select("id", "scheme", clean_value(F.col("scheme"), F.col("raw")).alias("value")).where("value is not null")
    one = one.join(held.select("scheme", "value", F.lit(True).alias("taken")).distinct(), ["scheme", "value"], "left")
    accepted = F.col("scheme").isin(*ID_FORMS)
    wrong = F.coalesce(F.col("taken"), F.lit(False)) | (accepted & ~identifier_ok(F.col("scheme"), F.col("value")))
    bad = one.groupBy("id").agg(F.max(accepted).alias("any"), F.collect_set(F.when(wrong, F.concat(F.lit("identity."), "scheme"))).alias("bad"))
    c = c.join(bad, "id", "left")
    rules = [
        ("label", F.btrim(F.coalesce("label", F.lit(""))) == ""), ("id", ~F.col("id").rlike(NODE_ID) | F.col("exists").isNotNull()),
        ("entity_type", ~F.coalesce("entity_type", F.lit("")).rlike(TYPE_FORM)),
        ("domains", (F.size("domains") == 0) | (F.size(F.array_except("domains", F.array(*[F.lit(d) for d in domains]))) > 0)), ("identity", ~F.coalesce("any", F.lit(False))),
    ]
    errors = F.concat(F.array_compact(F.array(*[F.when(F.coalesce(b, F.lit(True)), F.lit(n)) for n, b in rules])), F.coalesce("bad", F.array().cast("array<string>")))
    return c.select("id", F.array_join(F.array_sort(errors), ",").alias("errors"))


def identity_additions(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """(id, scheme, value, status): added, already_set, overwrite (never allowed), taken or invalid.

    wanted and held: id, scheme, value. Identifiers may be added to a node, never changed."""
    w = wanted.select("id", "scheme", clean_value(F.col("scheme"), F.col("value")).alias("value")).where("value is not null").distinct()
    own = held.groupBy("id", "scheme").agg(F.max("value").alias("was"))
    other = held.groupBy("scheme", "value").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    w = w.join(own, ["id", "scheme"], "left").join(other, ["scheme", "value"], "left")
    status = (
        F.when(F.col("was") == F.col("value"), "already_set").when(F.col("was").isNotNull(), "overwrite")
        .when((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id")), "taken").when(~identifier_ok(F.col("scheme"), F.col("value")), "invalid").otherwise("added")
    )
    return w.select("id", "scheme", "value", status.alias("status"))


def inherited_domains(roles: DataFrame, orgs: DataFrame) -> DataFrame:
    """(person, domains): the sorted sectors of a person's organisations, and BRIDGE_HUMAN where there are two or more."""
    d = roles.select(F.col("source").alias("person"), F.col("target").alias("id")).distinct().join(orgs.select("id", F.explode("domains").alias("d")), "id").where(F.col("d").startswith("DOM_"))
    s = d.groupBy("person").agg(F.array_sort(F.collect_set("d")).alias("domains"))
    return s.withColumn("domains", F.when(F.size("domains") >= 2, F.concat("domains", F.array(F.lit("BRIDGE_HUMAN")))).otherwise(F.col("domains")))


def known_aliases(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, alias): aliases worth keeping: one per set of words, none that only reorders the label; mixed case before capitals.

    labels: id, label; aliases: id, alias."""
    a = aliases.select("id", "alias", alias_key(F.col("alias")).alias("key")).where("key <> ''")
    own = labels.select("id", alias_key(F.col("label")).alias("key"))
    a = a.join(own, ["id", "key"], "left_anti")
    return a.groupBy("id", "key").agg(F.min(F.struct((F.col("alias") == F.upper("alias")).alias("loud"), "alias")).alias("best")).select("id", F.col("best.alias").alias("alias"))


def earlier_surnames(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, surname): other surnames a person with an official id is known by, with the first name it has now.

    people: id, name, ids; aliases: id, alias."""
    official = F.map_filter(F.coalesce("ids", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*OFFICIAL) & (v != ""))
    now = people.where(F.size(official) > 0).select("id", parsed(F.col("name")).alias("x")).where("x is not null")
    then = aliases.select("id", parsed(F.col("alias")).alias("y")).where("y is not null")
    return now.join(then, "id").where("arrays_overlap(x.firsts, y.firsts) and not arrays_overlap(x.surnames, y.surnames)").select("id", F.col("y.last").alias("surname")).distinct()


def by_any_identifier(wanted: DataFrame, held: DataFrame, merged: DataFrame) -> DataFrame:
    """(key, id): the node of each wanted record (key, scheme, value) by any identifier: a node that was not merged away
    first, then by scheme and id. held: id, scheme, value; merged: id."""
    h = held.join(merged.select("id", F.lit(1).alias("gone")).distinct(), "id", "left")
    hits = wanted.join(h, ["scheme", "value"])
    return hits.groupBy("key").agg(F.min_by("id", F.struct(F.coalesce("gone", F.lit(0)), "scheme", "id")).alias("id"))


def index_of(nodes: DataFrame) -> DataFrame:
    """(scheme, value, id, holders): who owns each identifier of nodes (id, identity map, merged): the smallest node that
    was not merged away, which alone keep their identifiers, and how many there are."""
    one = nodes.where(~F.coalesce("merged", F.lit(False))).select("id", F.explode("identity").alias("scheme", "value")).where("value <> ''")
    return one.groupBy("scheme", "value").agg(F.min("id").alias("id"), F.countDistinct("id").alias("holders"))
