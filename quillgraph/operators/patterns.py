"""Signals: office and boardroom, lobbyists and lawmakers. Every one is a lead for review with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.names import agreement, parsed
from quillgraph.functions.scalars import squeeze

# Titles before a lawmaker's name, by chamber, and words that end such a phrase without a name.
TITLES = {"senator": "Sen\\.|Senator", "representative": "Rep\\.|Representative|Congressman|Congresswoman"}
NO_NAMES = ("cmte", "committee", "comm", "subcommittee", "office", "staff")
ROLE_TEXT = r"(?s)^lobbies for (.+?); former position \(disclosed\): (.+)\z"


def boardroom_after_office(offices: DataFrame, roles: DataFrame) -> DataFrame:
    """(person, org, left, first, years): former office holders with a current corporate role.

    offices: person, active, title; roles: person, org, active, first_filing. ``left`` is the last year the title
    names; ``years`` from it to the first filing, where that is not before."""
    years = F.regexp_extract_all("title", F.lit(r"(\d{4})"), 1)
    former = offices.where("active = false").select("person", F.try_element_at(years, F.lit(-1)).cast("int").alias("left"))
    now = roles.where(~F.col("active").eqNullSafe(F.lit(False))).select("person", "org", F.year("first_filing").alias("first")).distinct()
    return former.join(now, "person").select("person", "org", "left", "first", F.when(F.col("first") >= F.col("left"), F.col("first") - F.col("left")).alias("years")).distinct()


def lobbying_roles(edges: DataFrame) -> DataFrame:
    """(edge_id, person, client, position) of role texts 'lobbies for X; former position (disclosed): Y'."""
    part = lambda n: F.regexp_extract("role_title", ROLE_TEXT, n)
    return edges.where(F.col("role_title").rlike(ROLE_TEXT)).select("edge_id", "person", part(1).alias("client"), part(2).alias("position"))


def named_lawmakers(roles: DataFrame) -> DataFrame:
    """(edge_id, chamber, name): names that follow a lawmaker's title in former positions, generations left out."""
    out = None
    for chamber, titles in TITLES.items():
        found = F.regexp_extract_all("position", F.lit(rf"\b(?:{titles})\s+((?:[A-Z][\w.'-]*\s+){{0,3}}[A-Z][\w'-]+)"), 1)
        one = roles.select("edge_id", F.lit(chamber).alias("chamber"), F.explode(found).alias("raw"))
        out = one if out is None else out.unionByName(one)
    name = squeeze(F.regexp_replace("raw", r"(?<!\S)(Jr|Sr|II|III|IV)[.,]?(?!\S)", ""))
    return out.select("edge_id", "chamber", name.alias("name")).where("name <> ''").where(~F.lower(F.substring_index("name", " ", -1)).isin(*NO_NAMES)).distinct()


def lobbyist_links(edges: DataFrame, lawmakers: DataFrame, seats: DataFrame, committees: DataFrame, orgs: DataFrame) -> DataFrame:
    """(person, lawmaker, client, committees): lobbyists whose former position names a sitting lawmaker with a seat on a
    committee that oversees a sector of the client.

    edges: edge_id, person, role_title; lawmakers: id, name, chamber; seats: lawmaker, committee; committees: committee,
    domains; orgs: id, label, domains. A bare surname names every lawmaker of it; longer names must agree."""
    roles = lobbying_roles(edges)
    last = F.element_at("x.surnames", -1)
    known = lawmakers.select("id", "chamber", parsed(F.col("name")).alias("x")).where("x is not null").withColumn("last", last)
    said = named_lawmakers(roles).withColumn("last", F.lower(F.element_at(F.split(F.substring_index("name", " ", -1), "-"), -1)))
    alone = ~F.contains("name", F.lit(" "))
    met = said.join(known, ["chamber", "last"]).where(alone | agreement(F.col("x"), parsed(F.col("name"))).isNotNull()).select("edge_id", F.col("id").alias("lawmaker")).distinct()
    client = roles.join(orgs.select(F.col("id").alias("client_id"), F.col("label").alias("client"), F.col("domains").alias("of_client")), "client")
    over = met.join(client, "edge_id").join(seats, "lawmaker").join(committees, "committee").where(F.arrays_overlap("domains", "of_client"))
    return over.groupBy("person", "lawmaker", F.col("client_id").alias("client")).agg(F.array_join(F.array_sort(F.collect_set("committee")), ",").alias("committees"))


def signals_of(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, key, type): signals (key, type, subjects) by each of ``entities`` (id) that they are about."""
    s = signals.select("key", "type", F.explode(F.array_distinct("subjects")).alias("entity"))
    return s.join(entities.select(F.col("id").alias("entity")).distinct(), "entity", "left_semi").select("entity", "key", "type")
