"""Claims about roles against the filings, and signals from joins of roles with outside lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.labels import org_key
from quillgraph.functions.names import agreement, match_people, parsed
from quillgraph.plans.graph import Graph


def check_claims(claims: DataFrame, g: Graph) -> DataFrame:
    """(claim_id, status) of (claim_id, person, org, role): the newest filed role of the pair decides."""
    roles = g.edges.groupBy(F.col("source").alias("person"), F.col("target").alias("org")).agg(F.collect_set("relationship_type").alias("filed"))
    orgs = g.nodes.where("entity_type <> 'PERSON'").select(F.col("id").alias("org"), F.lit(True).alias("covered"))
    people = g.edges.select(F.col("source").alias("person")).distinct().withColumn("known", F.lit(True))
    c = claims.join(orgs, "org", "left").join(people, "person", "left").join(roles, ["person", "org"], "left")
    status = (
        F.when(F.col("covered").isNull(), "NO_COVERAGE").when(F.col("known").isNull(), "PERSON_NOT_FOUND").when(F.array_contains("filed", F.col("role")), "CONFIRMED")
        .when(F.col("filed").isNotNull(), "CONFLICT").otherwise("NOT_FILED")
    )
    return c.select("claim_id", status.alias("status"))


def unmentioned_roles(claims: DataFrame, g: Graph) -> DataFrame:
    """(person, org, relationship_type): active roles of claimed persons that no claim mentions."""
    r = g.edges.where(~F.col("active").eqNullSafe(F.lit(False))).select(F.col("source").alias("person"), F.col("target").alias("org"), "relationship_type")
    return r.join(claims.select("person").distinct(), "person", "left_semi").join(claims.select("person", "org"), ["person", "org"], "left_anti").distinct()


def oversight_overlap(g: Graph) -> DataFrame:
    """(person, office, seat, shared): an office at one organisation and a seat at another in a common sector."""
    office = g.of("OFFICER_OF").select(F.col("source").alias("person"), F.col("target").alias("office")).distinct()
    seat = g.of("DIRECTOR_OF").select(F.col("source").alias("person"), F.col("target").alias("seat")).distinct()
    d = g.nodes.select("id", "domains")
    p = office.join(seat, "person").where("office <> seat").join(d.select(F.col("id").alias("office"), F.col("domains").alias("d1")), "office").join(d.select(F.col("id").alias("seat"), F.col("domains").alias("d2")), "seat")
    return p.where(F.arrays_overlap("d1", "d2")).select("person", "office", "seat", F.array_join(F.array_sort(F.array_intersect("d1", "d2")), ",").alias("shared"))


def enforcement_proximity(g: Graph, flagged: DataFrame) -> DataFrame:
    """(flagged, other, person): boards that share a director with a flagged organisation."""
    d = g.of("DIRECTOR_OF").select(F.col("source").alias("person"), F.col("target").alias("org")).distinct()
    a = d.join(flagged.select(F.col("id").alias("org")), "org", "left_semi").select("person", F.col("org").alias("flagged"))
    return a.join(d.select("person", F.col("org").alias("other")), "person").where("flagged <> other").select("flagged", "other", "person")


def check_boards(tables: DataFrame, orgs: DataFrame, filers: DataFrame, registered: DataFrame, as_of: F.Column, days: int = 456) -> DataFrame:
    """(row, company_status, status) of board tables (row, company, person): rows of an ingested company are CONFIRMED,
    CONFLICT (newest filing ended or older than ``days``), AMBIGUOUS or NOT_IN_FILINGS; others take their company's
    NOT_INGESTED (it files, but was not pulled), NO_SEC_COVERAGE, or UNRESOLVED_TABLE (no name of three letters or more).

    orgs: org, label (pulled); filers: org, person_id, name, last_seen, is_current; registered: label."""
    keyed = tables.withColumn("key", org_key(F.col("company")))
    known = orgs.groupBy(org_key(F.col("label")).alias("key")).agg(F.min("org").alias("org"))
    listed = registered.select(org_key(F.col("label")).alias("key"), F.lit(True).alias("listed")).distinct()
    t = keyed.join(known, "key", "left").join(listed, "key", "left")
    company = F.when(F.col("org").isNotNull(), "INGESTED").when(F.length("key") < 3, "UNRESOLVED_TABLE").when(F.col("listed"), "NOT_INGESTED").otherwise("NO_SEC_COVERAGE")
    t = t.withColumn("company_status", company)
    claimed = t.where("org is not null").select("row", "org", parsed(F.col("person")).alias("x")).where("x is not null").withColumn("part", F.explode("x.surnames"))
    filed = filers.select("org", "person_id", "last_seen", "is_current", parsed(F.col("name")).alias("y")).where("y is not null").withColumn("part", F.explode("y.surnames"))
    hits = claimed.join(filed, ["org", "part"]).where(agreement(F.col("x"), F.col("y")).isNotNull())
    found = hits.groupBy("row").agg(F.countDistinct("person_id").alias("people"), F.max("last_seen").alias("last"), F.max_by("is_current", F.struct("last_seen", "is_current")).alias("current"))
    old = F.coalesce(F.datediff(as_of, "last") > days, F.lit(False)) | F.coalesce(F.col("current").cast("int") == 0, F.lit(False))
    status = F.when(F.col("org").isNull(), F.col("company_status")).when(F.col("people").isNull(), "NOT_IN_FILINGS").when(F.col("people") > 1, "AMBIGUOUS").when(old, "CONFLICT").otherwise("CONFIRMED")
    return t.join(found, "row", "left").select("row", "company_status", status.alias("status"))


def check_master(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim_id, status) of (claim_id, person, org), both names, against the graph itself: CONFIRMED, NO_EDGE (both are
    known), ORG_NOT_FOUND or PERSON_NOT_FOUND. Organisations meet by key, persons by agreeing names."""
    org = nodes.where("entity_type <> 'PERSON'").select(F.col("id").alias("org_id"), org_key(F.col("label")).alias("key"))
    c = claims.select("claim_id", F.col("person").alias("name"), org_key(F.col("org")).alias("key"))
    people = nodes.where("entity_type = 'PERSON'").select("id", F.col("label").alias("name"))
    met = match_people(claims.select(F.col("claim_id").alias("id"), F.col("person").alias("name")), people).select(F.col("left_id").alias("claim_id"), F.col("right_id").alias("person_id")).distinct()
    both = c.join(org, "key").join(met, "claim_id")
    tied = both.join(edges.select(F.col("source").alias("person_id"), F.col("target").alias("org_id")).distinct(), ["person_id", "org_id"], "left_semi").select("claim_id").distinct()
    flag = lambda df, name: df.select("claim_id").distinct().withColumn(name, F.lit(True))
    out = c.join(flag(c.join(org, "key", "left_semi"), "has_org"), "claim_id", "left").join(flag(met, "has_person"), "claim_id", "left").join(flag(tied, "tied"), "claim_id", "left")
    status = F.when(F.col("tied"), "CONFIRMED").when(F.col("has_org").isNull(), "ORG_NOT_FOUND").when(F.col("has_person").isNull(), "PERSON_NOT_FOUND").otherwise("NO_EDGE")
    return out.select("claim_id", status.alias("status"))
