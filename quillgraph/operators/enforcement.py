"""Mentions of known names in releases, and entries of exclusion lists. Every result is only a possible match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import labels
from quillgraph.operators.records import all_tokens_match
from quillgraph.plans.ranks import numbered


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0))


def release_matches(releases: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, uuid, place, kind): names in a release's title, or at least twice in its text.

    releases: uuid, title, text; nodes: id, label, entity_type. Releases and names meet on words first (all the words
    of an organisation's key, first and last word of a person), so patterns run only on pairs that share them. A
    null title or text is empty; names too short for a pattern match nothing; repeated rows give one."""
    person = F.col("entity_type") == "PERSON"
    plain = F.regexp_extract_all(F.lower("label"), F.lit("[a-z0-9]+"), 0)
    ends = F.array_distinct(F.array_compact(F.array(F.try_element_at(plain, F.lit(1)), F.try_element_at(plain, F.lit(-1)))))
    named = nodes.select(
        "id", F.when(person, labels.person_pattern(F.col("label"))).otherwise(labels.org_pattern(F.col("label"))).alias("pattern"),
        F.when(person, ends).otherwise(_tokens(labels.org_key(F.col("label"), article=False))).alias("wanted"),
    ).where("pattern is not null and size(wanted) > 0").dropDuplicates(["id"])
    r = releases.select("uuid", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["uuid"])
    have = r.select(F.col("uuid").alias("doc"), F.explode(_tokens(F.concat_ws(" ", "title", "text"))).alias("token"))
    want = named.select(F.col("id").alias("name"), F.explode("wanted").alias("token"))
    have = have.join(want.select("token").distinct(), "token", "left_semi")
    both = all_tokens_match(have, want).select(F.col("doc").alias("uuid"), F.col("name").alias("id")).join(r, "uuid").join(named.drop("wanted"), "id")
    place = F.when(F.regexp_count("title", F.col("pattern")) > 0, "title").when(F.regexp_count("text", F.col("pattern")) >= 2, "text")
    return both.select("id", "uuid", place.alias("place"), labels.release_kind(F.col("title")).alias("kind")).where("place is not null")


def excluded_people(people: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, entry): same first and last name, same state as the filings, middle initials that do not clash.

    people: id, label, state; listed: entry, first, middle, last, state. Rows without a state match nothing."""
    w = F.filter(labels.words(F.regexp_replace("label", "[.,]", " ")), lambda x: ~F.lower(x).isin("jr", "sr", "ii", "iii", "iv"))
    p = people.select("id", F.upper("state").alias("state"), w.alias("w")).where("size(w) >= 2").select(
        "id", "state", F.lower(F.col("w")[0]).alias("first"), F.lower(F.try_element_at("w", F.lit(-1))).alias("last"),
        F.when(F.size("w") >= 3, F.upper(F.substring(F.try_element_at("w", F.lit(2)), 1, 1))).alias("mid"),
    )
    x = listed.select("entry", F.upper("state").alias("state"), F.lower("first").alias("first"), F.lower("last").alias("last"), F.upper(F.substring(F.btrim("middle"), 1, 1)).alias("xmid"))
    return p.join(x, ["first", "last", "state"]).where("coalesce(mid, '') = '' or coalesce(xmid, '') = '' or mid = xmid").select("id", "entry").distinct()


def excluded_orgs(orgs: DataFrame, listed: DataFrame) -> DataFrame:
    """(id, entry): organisations and entries (entry, name) with one key."""
    key = lambda c: labels.org_key(F.col(c), article=False)
    return orgs.select("id", key("label").alias("k")).where("k <> ''").join(listed.select("entry", key("name").alias("k")), "k").select("id", "entry").distinct()


def ranked_matches(matches: DataFrame, key: str) -> DataFrame:
    """matches (place, entity_type, label, key) with rank: in a title, then a text, then a list; organisations before persons."""
    strength = F.when(F.col("place") == "title", 0).when(F.col("place") == "text", 1).otherwise(2)
    return numbered(matches, strength, (F.col("entity_type") == "PERSON").cast("int"), "label", key)
