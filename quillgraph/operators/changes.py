"""Changes to the graph as whole-table steps: reviewed batches, repeated filings, consolidation, confirmations, new ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalars import slug_id
from quillgraph.plans.ranks import numbered

TRIPLE = ("source", "target", "relationship_type")


def apply_batch(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(kind, id, outcome) of a reviewed batch: added, already_present or rejected; nodes first, so that edges may use them.

    nodes and new_nodes: id, label; edges and new_edges: edge_id, source, target, relationship_type. A node without a
    label is rejected, and an edge with an end that is no node afterwards or from a node to itself. Of several
    candidates for one thing the smallest key is added and the rest are present then, so applying a batch again
    changes nothing."""
    n = new_nodes.groupBy("id").agg(F.max(F.when(F.btrim("label") != "", F.col("label"))).alias("label"))
    n = n.join(nodes.select("id", F.lit(True).alias("there")).distinct(), "id", "left")
    n = n.select(F.lit("node").alias("kind"), "id", F.when(F.col("there"), "already_present").when(F.col("label").isNull(), "rejected").otherwise("added").alias("outcome"))
    known = nodes.select("id").union(n.where("outcome = 'added'").select("id")).distinct()
    e = new_edges.join(edges.select(*TRIPLE).distinct().withColumn("there", F.lit(True)), list(TRIPLE), "left")
    for end in ("source", "target"):
        e = e.join(known.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    good = F.col("has_source").isNotNull() & F.col("has_target").isNotNull() & (F.col("source") != F.col("target"))
    first = e.where(good & F.col("there").isNull()).groupBy(*TRIPLE).agg(F.min("edge_id").alias("first"))
    e = e.join(first, list(TRIPLE), "left")
    outcome = F.when(F.col("there"), "already_present").when(~good, "rejected").when(F.col("edge_id") == F.col("first"), "added").otherwise("already_present")
    return n.unionByName(e.select(F.lit("edge").alias("kind"), F.col("edge_id").alias("id"), outcome.alias("outcome")).distinct())


def merged_filings(filings: DataFrame, facts: tuple[str, ...] = ("percent", "is_current")) -> DataFrame:
    """One edge per dedupe key, with first_seen, last_seen, filings, and the facts of the newest filing.

    filings: src, dst, relation, qualifier, source, filing_date, evidence_url and the facts. The key is the hash of
    source node, target node, relation, qualifier and the first word of the filing's source; edges to oneself go."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    kept = (*facts, "source", "evidence_url")
    word = F.substring_index(blank(F.col("source")), " ", 1).alias("__word")
    # Dealt by what the key is made of, which is hashed once an edge; the newest filing is kept once, not once a fact.
    newest = F.max(F.struct("filing_date", "evidence_url", *[F.col(c).alias(f"__{c}") for c in kept if c != "evidence_url"])).alias("__newest")
    e = filings.where("src <> dst").groupBy("src", "dst", "relation", "qualifier", word).agg(
        F.min("filing_date").alias("first_seen"), F.max("filing_date").alias("last_seen"), F.count(F.lit(1)).alias("filings"), newest
    )
    key = F.sha2(F.concat_ws("|", "src", "dst", "relation", blank(F.col("qualifier")), "__word"), 256)
    found = lambda c: F.col(f"__newest.{c}" if c == "evidence_url" else f"__newest.__{c}").alias(c)
    return e.select(key.alias("dedupe_key"), "src", "dst", "relation", "qualifier", "first_seen", "last_seen", "filings", *[found(c) for c in kept])


#: Fields of a filing's edge that its fingerprint covers, by name; the two last are numbers.
EVIDENTIARY = ("end_date", "evidence_url", "filing_date", "from", "qualifier", "relation", "source", "source_sha256", "start_date", "to")
NUMBERS = ("amount", "percent")


def filing_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON (keys in order) of an edge's evidentiary fields; empty texts count as absent."""
    text = lambda c: F.when(c != "", F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]\z", 1))
    number = lambda c: F.when(F.abs(c) < 1e15, F.when(c == F.floor(c), F.concat(F.floor(c).cast("string"), F.lit(".0"))).otherwise(c.cast("string"))).otherwise(c.cast("string"))
    shown = {k: text(fields[k].cast("string")) if k in fields else F.lit(None) for k in EVIDENTIARY}
    shown |= {k: number(fields[k].cast("double")) if k in fields else F.lit(None) for k in NUMBERS}
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(shown[k], F.lit("null"))) for k in sorted(shown)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def consolidated(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """edges with superseded_by, and for every live edge at a merged node a new record at the node it was merged into.

    edges: edge_id, source, target, relationship_type, superseded_by; merged: id, into. The old record stays and points
    to the new one, whose id is the old one's with ``~``; records that would run from a node to itself are not made."""
    e = edges
    for end in ("source", "target"):
        e = e.join(merged.select(F.col("id").alias(end), F.col("into").alias(f"new_{end}")), end, "left").withColumn(f"new_{end}", F.coalesce(f"new_{end}", end))
    moved = F.coalesce(F.col("superseded_by"), F.lit("")) == ""
    moved &= (F.col("new_source") != F.col("source")) | (F.col("new_target") != F.col("target"))
    kept = moved & (F.col("new_source") != F.col("new_target"))
    old = e.select("edge_id", "source", "target", "relationship_type", F.when(kept, F.concat("edge_id", F.lit("~"))).otherwise(F.col("superseded_by")).alias("superseded_by"))
    new = e.where(kept).select(F.concat("edge_id", F.lit("~")).alias("edge_id"), F.col("new_source").alias("source"), F.col("new_target").alias("target"), "relationship_type", F.lit(None).cast("string").alias("superseded_by"))
    return old.unionByName(new)


def ticked(notes: DataFrame) -> DataFrame:
    """(note, key): the back-quoted keys of ticked boxes (``- [x] ... `key` ``) in notes (note, text)."""
    found = F.regexp_extract_all("text", F.lit(r"(?im)^\s*[-*] \[x\][^\n`]*`([^`\n]+)`"), 1)
    return notes.select("note", F.explode(F.array_distinct(found)).alias("key"))


def confirmed(candidates: DataFrame, notes: DataFrame) -> DataFrame:
    """candidates whose key a person ticked in some note."""
    return candidates.join(ticked(notes).select("key").distinct(), "key", "left_semi")


def accepted(sweep: DataFrame) -> DataFrame:
    """(id, basis) of people found by name (id, name, text, address, places, employers): a filed address that a known
    place is part of, or a career text that names an employer; anybody else stays out."""
    has = lambda where, names: F.exists(F.coalesce(names, F.array().cast("array<string>")), lambda n: (n != "") & F.contains(F.lower(F.coalesce(where, F.lit(""))), F.lower(n)))
    basis = F.when(has(F.col("address"), F.col("places")), "address").when(has(F.col("text"), F.col("employers")), "career")
    return sweep.select("id", basis.alias("basis")).where("basis is not null")


def with_next_ids(new: DataFrame, known: DataFrame, *order: str, prefix: str = "EDGE_", digits: int = 3) -> DataFrame:
    """``new`` with edge_id: one more than the largest number at the end of a known edge_id, and so on in ``order``."""
    last = known.agg(F.coalesce(F.max(F.regexp_extract("edge_id", r"(\d+)$", 1).try_cast("long")), F.lit(0)).alias("__last"))
    n = numbered(new, *order, name="__n").join(F.broadcast(last))
    number = (F.col("__last") + F.col("__n")).cast("string")
    shown = F.when(F.length(number) >= digits, number).otherwise(F.lpad(number, digits, "0"))
    return n.withColumn("edge_id", F.concat(F.lit(prefix), shown)).drop("__n", "__last")


def minted_ids(entities: DataFrame, taken: DataFrame) -> DataFrame:
    """(key, id) of (key, label): slugs; the second of one slug gets _2 and so on, by key, counting ids already taken.

    Numbers come from one range sort, so a slug that very many entities share is no task of its own."""
    e = numbered(entities.select("key", slug_id(F.col("label")).alias("slug")), "slug", "key", name="n")
    first = e.groupBy("slug").agg(F.min("n").alias("first"))
    held = taken.select(F.regexp_replace("id", r"_[0-9]+$", "").alias("slug"), F.coalesce(F.regexp_extract("id", r"_([0-9]+)$", 1).try_cast("long"), F.lit(1)).alias("k"))
    held = held.groupBy("slug").agg(F.max("k").alias("held"))
    e = e.join(first, "slug").join(held, "slug", "left")
    nth = F.col("n") - F.col("first") + 1 + F.coalesce("held", F.lit(0))
    return e.select("key", F.when(nth == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", nth.cast("string"))).alias("id"))
