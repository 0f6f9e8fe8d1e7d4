"""Checks of a whole graph: every shortfall is a row, nothing is changed or hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.predicates import ID_FORMS, identifier_ok
from quillgraph.functions.scalars import loose_name
from quillgraph.operators.records import duplicate_identifiers


def _issues(df: DataFrame, kind: str, core: str, severity: str | Column, message: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(kind).alias("kind"), "id", F.lit(core).alias("core"), level.alias("severity"), message.alias("message"))


def audit(nodes: DataFrame, identities: DataFrame, edges: DataFrame, domains: list[str], source_types: list[str]) -> DataFrame:
    """(kind, id, core, severity, message): one row per finding.

    nodes: id, domains; identities: id, scheme, value; edges: id, source, target, superseded_by, verification_source,
    citation_url, document_date, source_reference, weight, hash, real_hash. A superseded edge gives one resolved row
    and is not looked at further."""
    known = identities.where(F.col("scheme").isin(*ID_FORMS) & (F.coalesce("value", F.lit("")) != ""))
    none = _issues(nodes.join(known.select("id").distinct(), "id", "left_anti"), "node", "Identity", "error", F.lit("no canonical identifier"))
    wrong = _issues(known.where(~identifier_ok(F.col("scheme"), F.col("value"))), "node", "Identity", "error", F.concat(F.lit("not valid: "), "scheme"))
    twice = _issues(duplicate_identifiers(known), "node", "Identity", "error", F.concat_ws(" ", "scheme", F.lit("is also used by"), "other"))
    unknown = nodes.select("id", F.explode("domains").alias("d")).where(~F.col("d").isin(*domains))
    unknown = _issues(unknown, "node", "Identity", "warning", F.concat(F.lit("unknown domain "), "d"))
    old = F.coalesce("superseded_by", F.lit("")) != ""
    gone = _issues(edges.where(old), "edge", "Integrity", "resolved", F.concat(F.lit("replaced by "), "superseded_by"))
    e = edges.where(~old)
    ends = [
        _issues(e.select("id", F.col(end).alias("end")).join(nodes.select(F.col("id").alias("end")), "end", "left_anti"), "edge", "Identity", "error", F.concat_ws(" ", F.lit(f"{end} is no node:"), "end"))
        for end in ("source", "target")
    ]
    vs = F.coalesce("verification_source", F.lit(""))
    cited = F.array_compact(F.array(*[F.when(F.contains(F.lower(vs), F.lit(s.lower())), F.lit(s)) for s in source_types]))
    # One pass over the edges for all checks of a row by itself.
    lacking = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit("")) == "", F.lit(c)) for c in ("citation_url", "document_date", "source_reference")]))
    finding = lambda when, core, severity, message: F.when(when, F.struct(F.lit(core).alias("core"), severity.alias("severity"), message.alias("message")))
    word = F.lit
    found = F.array_compact(F.array(
        finding(~vs.isin(*source_types), "Transparency", F.when(F.size(cited) > 0, "warning").otherwise("error"), F.when(F.size(cited) > 0, F.concat(word("cites in free text: "), F.array_join(cited, ", "))).otherwise(word("no accepted source type"))),
        finding(F.size(lacking) > 0, "Transparency", word("warning"), F.concat(word("missing "), F.array_join(lacking, ", "))),
        finding(F.coalesce(~F.col("weight").between(0, 1), F.lit(True)), "Integrity", word("error"), word("weight missing or out of range")),
        finding(F.coalesce(F.col("hash") != F.col("real_hash"), F.lit(False)), "Integrity", word("error"), word("edited after it was recorded")),
        finding(F.coalesce("hash", F.lit("")) == "", "Integrity", word("info"), word("no verification hash")),
    ))
    own = e.select("id", F.explode(found).alias("f")).select(F.lit("edge").alias("kind"), "id", "f.core", "f.severity", "f.message")
    out = none
    for part in (wrong, twice, unknown, gone, *ends, own):
        out = out.unionByName(part)
    return out


def likely_duplicates(entities: DataFrame) -> DataFrame:
    """(type, name, ids): several entities (id, type, label) of one type with one loose name."""
    k = entities.select("id", "type", loose_name(F.col("label")).alias("name")).where("name <> ''")
    return k.groupBy("type", "name").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")


def recheck_sources(recorded: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, status): unchanged, changed, or gone, of (url, sha256) as recorded and as fetched again."""
    r = recorded.select("url", "sha256").distinct().join(fetched.select("url", F.col("sha256").alias("now")), "url", "left")
    return r.select("url", F.when(F.col("now").isNull(), "gone").when(F.col("now") == F.col("sha256"), "unchanged").otherwise("changed").alias("status"))


def evidence_gaps(edges: DataFrame) -> DataFrame:
    """(edge_id, gaps) of edges (edge_id, evidence, filing_date, start_date) without evidence or without any date."""
    none = F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0
    undated = F.col("filing_date").isNull() & (F.coalesce("start_date", F.lit("")) == "")
    gaps = F.array_join(F.array_compact(F.array(F.when(none, "no evidence"), F.when(undated, "undated"))), ",")
    return edges.select("edge_id", gaps.alias("gaps")).where("gaps <> ''")
