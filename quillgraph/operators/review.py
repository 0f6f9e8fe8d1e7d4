"""Review of reports before they are published, and what goes into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a report must contain.
REQUIRED = ("Signals for review, not findings of wrongdoing", "## 2. Scope", "## 3. Method", "## 5. Limits", "## 6. Right of reply", "All sources")


#: Reference forms that may be broadcast.
FORMS_MOST = 100_000


def check_records(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(claim, status): block if the edge is gone, warn if superseded or changed since the draft, else ok.

    claims: claim, edge_id, hash; edges: edge_id, superseded_by, hash."""
    e = edges.select("edge_id", F.coalesce("superseded_by", F.lit("")).alias("superseded_by"), F.col("hash").alias("now"), F.lit(True).alias("found"))
    c = claims.join(e, "edge_id", "left")
    changed = (F.coalesce("hash", F.lit("")) != "") & ~F.col("hash").eqNullSafe(F.col("now"))
    return c.select("claim", F.when(F.col("found").isNull(), "block").when(F.col("superseded_by") != "", "warn").when(changed, "warn").otherwise("ok").alias("status"))


def check_sources(sources: DataFrame, parties: DataFrame) -> DataFrame:
    """(source, status): block without a page or reference in it, warn where a party's number is missing, else ok.

    sources: source, ref, text (null: could not be opened); parties: source, cik."""
    p = parties.groupBy("source").agg(F.collect_set(F.lpad("cik", 10, "0")).alias("ciks"))
    s = sources.join(p, "source", "left")
    lost = F.exists(F.coalesce("ciks", F.array().cast("array<string>")), lambda c: ~F.contains(F.col("text"), c))
    no_ref = (F.coalesce("ref", F.lit("")) != "") & ~F.contains("text", "ref")
    return s.select("source", F.when(F.col("text").isNull() | no_ref, "block").when(lost, "warn").otherwise("ok").alias("status"))


def _between(text: Column, start: str, end: str) -> Column:
    at = F.instr(text, start)
    rest = F.when(at > 0, F.substr(text, at + len(start))).otherwise(text)
    return F.substring_index(rest, end, 1)


def check_structure(reports: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """(doc, missing, unlinked): required parts a report lacks, and finding rows without a source link."""
    t = F.coalesce("text", F.lit(""))
    rows = F.filter(F.split(_between(t, "## 4. Findings", "## 5."), "\n"), lambda l: l.startswith("| ") & ~l.rlike(r"^\| (What|Linked|From)") & ~F.contains(l, F.lit("](http")))
    lacking = F.array_compact(F.array(*[F.when(~F.contains(t, F.lit(n)), F.lit(n)) for n in required]))
    return reports.select("doc", F.array_join(lacking, "; ").alias("missing"), F.size(rows).alias("unlinked"))


def reply_status(reports: DataFrame, named: DataFrame, as_of: Column, wait: int = 14) -> DataFrame:
    """(doc, org, status): done (answered, or asked ``wait`` days ago), waiting, or not_contacted.

    reports: doc, text with a table org | contacted | response under the right of reply; named: doc, org."""
    section = _between(F.coalesce("text", F.lit("")), "## 6. Right of reply", "\n## ")
    line = reports.select("doc", F.posexplode(F.split(section, "\n")).alias("at", "line")).where(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+\s*$", ""), r"\|"), lambda c: F.btrim(c))
    row = line.select("doc", "at", cells.alias("c")).where("size(c) >= 3").select("doc", "at", F.col("c")[0].alias("org"), F.col("c")[1].alias("contacted"), F.col("c")[2].alias("response"))
    row = row.groupBy("doc", "org").agg(F.max_by(F.struct("contacted", "response"), "at").alias("r"))
    asked = F.try_to_timestamp(F.regexp_extract("r.contacted", r"\d{4}-\d{2}-\d{2}", 0), F.lit("yyyy-MM-dd")).cast("date")
    n = named.join(row, ["doc", "org"], "left")
    status = (
        F.when(F.coalesce("r.response", F.lit("")) != "", "done").when(F.coalesce("r.contacted", F.lit("")) == "", "not_contacted")
        .when(F.coalesce(F.datediff(as_of, asked) >= wait, F.lit(False)), "done").otherwise("waiting")
    )
    return n.select("doc", "org", status.alias("status"))


def numbered_sources(citations: DataFrame) -> DataFrame:
    """(doc, number, source, cited): a report's sources, one per reference (else address), newest first.

    citations: doc, ref, url, date. Numbers are per report, so each report is numbered by itself."""
    key = F.coalesce(F.when(F.col("ref") != "", F.col("ref")), F.col("url"))
    s = citations.select("doc", key.alias("source"), "date").where("source is not null").groupBy("doc", "source").agg(F.max("date").alias("date"), F.count(F.lit(1)).alias("cited"))
    w = Window.partitionBy("doc").orderBy(F.desc_nulls_last("date"), "source")
    return s.select("doc", F.row_number().over(w).alias("number"), "source", "cited")


def stage_evidence(evidence: DataFrame, as_of: Column, days: int = 456) -> DataFrame:
    """evidence and outcome (edge, lead or blocked), active, basis.

    evidence: source_type, relation_known, confidence, source_id_ok, target_id_ok, reference, is_current, percent,
    last_seen, filing_date. Leads are secondary sources and persons matched by name only; blocked is evidence whose
    parties or filing cannot be identified."""
    lead = F.col("source_type").isNull() | ~F.coalesce("relation_known", F.lit(False)) | F.coalesce(F.col("confidence") == "name_only", F.lit(False))
    blocked = ~F.coalesce("source_id_ok", F.lit(False)) | ~F.coalesce("target_id_ok", F.lit(False)) | (F.coalesce("reference", F.lit("")) == "")
    last = F.coalesce("last_seen", "filing_date")
    ended = F.coalesce(F.col("is_current").cast("int") == 0, F.lit(False)) | F.coalesce(F.col("percent") == 0, F.lit(False))
    stale = F.coalesce(last < F.date_sub(as_of, days), F.lit(False))
    return evidence.withColumns({
        "outcome": F.when(lead, "lead").when(blocked, "blocked").otherwise("edge"), "active": ~ended & ~stale,
        "basis": F.when(ended, "ended").when(stale, "no recent filing").otherwise("recent filing"),
    })


def citations(edges: DataFrame) -> DataFrame:
    """(edge_id, source, url, date) of edges that can be cited: without an address there is no finding."""
    cited = edges.where(F.coalesce("citation_url", F.lit("")) != "")
    return cited.select("edge_id", F.col("verification_source").alias("source"), F.col("citation_url").alias("url"), F.col("document_date").alias("date"))


def references_ok(edges: DataFrame, forms: DataFrame) -> DataFrame:
    """(edge_id, ok): whether an edge's reference, without blanks and in capitals, has a form its source type may have.

    edges: edge_id, source_type, reference; forms: source_type, pattern (found anywhere, unless it is anchored itself)."""
    r = F.upper(F.regexp_replace(F.coalesce("reference", F.lit("")), r"\s+", ""))
    f = edges.select("edge_id", "source_type", r.alias("r")).join(F.broadcast(forms) if forms.count() <= FORMS_MOST else forms, "source_type", "left")
    return f.groupBy("edge_id").agg(F.coalesce(F.max(F.expr("r rlike pattern")), F.lit(False)).alias("ok"))


def stale_reviews(reviews: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc) of reviews (doc, sha256 of the report they read) whose report is another one now, or is gone."""
    now = reports.select("doc", F.sha2("text", 256).alias("now"))
    return reviews.join(now, "doc", "left").where("now is null or now <> sha256").select("doc")


def reports_due(ranked: DataFrame, state: DataFrame, fingerprints: DataFrame, top: int) -> DataFrame:
    """(id, rank) of the ``top`` ranked entities (id, rank) whose claims changed since their last report, or that have none.

    fingerprints: id, sha256; state: id, sha256 as of the last report."""
    now = ranked.where(F.col("rank") <= top).join(fingerprints, "id")
    return now.join(state, ["id", "sha256"], "left_anti").select("id", "rank")


def due_again(done: DataFrame, keys: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(key) of ``keys`` never done, or done (key, day) more than ``days`` ago."""
    last = done.groupBy("key").agg(F.max("day").alias("day"))
    return keys.select("key").distinct().join(last, "key", "left").where(F.col("day").isNull() | (F.datediff(as_of, "day") > days)).select("key")


def rendered(parts: DataFrame) -> DataFrame:
    """(doc, text): reports from their rows (doc, section, heading, line, text): headings once, lines in order, a blank
    line between sections, everything escaped for Markdown tables. A report is one text, so its rows come together."""
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    of = parts.groupBy("doc", "section").agg(F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("line", safe.alias("text")))).alias("l"))
    one = F.concat(F.lit("## "), "heading", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["text"]), "\n"))
    return of.select("doc", "section", one.alias("t")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
