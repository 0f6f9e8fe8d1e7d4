"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal words a loose name drops, as a pattern.
LEGAL_WORDS = r"\b(incorporated|inc|corporation|corp|company|co|ltd|limited|llc|lp|plc|ag|sa|nv|bv|gmbh|holdings?|group|the)\b"
# Schemes of identifiers in order of preference.
ID_PRIORITY = ("sec_cik", "lei", "ein", "doi", "orcid", "ror", "nih_project", "openalex", "littlesis", "opensanctions", "cusip", "manual")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def squeeze(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, r"\s+", " "))


def norm_name(c: Column) -> Column:
    """Lower case, & as the word and, anything but letters, digits and underscores as blanks, blanks squeezed."""
    return squeeze(F.regexp_replace(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\p{M}_\s]", " "))


def loose_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(norm_name(c), LEGAL_WORDS, " "))


def slug_id(label: Column, prefix: str = "ENT_", width: int = 50) -> Column:
    """ENT_ and the upper-case label with runs of other characters as underscores, at most ``width`` characters."""
    body = F.regexp_replace(F.regexp_replace(F.upper(label), r"[^A-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.lit(prefix), F.substring(body, 1, width))


def pad_cik(c: Column) -> Column:
    digits = c.cast("string")
    return F.when(F.length(digits) >= 10, digits).otherwise(F.lpad(digits, 10, "0"))


def lei_ok(c: Column) -> Column:
    """ISO 17442: twenty characters whose base-36 digits, written in decimal, leave 1 modulo 97."""
    value = lambda x: F.when(x.rlike("^[0-9]$"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    fold = F.aggregate(
        F.filter(F.split(F.upper(c), ""), lambda x: x != ""), F.lit(0).cast("long"),
        lambda acc, x: (acc * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97,
    )
    return F.coalesce(c.rlike(r"^[0-9A-Za-z]{18}[0-9]{2}\z") & (fold == 1), F.lit(False))


def first_identifier(ids: Column) -> Column:
    """scheme:value of the preferred scheme that is present, else of the first by name."""
    first = F.array_min(F.map_keys(ids))
    known = [F.when(F.coalesce(ids[s], F.lit("")) != "", F.concat(F.lit(f"{s}:"), ids[s])) for s in ID_PRIORITY]
    return F.coalesce(*known, F.concat(first, F.lit(":"), ids[first]))


def strip_html(c: Column) -> Column:
    """Tags out, the common character references decoded, blanks squeezed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def iso_from_us(c: Column) -> Column:
    """ISO date of m/d/Y; null if it is none."""
    return F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date")


def us_title_domains(c: Column) -> Column:
    """Sorted distinct sector letters named after the word Domain or Domains, as in 'Domains A/B, C'."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)domains?\s+([A-G](?:\s*[/,]\s*[A-G])*)"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(found, lambda x: F.split(x, r"\s*[/,]\s*"))), lambda x: x != "")))
