"""Row predicates and small classifications as column expressions; null input gives false unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.scalars import lei_ok

# How sources of filings begin (upper case) and the type each has; any other source is a lead.
SOURCE_TYPES = (
    (r"^SEC FORM D", "Form D"), (r"^IRS FORM 990", "Form 990"), (r"^UK COMPANIES HOUSE", "UK Companies House"), (r"^SEC FORM [345](/A)?$", "Form 3/4/5"),
    (r"^SEC SCHEDULE 13[DG]", "Schedule 13D/13G"), (r"^SEC 13F-HR", "13F-HR"), (r"^NIH REPORTER", "NIH RePORTER Grant ID"),
)
PRIMARY = r"^(SEC FORM|IRS FORM 990|UK COMPANIES HOUSE)"
SURE_MATCHES = ("high", "registry")
# Words that make a name an organisation's.
ORG_WORDS = (
    "inc corp corporation co company llc lp ltd plc fund funds trust holding holdings partners capital management advisor advisors group bank foundation university institute associates "
    "investment investments ventures securities financial equity sa ag gmbh limited partnership pllc sarl gp endowment pension retirement offshore scsp scs sca sicav aggregator voteco"
).split()
# Words that no person's name holds.
NOT_NAMES = (
    "equity inc corp group fund capital holding holdings partners llc lp ltd plc board committee director chair ceo cfo president trust foundation university bank council 13f def sec"
).split()
# Accepted identifier schemes with their form, and the form of node ids and type tokens.
ID_FORMS = {
    "sec_cik": r"^[0-9]{10}$", "gleif_lei": r"^[A-Z0-9]{18}[0-9]{2}$", "doi": r"^10\.[0-9]{4,9}/\S+$",
    "canonical_id": r"^[A-Z0-9][A-Z0-9:_\-.]{2,63}$", "irs_ein": r"^[0-9]{2}-[0-9]{7}$",
}
NODE_ID = r"^ENT_[A-Z0-9_]{2,60}$"
TYPE_FORM = r"^[A-Z][A-Z0-9_]{2,60}$"


def _whole(pattern: str) -> str:
    return pattern.removesuffix("$") + r"\z"


def _any_word(words: list[str]) -> str:
    return r"(?i)\b(" + "|".join(words) + r")\b"


def source_type(source: Column) -> Column:
    """The type of a filing by its source's beginning; null for anything else, which is only a lead."""
    s = F.upper(source)
    return F.coalesce(*[F.when(s.rlike(form), F.lit(name)) for form, name in SOURCE_TYPES])


def is_primary(source: Column, confidence: Column) -> Column:
    """From a primary source, with no doubt about who the person is (no statement counts as none)."""
    return F.coalesce(F.upper(source).rlike(PRIMARY), F.lit(False)) & (confidence.isNull() | confidence.isin(*SURE_MATCHES))


def is_current(current: Column, end: Column, as_of: Column) -> Column:
    """Not marked as ended and not past its end; unknown flag and unknown end both count as current."""
    ended = F.coalesce(current.cast("int") == 0, F.lit(False))
    return ~ended & ~F.coalesce(end < as_of, F.lit(False))


def is_recent(current: Column, last: Column, filed: Column, as_of: Column, days: int = 456) -> Column:
    """Not marked as ended, and last seen (else filed) within ``days``; without any date false."""
    ended = F.coalesce(current.cast("int") == 0, F.lit(False))
    return ~ended & F.coalesce(F.coalesce(last, filed) >= F.date_sub(as_of, days), F.lit(False))


def looks_like_org(name: Column) -> Column:
    return F.coalesce(name.rlike(_any_word(ORG_WORDS)), F.lit(False))


def plausible_person(name: Column) -> Column:
    """Two to six words, none of an organisation or an office, no digit, the last longer than a letter."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    good = F.size(words).between(2, 6) & ~name.rlike(_any_word(NOT_NAMES)) & ~name.rlike("[0-9]") & (F.length(F.try_element_at(words, F.lit(-1))) > 1)
    return F.coalesce(good, F.lit(False))


def identifier_ok(scheme: Column, value: Column) -> Column:
    """Whether a value has its scheme's form (and, for an LEI, its check digits); unknown schemes are not accepted."""
    ok = F.coalesce(*[F.when(scheme == s, value.rlike(_whole(form))) for s, form in ID_FORMS.items()], F.lit(False))
    return F.coalesce(ok & F.when(scheme == "gleif_lei", lei_ok(value)).otherwise(True), F.lit(False))


def host_allowed(url: Column, hosts: list[str]) -> Column:
    """https, and one of ``hosts`` or a subdomain of it."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#@\s]+)(?=[/:?#]|\z)", 1))
    return F.coalesce(host.isin(*hosts) | F.reduce(F.array(*[F.endswith(host, F.lit("." + h)) for h in hosts]), F.lit(False), lambda a, b: a | b), F.lit(False))


def tenure_ok(start: Column, end: Column, active: Column, as_of: Column) -> Column:
    """Dates of a tenure: each absent or an ISO date, in order, and no past end on an active record."""
    date = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    readable = (F.coalesce(start, F.lit("")) == "") | date(start).isNotNull()
    readable &= (F.coalesce(end, F.lit("")) == "") | date(end).isNotNull()
    return readable & F.coalesce(date(start) <= date(end), F.lit(True)) & ~F.coalesce(active & (date(end) < as_of), F.lit(False))
