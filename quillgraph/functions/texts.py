"""Smaller text functions as column expressions: keys of organisations, role texts, aliases, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.labels import words
from quillgraph.functions.names import NICKNAMES
from quillgraph.functions.scalars import norm_name, squeeze

# Legal words that keys of private issuers, of registered companies, and of claimed organisations drop.
ISSUER_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "l l c", "ltd", "limited", "lp", "l p", "plc", "the")
REGISTER_FORMS = ("limited", "ltd", "plc", "llp", "the")
CLAIMED_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "ltd", "plc", "the", "foundation", "fund")
STOP_WORDS = ("inc", "corp", "corporation", "co", "company", "the", "llc", "lp", "ltd", "plc", "group", "holdings", "holding", "us", "u", "s", "of", "and")
# Role words of relations in reports.
ROLE_WORDS = {"DIRECTOR_OF": "director", "OFFICER_OF": "officer", "TEN_PERCENT_OWNER_OF": "10%+ owner", "BENEFICIAL_OWNER_OF": "beneficial owner"}


def _without(c: Column, forms: tuple[str, ...]) -> Column:
    return squeeze(F.regexp_replace(c, rf"\b({'|'.join(forms)})\b", " "))


def issuer_key(name: Column) -> Column:
    return _without(norm_name(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", " ")), ISSUER_FORMS)


def register_key(name: Column) -> Column:
    return _without(norm_name(name), REGISTER_FORMS)


def claimed_key(name: Column) -> Column:
    s = F.replace(F.replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\(.*?\)", " "), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    return _without(F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", " "), CLAIMED_FORMS)


def org_words(name: Column) -> Column:
    low = F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and "))
    return F.filter(words(F.regexp_replace(low, "[^a-z0-9 ]", " ")), lambda w: ~w.isin(*STOP_WORDS))


def org_match(claimed: Column, label: Column) -> Column:
    """One name's words are the other's, run together or all among them."""
    a, b = org_words(claimed), org_words(label)
    x, y = F.array_join(a, ""), F.array_join(b, "")
    same = (x == y) | (F.contains(y, x) & (F.length(x) >= 5)) | (F.size(F.array_except(a, b)) == 0)
    return (F.size(a) > 0) & (F.size(b) > 0) & same


def first_names_meet(a: Column, b: Column) -> Column:
    """The older rule for persons: equal surnames, and first or middle names that are equal in full form or share three letters."""
    table = F.create_map(*[F.lit(x) for pair in NICKNAMES.items() for x in pair])
    split = lambda c: F.filter(F.transform(words(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\((.*?)\)", " $1 "))), lambda w: F.btrim(w, F.lit(".,"))), lambda w: (w != "") & ~w.isin("jr", "sr", "ii", "iii", "iv", "dr", "sir", "dame"))
    x, y = split(a), split(b)
    firsts = lambda w: F.transform(F.filter(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda t: F.length(t) > 1), lambda t: F.coalesce(F.try_element_at(table, t), t))
    heads = lambda f: F.transform(f, lambda t: F.substring(t, 1, 3))
    met = F.arrays_overlap(firsts(x), firsts(y)) | F.arrays_overlap(heads(firsts(x)), heads(firsts(y)))
    return F.coalesce((F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))) & met, F.lit(False))


def owner_roles(text: Column) -> Column:
    """Array of (relation, title) that a free text such as 'director, officer: CFO' states; 'other:' only if nothing else."""
    part = lambda form: F.btrim(F.regexp_extract(text, form, 1))
    role = lambda when, relation, title: F.when(when, F.struct(F.lit(relation).alias("relation"), title.alias("title")))
    none = F.lit(None).cast("string")
    officer, other = r"(?i)officer:\s*(.+)", r"(?i)other:\s*(.+)"
    known = F.array_compact(F.array(
        role(text.rlike(r"(?i)\bdirector\b"), "director_of", none), role(text.rlike(officer), "officer_of", part(officer)), role(text.rlike(r"(?i)10\s*percent owner"), "ten_percent_owner_of", none),
    ))
    return F.when((F.size(known) == 0) & text.rlike(other), F.array(role(F.lit(True), "related_to", part(other)))).otherwise(known)


def partial_date(c: Column) -> Column:
    """A date without its unknown parts: 2020-05-00 is 2020-05, 2020-00-00 is 2020."""
    return F.regexp_replace(c, r"(-00)+\z", "")


def own_part(text: Column, begin: str, end: str) -> Column:
    """What stands between two markers, the user's own part of a note; null without both."""
    after = F.substring_index(text, begin, -1)
    return F.when(F.contains(text, F.lit(begin)) & F.contains(after, F.lit(end)), F.substring_index(after, end, 1))


def merged_map(old: Column, new: Column) -> Column:
    """``old`` with the non-empty values of ``new`` in place of its own."""
    news = F.map_filter(new, lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(news, k)), news)


def surname(label: Column) -> Column:
    """Last word of a label, without a generation after it."""
    bare = F.regexp_replace(label, r",?\s+(Jr\.?|Sr\.?|II|III|IV)\s*$", "")
    return F.lower(F.try_element_at(words(bare), F.lit(-1)))


def state_of_role(text: Column) -> Column:
    """Two letters after the last 'for ' of a role text, as in 'U.S. Senator for OH'."""
    return F.when(F.contains(text, F.lit(" for ")), F.substring(F.substring_index(text, " for ", -1), 1, 2))


def folded(c: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def search_hit(query: Column, label: Column) -> Column:
    """Every word of the query begins a word of the label, or is one with at most two letters more."""
    q, l = words(folded(query)), words(folded(label))
    close = lambda a, b: F.startswith(b, a) | (F.startswith(a, b) & (F.length(a) - F.length(b) <= 2))
    return (F.size(q) > 0) & F.forall(q, lambda a: F.exists(l, lambda b: close(a, b)))


def alias_key(c: Column) -> Column:
    """Words of a name in order of the alphabet: one key for all their orders and punctuations."""
    return F.array_join(F.array_sort(words(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9 ]", " "))), " ")


def role_phrase(relation: Column, title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ROLE_WORDS.items() for x in pair])
    word = F.coalesce(F.try_element_at(table, relation), F.lower(F.replace(relation, F.lit("_"), F.lit(" "))))
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(word, F.lit(" ("), title, F.lit(")"))).otherwise(word)


def status_word(active: Column) -> Column:
    return F.when(active.eqNullSafe(F.lit(False)), "historical").otherwise("current")
