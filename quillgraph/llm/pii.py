"""Personal data by fixed patterns and by bootstrapped contexts.

The base kinds are found by their patterns. Then contexts take over. Candidates are the values of the base kinds,
all tokens that hold a digit, and whatever follows a label (``word:`` or ``word=``): a token of any length, with or
without digits, or a run of capitalised words, with a house number before it or not. Every candidate stands in a
lexical pattern, made of the word and punctuation before it, its shape, and the character after it; after a label
also in the pattern of that label for values of any shape.

Seed entities are the values of the base kinds, tokens with the known beginnings of ``SEED_HEADS``, long runs of hex
digits that are assigned to something, and values after the few labels of ``SEED_LABELS``. In Spark, patterns and
values score each other over the pattern-value graph for some rounds: a pattern by the mean score of its values, a
value by the noisy-or of its patterns. Patterns that score high and hold several values are trusted, and all their
values are spans, seen before or not. Assigned hex runs are evidence only: they are spans where their pattern is
trusted. Base spans always stay; no other span overlaps one.

One pass over the texts writes a small table of spans and candidates; the rounds and the final marking work
on that. Aggregations combine before the shuffle, so a pattern with a third of all candidates is no hot spot.

Odd input: a null text is empty; a text without findings has zero counts, the SHA-256 of the empty string
and an empty ``spans``; every row gives a row, exact repeats of a row included; a null doc_id stays null;
extra columns are ignored. Regular expressions run in linear time on any text. Not found are values without a digit
that no label stands before, and patterns with fewer than ``least_values`` distinct values.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.staging import Staging

KINDS = ("email", "ip", "card", "phone")
# Labels whose values are seeds, with their kind.
SEED_LABELS = {"password=": "secret", "api_key=": "secret", "ssn: ": "ssn", "patient: ": "name", "residence: ": "address"}
# Beginnings of values that are seeds themselves, with their kind.
SEED_HEADS = {"AKIA": "secret", "ghp_": "secret", "xoxb-": "secret"}
#: Hex digits in a row from which an assigned value is taken for a secret.
LEAST_HEX = 32
#: Rounds of scoring; least score of a pattern that marks values; least number of distinct values it holds.
ROUNDS, LEAST_SCORE, LEAST_VALUES = 3, 0.6, 3
#: Trusted patterns that may be broadcast (some 60 bytes each).
BROADCAST_PATTERNS = 500_000

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A dotted number cannot start inside a run of digits: if the run's own start fails, so do the others.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
VALUE = re.compile(r"[A-Za-z0-9_-]*")
VALUE_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
LABEL = re.compile(r"(?<=[^\W\d])[\"']?[ ]?[=:][ ]?[\"']?(?=[^\s=:\"'/,;.!?)])")
TOKEN = re.compile(r"[^\s\"'<>,;(){}\[\]|]+")
RUN = re.compile(r"(?:[0-9]{1,6} )?[^\W\d_][^\W\d_]*(?:[ -][^\W\d_]+){1,3}")
BEFORE = re.compile(r"([^\W\d]{0,24})([^\w]{0,4})\Z")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
SPACE = re.compile(r"\s+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        free = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", free)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [(0, *s) for s in _emails(text)]
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _shape(value: str) -> str:
    if "@" in value:
        return "mail"
    if " " in value and value[-1].isalpha():
        return "place" if value[0].isdigit() else "names"
    if not any(c.isalpha() for c in value):
        return "num" + "".join(sorted({c for c in value if not c.isdigit()}))
    return "hex" if HEX.match(value) else "word" if value.isalpha() else "mix"


def _pattern(text: str, start: int, end: int) -> tuple[str, str]:
    """(pattern, left context) of the value at start..end."""
    m = BEFORE.search(text, max(0, start - 28), start)
    left = SPACE.sub(" ", (m[1] + m[2]).lower()) if m else ""
    after = text[end : end + 1]
    return f"{left}|{_shape(text[start:end])}|{'' if after.isalnum() else SPACE.sub(' ', after)}", left


def _seed(text: str, start: int, end: int, left: str) -> str | None:
    """Kind of a value that is a seed and a span at once."""
    return next((kind for head, kind in SEED_HEADS.items() if text.startswith(head, start)), None) or SEED_LABELS.get(left)


def _capitalised(run: str) -> bool:
    return all(w[0].isupper() or w[0].isdigit() for w in re.split("[ -]", run))


def _labelled(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what follows each label: a run of capitalised words if there is one, else a token; none within another."""
    end = 0
    for m in LABEL.finditer(text):
        start = m.end()
        if start < end:
            continue
        run = RUN.match(text, start)
        while run and not _capitalised(run[0]):
            # The run ends before its first word in small letters.
            cut = max(run[0].rfind(" "), run[0].rfind("-"))
            run = RUN.fullmatch(text, start, start + cut) if cut > 0 else None
        found = run or TOKEN.match(text, start)
        end = found.end() if found else start
        while end > start and text[end - 1] in ".:!?":
            end -= 1
        if end > start:
            yield start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(pattern, value, seed kind or None, span kind or None, start, end): base spans, labelled values, tokens with a digit."""
    out = [(_pattern(text, s, e)[0], text[s:e], KINDS[k], KINDS[k], s, e) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)

    def free(spans: list[tuple[int, int]], found: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Those that touch none of ``spans``; both in order."""
        i = 0
        for start, end in found:
            while i < len(spans) and spans[i][1] <= start:
                i += 1
            if i == len(spans) or spans[i][0] >= end:
                yield start, end

    def with_digit() -> Iterator[tuple[int, int]]:
        at = 0
        while m := DIGIT.search(text, at):
            start, end = m.start(), VALUE.match(text, m.start()).end()
            while start > at and text[start - 1] in VALUE_CHARS:
                start -= 1
            at = end
            yield start, end

    labelled = []
    for start, end in free(taken, _labelled(text)):
        labelled.append((start, end))
        pattern, left = _pattern(text, start, end)
        own = _seed(text, start, end, left)
        hex_run = end - start >= LEAST_HEX and HEX.match(text[start:end])
        seed = own or ("secret" if hex_run else None)
        out.append((pattern, text[start:end], seed, own, start, end))
        out.append((f"{left}||", text[start:end], seed, own, start, end))
    for start, end in free(sorted(taken + labelled), with_digit()):
        pattern, left = _pattern(text, start, end)
        own = _seed(text, start, end, left)
        out.append((pattern, text[start:end], own, own, start, end))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
CAND = pa.struct([("pattern", pa.string()), ("value", pa.int64()), ("seed", pa.string()), ("own", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, bases, cands, shas = [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            found = [(KINDS[k], s, e) for k, s, e in base]
            rows.append(xxhash.xxh3_64_intdigest(f"{doc_id}\n{text}") - 2**63)
            bases.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            shas.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest())
            cands.append([{"pattern": p, "value": xxhash.xxh3_64_intdigest(v) - 2**63, "seed": k, "own": o, "start": s, "end": e, "base": n < len(base)} for n, (p, v, k, o, s, e) in enumerate(candidates(text, base))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), pa.array(bases, pa.list_(SPAN)), pa.array(shas), pa.array(cands, pa.list_(CAND))], ["doc_id", "row", "base", "base_sha256", "cands"])


def trusted_patterns(occurrences: DataFrame, st: Staging, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_values: int = LEAST_VALUES) -> DataFrame:
    """(pattern, kind, score) of the patterns that mark values; occurrences: pattern, value, seed."""
    edges = st.write(occurrences.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    size = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.where("seed is not null").groupBy("value", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    values, patterns = seeds, None
    for _ in range(rounds):
        total = edges.join(values, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = st.write(total.join(size, "pattern").where(F.col("n") >= least_values).select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("score")), "patterns")
        strong = patterns.where(F.col("score") >= least_score / 2)
        spread = edges.join(strong, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("score"))
        values = st.write(spread.unionByName(seeds).groupBy("value", "kind").agg(F.max("score").alias("score")), "values")
    best = patterns.where(F.col("score") >= least_score).groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("b"))
    return best.select("pattern", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))


def find_pii(docs: DataFrame, rounds: int = ROUNDS, least_score: float = LEAST_SCORE, least_values: int = LEAST_VALUES) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans: one row per document.

    ``n_found`` counts the spans beyond the base kinds, ``n_spans`` all."""
    st = Staging(docs.sparkSession, "pii")
    rows = st.write(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            _find, "doc_id long, row long, base array<struct<kind:string,start:long,end:long>>, base_sha256 string,"
            " cands array<struct<pattern:string,value:long,seed:string,own:string,start:long,end:long,base:boolean>>",
        ), "rows",
    )
    occurrences = rows.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    trusted = st.write(trusted_patterns(occurrences.select("pattern", "value", "seed"), st, rounds, least_score, least_values), "trusted")
    trusted = F.broadcast(trusted) if trusted.count() <= BROADCAST_PATTERNS else trusted
    marked = occurrences.where("not base").join(trusted, "pattern", "left").withColumn("kind", F.coalesce("own", "kind")).where("kind is not null")
    # One kind a place, that of the best pattern.
    marked = marked.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct(F.coalesce("score", F.lit(1.0)), "kind")).alias("kind"))
    more = marked.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>")))
    ordered = F.array_sort(F.transform(every, lambda s: F.struct(F.coalesce(rank[s["kind"]], F.lit(len(KINDS))).alias("r"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    out = rows.join(more, "row", "left").withColumn("every", ordered)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.array_join(F.transform("every", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *[count(k) for k in KINDS], "base_sha256", text.alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_found"), F.size("every").cast("long").alias("n_spans"))
