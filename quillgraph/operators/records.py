"""Records over time: newest wins, merges of evidence, supersession, roster differences, validation, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.plans.graph import few
from quillgraph.plans.staging import Staging


def newest(records: DataFrame, keys: list[str], date: str, tie: str) -> DataFrame:
    """The newest record per key; undated ones last; equal dates by the larger ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(date), F.desc(tie))
    return records.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge_evidence(records: DataFrame, keys: list[str], date: str, url: str, facts: list[str], keep: int = 25) -> DataFrame:
    """Per key: first and last date, number seen, each fact from the newest record, and the last ``keep`` distinct pieces
    of evidence. Combined before the shuffle, apart from the evidence list, whose length is the key's own."""
    newest_fact = [F.max_by(f, F.struct(date, url)).alias(f) for f in facts]
    e = F.array_sort(F.collect_set(F.struct(F.col(date).alias("date"), F.col(url).alias("url"))))
    out = records.groupBy(*keys).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), F.count(F.lit(1)).alias("seen"), *newest_fact, e.alias("evidence"))
    return out.withColumn("evidence", F.slice("evidence", F.greatest(F.lit(1), F.size("evidence") - keep + 1), keep))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], date: str) -> DataFrame:
    """keys, action, date: new, superseding (strictly newer) or unchanged for incoming keys, kept for the others."""
    a = current.select(*keys, F.col(date).alias("was"))
    b = newest(incoming, keys, date, keys[0]).select(*keys, F.col(date).alias("now"))
    both = a.join(b, keys, "full")
    action = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "kept").when(F.col("now") > F.col("was"), "superseding").otherwise("unchanged")
    return both.select(*keys, action.alias("action"), F.greatest("was", "now").alias("date"))


def roster_difference(recorded: DataFrame, roster: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: 'left' for active records not on the roster, 'joined' for roster entries not recorded."""
    r, n = recorded.where(~F.col("active").eqNullSafe(F.lit(False))).select(*keys).distinct(), roster.select(*keys).distinct()
    return r.join(n, keys, "left_anti").withColumn("change", F.lit("left")).unionByName(n.join(r, keys, "left_anti").withColumn("change", F.lit("joined")))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, side, id) of ends that are no node."""
    known = few(nodes.select("id"))
    out = [edges.select("edge_id", F.lit(side).alias("side"), F.col(side).alias("id")).join(known, "id", "left_anti").select("edge_id", "side", "id") for side in ("source", "target")]
    return out[0].unionByName(out[1])


def duplicate_identifiers(identities: DataFrame) -> DataFrame:
    """(scheme, value, id, other): every further holder of an identifier and the holder before it, by id."""
    w = Window.partitionBy("scheme", "value").orderBy("id")
    return identities.select("scheme", "value", "id", F.lag("id").over(w).alias("other")).where("other is not null")


TYPE_TOKEN = r"^[A-Z][A-Z0-9_]{2,60}\z"


def validate_edges(candidates: DataFrame, nodes: DataFrame, live: DataFrame, as_of: Column) -> DataFrame:
    """(edge_id, errors, status): the fields that fail, sorted and joined, and 201, 409 or 422.

    All rules are checked and all errors collected; 409 only if a duplicate is the sole error."""
    triple = ["source", "target", "relationship_type"]
    weight = F.col("weight").try_cast("double")
    date = F.try_to_timestamp("document_date", F.lit("yyyy-MM-dd")).cast("date")
    own = [
        ("target", F.col("source") == F.col("target")),
        ("relationship_type", ~F.col("relationship_type").rlike(TYPE_TOKEN)), ("citation_url", ~F.coalesce(F.col("citation_url"), F.lit("")).rlike(r"^https://[^/\s]+")),
        ("document_date", date.isNull() | (date > as_of)),
        ("conflict_weight", weight.isNull() | (weight < 0) | (weight > 1) | (F.abs(weight * 100 - F.round(weight * 100)) > 1e-9)),
    ]
    # What a candidate shows by itself is judged first, a bit a rule, so that its fields do not go through the joins.
    bits = sum((F.when(F.coalesce(bad, F.lit(True)), 1 << n).otherwise(0) for n, (_, bad) in enumerate(own)), F.lit(0))
    short = F.length(F.coalesce("reason", F.lit(""))) < 10
    c = candidates.select("edge_id", *triple, bits.alias("bits"), short.alias("short"))
    known = nodes.select("id", F.lit(True).alias("known"))
    for side in ("source", "target"):
        c = c.join(known.withColumnsRenamed({"id": side, "known": f"has_{side}"}), side, "left")
    c = c.join(live.select(*triple).distinct().withColumn("again", F.lit(True)), triple, "left")
    rules = [("source", F.col("has_source").isNull()), ("target", F.col("has_target").isNull()), ("supersedes", F.col("again").isNotNull() & F.col("short"))]
    rules += [(name, F.col("bits").bitwiseAND(1 << n) != 0) for n, (name, _) in enumerate(own)]
    errors = F.array_compact(F.array_distinct(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules])))
    c = c.withColumn("errs", F.array_sort(errors))
    status = F.when(F.size("errs") == 0, 201).when((F.size("errs") == 1) & (F.col("errs")[0] == "supersedes"), 409).otherwise(422)
    return c.select("edge_id", F.array_join("errs", ",").alias("errors"), status.alias("status"))


def corroborated(roles: DataFrame, ties: DataFrame) -> DataFrame:
    """(edge_id, person): ties between organisations for which a person holds a role at both ends."""
    r = roles.select(F.col("source").alias("person"), F.col("target").alias("org")).distinct()
    t = ties.select("edge_id", F.col("source").alias("x"), F.col("target").alias("y"))
    return t.join(r.withColumnRenamed("org", "x"), "x").join(r.withColumnRenamed("org", "y"), ["y", "person"]).select("edge_id", "person").distinct()


def all_tokens_match(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, name) for names all of whose tokens a document has; (doc, token) and (name, token) frames of distinct rows.

    Documents are candidates by a name's rarest token alone; only these are held against its other tokens."""
    st = Staging(tokens.sparkSession, "tokens")
    tokens = st.write(tokens.join(wanted.select("token").distinct(), "token", "left_semi").select("doc", "token"), "tokens")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))
    ranked = wanted.join(counts, "token", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "token")).alias("rarest"), F.count(F.lit(1)).alias("n"))
    found = ranked.where("rarest.docs > 0").select("name", "n", F.col("rarest.token").alias("token")).join(tokens, "token").select("doc", "name", "n")
    hits = found.join(wanted, "name").join(tokens, ["doc", "token"])
    return hits.groupBy("doc", "name", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n").select("doc", "name")


#: Names of a substring search that may be broadcast (some dozens of bytes each).
BROADCAST_NAMES = 200_000


def contained_names(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """texts by each name that they contain anywhere. Few names are held against each text in place; more than
    ``BROADCAST_NAMES`` meet only texts that have their first three letters in a row, or all of a shorter name, by a join on these."""
    if names.count() <= BROADCAST_NAMES:
        return texts.join(F.broadcast(names), F.contains(F.col(text), F.col(name)))
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substring(F.col(text), i, F.lit(k)))
    met = texts.withColumn("__g", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), grams(1), grams(2), grams(3)))))
    return met.join(names.withColumn("__g", F.substring(name, 1, 3)), "__g").where(F.contains(F.col(text), F.col(name))).drop("__g")


def union_of(pulls: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of several pulls of one list, once per key; where pulls differ, the smallest value of each other column."""
    every = pulls[0]
    for p in pulls[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys).agg(*[F.min(c).alias(c) for c in every.columns if c not in keys])
