"""Grouped counts and totals over filings; all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_funders(funding: DataFrame, least: int = 2) -> DataFrame:
    """(source, funded): funders of at least ``least`` different targets."""
    return funding.groupBy("source").agg(F.countDistinct("target").alias("funded")).where(F.col("funded") >= least)


def committee_totals(payments: DataFrame) -> DataFrame:
    """(committee, name, cents): sums above zero of (committee, name, cents)."""
    return payments.groupBy("committee", "name").agg(F.sum("cents").alias("cents")).where("cents > 0")


def client_trail(filings: DataFrame) -> DataFrame:
    """(client, filings, firms, latest) of (client, firm, date)."""
    return filings.groupBy("client").agg(F.count(F.lit(1)).alias("filings"), F.countDistinct("firm").alias("firms"), F.max("date").alias("latest"))


def gaps(positions: DataFrame, category: str, missing: Column) -> DataFrame:
    """(category, n, missing): rows per category, and those of them with a gap."""
    return positions.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("missing"))


def bridge_persons(roles: DataFrame, corporate: Column, nonprofit: Column) -> DataFrame:
    """(person, corporate, nonprofit): persons of (person, org, ...) with seats of both sorts, and how many."""
    r = roles.groupBy("person").agg(F.countDistinct(F.when(corporate, F.col("org"))).alias("corporate"), F.countDistinct(F.when(nonprofit, F.col("org"))).alias("nonprofit"))
    return r.where("corporate > 0 and nonprofit > 0")


def confirmed_bridges(rows: DataFrame, least: int = 2) -> DataFrame:
    """(person, companies): persons whose confirmed rows name at least ``least`` companies."""
    return rows.where("status = 'CONFIRMED'").groupBy("person").agg(F.countDistinct("company").alias("companies")).where(F.col("companies") >= least)


def disclosures(filings: DataFrame) -> DataFrame:
    """(org, notes): self-disclosed family or business ties, and a stated lack of a conflict policy."""
    notes = F.array_compact(F.array(F.when(F.col("related"), "related officers"), F.when(~F.col("policy"), "no conflict policy")))
    return filings.select("org", F.array_join(notes, ",").alias("notes")).where("notes <> ''")


def first_signals(signals: DataFrame) -> DataFrame:
    """One signal per (type, set of subjects): the first by key of (key, type, subjects, ...)."""
    s = signals.withColumn("__s", F.array_sort("subjects"))
    keep = s.groupBy("type", "__s").agg(F.min("key").alias("key"))
    return signals.join(keep.select("key"), "key", "left_semi")


def newest_trail(filings: DataFrame, key: str, date: str, row: str, kind: str, most: int = 12) -> DataFrame:
    """(key, n, kinds, latest, trail): filings by key, their kinds, the newest one and the ``most`` newest, newest first.

    Only these are ever gathered: the rank is limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(date), F.desc(row))
    top = filings.select(key, date, row, F.row_number().over(w).alias("rn")).where(F.col("rn") <= most)
    trail = top.groupBy(F.col(key).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", row))), lambda x: x[row].cast("string")), ",").alias("trail"))
    every = filings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.max_by(row, F.struct(date, row)).alias("latest"))
    return every.join(trail, F.col(key) == F.col("k")).drop("k")
