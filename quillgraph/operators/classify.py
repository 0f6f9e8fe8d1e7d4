"""Sectors of organisations from industry codes: a range join, then a ladder of fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# First and last industry code, sectors.
SIC_RANGES = (
    (3480, 3489, "A"), (3720, 3729, "A"), (3730, 3732, "A"), (3760, 3769, "A"), (3795, 3795, "A"), (3812, 3812, "AD"),
    (2000, 2099, "B"), (2100, 2199, "B"), (2200, 2399, "B"), (2670, 2679, "B"), (2840, 2844, "B"), (3140, 3149, "B"), (3630, 3639, "B"), (3940, 3949, "B"),
    (5000, 5199, "B"), (5200, 5999, "B"), (7000, 7099, "B"), (100, 999, "B"), (4000, 4799, "B"), (3710, 3716, "B"),
    (6000, 6799, "C"), (9100, 9999, "C"),
    (3570, 3579, "D"), (3660, 3669, "D"), (3670, 3679, "D"), (3559, 3559, "D"), (7370, 7379, "D"), (3820, 3825, "D"), (3827, 3829, "D"),
    (2830, 2836, "E"), (3826, 3826, "E"), (3840, 3851, "E"), (5122, 5122, "E"), (6324, 6324, "EC"), (8000, 8099, "E"), (8731, 8731, "E"),
    (1000, 1499, "F"), (2800, 2829, "F"), (2850, 2899, "F"), (2900, 2999, "F"), (3300, 3399, "F"), (4900, 4999, "F"), (3500, 3569, "F"),
    (2700, 2799, "G"), (4800, 4899, "G"), (7800, 7899, "G"), (7900, 7999, "G"),
    (8700, 8799, "C"), (1500, 1799, "F"), (2400, 2699, "F"), (3000, 3299, "F"), (3400, 3499, "F"), (3580, 3659, "F"), (3680, 3799, "F"), (3830, 3999, "B"),
    (7200, 7369, "B"), (7380, 7699, "D"), (8100, 8699, "C"), (8800, 8999, "C"),
)
# Nonprofit category letter, sector.
NTEE = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "GEFBEEEECCBCEGCCCCCCDCCGCC", strict=True))


def range_frame(spark: SparkSession, ranges=SIC_RANGES) -> DataFrame:
    rows = [(lo, hi, [f"DOM_{c}" for c in letters], n) for n, (lo, hi, letters) in enumerate(ranges)]
    return spark.createDataFrame(rows, "lo int, hi int, range_domains array<string>, ord int")


def classify_by_range(orgs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, sic, range_domains): the narrowest range that holds the code, the first listed among equals.

    The ranges are a rule table of tens of rows; each code is looked up once, not each organisation."""
    codes = orgs.where("sic is not null").select("sic").distinct()
    w = Window.partitionBy("sic").orderBy(F.col("hi") - F.col("lo"), "ord")
    found = codes.join(F.broadcast(ranges), F.col("sic").between(F.col("lo"), F.col("hi"))).withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return orgs.select("id", "sic").join(found.select("sic", "range_domains"), "sic").select("id", "sic", "range_domains")


def classify(orgs: DataFrame, ranges: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(id, sectors, basis) from (id, label, sic, ntee): the user's own table, then industry code, nonprofit letter,
    then investment vehicles by name; none of them gives null sectors."""
    from quillgraph.functions.scalars import loose_name

    d = orgs.select("id", "label", "sic", "ntee", loose_name(F.col("label")).alias("key"))
    if chosen is not None:
        d = d.join(chosen.select(loose_name(F.col("label")).alias("key"), F.col("sectors").alias("own")).dropDuplicates(["key"]), "key", "left")
    else:
        d = d.withColumn("own", F.lit(None).cast("array<string>"))
    d = d.join(classify_by_range(orgs, ranges).select("id", "range_domains"), "id", "left")
    letters = F.create_map(*[F.lit(x) for pair in NTEE.items() for x in pair])
    letter = letters[F.substring("ntee", 1, 1)]
    vehicle = F.col("label").rlike(r"(?i)\b(fund|capital|partners|trust|acquisition)\b")
    steps = [
        ("table", F.col("own")), ("industry", F.col("range_domains")), ("nonprofit", F.when(letter.isNotNull(), F.array(F.concat(F.lit("DOM_"), letter)))),
        ("name", F.when(vehicle, F.array(F.lit("DOM_C")))),
    ]
    basis = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in steps], F.lit("none"))
    return d.select("id", F.coalesce(*[v for _, v in steps]).alias("sectors"), basis.alias("basis"))
