"""Files that Spark reads natively, and small per-file parsers (one file is one row)."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """Lists with a header line; the schema is given, never inferred, and values stay untrimmed text where it says so."""
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).option("enforceSchema", False).csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).schema(schema).load(path)


def read_json_pages(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Landed pages of a paginated source, one record per key: of repeats the one with the largest content."""
    d = spark.read.schema(schema).json(path)
    return d.groupBy(key).agg(F.max(F.struct(*[c for c in d.columns if c != key])).alias("r")).select(key, "r.*")


_SCALARS = {"true": "true", "yes": "true", "false": "false", "no": "false", "null": None, "~": None, "": None}


def _front_matter(text: str | None) -> dict[str, str | None] | None:
    """Flat keys of a leading --- block as text; lists joined by a comma; null without such a block."""
    m = re.match(r"---\r?\n(.*?)\r?\n---(\r?\n|\Z)", text or "", re.DOTALL)
    if not m:
        return None
    out: dict[str, str | None] = {}
    key = None
    for line in m[1].splitlines():
        item = re.match(r"\s+-\s+(.*)", line)
        pair = re.match(r"([A-Za-z_][\w-]*):\s*(.*)", line)
        if item and key:
            out[key] = ", ".join(x for x in (out[key], item[1].strip().strip("\"'")) if x)
        elif pair:
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                value = ", ".join(x.strip().strip("\"'") for x in value[1:-1].split(","))
            bare = value.strip("\"'")
            out[key] = bare if bare != value else _SCALARS.get(value.lower(), value)
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def front_matter(texts: pd.Series) -> pd.Series:
    return pd.Series([_front_matter(t) for t in texts], dtype="object")


def column_number(ref: Column) -> Column:
    """Column of a cell reference, A as 1, AB as 28."""
    letters = F.filter(F.split(F.regexp_extract(F.upper(ref), "^[A-Z]+", 0), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)


def _cells(content: bytes) -> Iterator[tuple[str, int, str, str]]:
    """(sheet, row, cell reference, text) of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        text_of = lambda e: "".join(t.text or "" for t in e.iter() if t.tag.endswith("}t"))
        shared = [text_of(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            for c in ET.fromstring(z.read(name)).iter():
                if c.tag.endswith("}c"):
                    value = next((v.text for v in c if v.tag.endswith("}v")), None)
                    kind, ref = c.get("t"), c.get("r", "")
                    text = shared[int(value)] if kind == "s" and value is not None else text_of(c) if kind == "inlineStr" else value
                    if text:
                        yield name.rsplit("/", 1)[1][:-4], int(re.sub(r"\D", "", ref) or 0), ref, text


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cell, text) of every filled cell of every workbook under ``path``; files are read in parallel."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at, content in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([(at, *c) for c in _cells(content)], columns=["path", "sheet", "row", "cell", "text"])

    return files.mapInPandas(parse, "path string, sheet string, row int, cell string, text string")
