"""Scans of Markdown and list texts into rows: pipe tables under their headings, tables of boards, and headed lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Headings that name a company's board, names that are no company, a claimed link between two boards.
BOARD_HEADING = (
    r"(?i)^(?:part\s+[ivx]+:.*?|[ivx]+\.\s*|\d+\\?\.\s*)?(.+?)\s+(?:board of directors|supervisory board|board of trustees|"
    r"board breakdown|board of directors & .*|board)\b"
)
NO_COMPANY = r"(?i)leadership|second-degree|table\b|bridges|breakdown|directorate|\bweb\b|phase|^[ivx]+\.?$|&$|^key\b"
LINK = (
    r"(?i)^\s*[*-]\s+\*\*(.+?):\*\*\s+Connected solely through\s+(?:former \w+\s+)?\*\*(.+?)\*\*"
    r"(?:\s*\(([^)]*)\))?(?:\s+on the\s+\*\*(.+?)\*\*\s+board)?"
)
LEGAL_FORMS = ("Inc", "Corp", "plc", "Ltd", "LLC")
#: Columns from which a table is no list of people.
MOST_COLUMNS = 4


def pipe_tables(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line, heading, cells): rows of pipe tables with the last heading above; rules of dashes left out."""
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    w = Window.partitionBy("doc").orderBy("line")
    heading = F.last(F.nullif(F.regexp_extract("raw", r"^#{1,6}\s+(.*?)\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    cells = F.transform(F.split(F.regexp_replace(F.btrim("raw"), r"^\||\|$", ""), r"\|"), lambda c: F.btrim(c))
    found = rows.withColumn("heading", heading).where(F.btrim("raw").startswith("|")).select("doc", "line", "heading", cells.alias("cells"))
    return found.where(F.exists("cells", lambda c: ~c.rlike(r"^:?-*:?$")))


def headed_list(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line, header, item, role): '- item: role' lines under the last 'header:' line."""
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    w = Window.partitionBy("doc").orderBy("line")
    header = F.last(F.nullif(F.regexp_extract("raw", r"^([^\s\-].*?):\s*$", 1), F.lit("")), ignorenulls=True).over(w)
    item = r"^\s*[-*]\s+(.*?)(?::\s*(.*?))?\s*$"
    found = rows.withColumn("header", header).where(F.col("raw").rlike(r"^\s*[-*]\s+\S"))
    return found.select("doc", "line", "header", F.regexp_extract("raw", item, 1).alias("item"), F.nullif(F.regexp_extract("raw", item, 2), F.lit("")).alias("role"))


def watchlist(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line, kind, arg): '- kind: arg' lines outside fenced code."""
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("line", "raw"))
    w = Window.partitionBy("doc").orderBy("line")
    fences = F.sum(F.btrim("raw").startswith("```").cast("int")).over(w)
    entry = r"^\s*-\s*([a-z0-9_]+)\s*:\s*(.+?)\s*$"
    found = rows.withColumn("inside", fences % 2 == 1).where(~F.col("inside") & F.col("raw").rlike(entry))
    return found.select("doc", "line", F.regexp_extract("raw", entry, 1).alias("kind"), F.regexp_extract("raw", entry, 2).alias("arg"))


def _without_brackets(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\(.*?\)", ""))


def _table_cells(line: Column) -> Column:
    return F.split(F.regexp_replace(F.btrim(line), r"^\|+|\|+$", ""), r"\|")


def headed_tables(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, table_line, heading, company, line, person, role): rows of tables of people under the heading of a board.

    A table is a line of cells above a rule of dashes, of four columns at most, the first of them for directors or names. Its
    heading is the nearest one above, else the first line of the text; the company is what the heading says before the word for
    board. A table goes on to the last line of cells; a rule among them begins another. Rows need a name of two words without digits.
    Lines count from 1. Headings that name no company, null texts and texts without tables give no rows. One window pass."""
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw"))
    raw, w = F.col("raw"), Window.partitionBy("doc").orderBy("pos")
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    heading = F.coalesce(F.last(F.when(F.ltrim(raw).startswith("#"), raw), ignorenulls=True).over(above), F.first(raw).over(above))
    cells = _table_cells(raw)
    first = F.regexp_replace(cells[0], r"^[ *]+|[ *]+$", "")
    head = raw.startswith("|") & F.coalesce(F.lead(raw).over(w).rlike(r"^\|\s*:?-{3,}"), F.lit(False)) & first.rlike("(?i)director|name") & (F.size(cells) <= MOST_COLUMNS)
    rows = rows.withColumn("heading", F.btrim(F.regexp_replace(heading, r"[\\*#]", ""))).withColumn("head", head).withColumn("run", F.sum((~raw.startswith("|")).cast("long")).over(w))
    company = F.regexp_replace(F.regexp_extract(_without_brackets(F.col("heading")), BOARD_HEADING, 1), "^[ :\u2013\u2014-]+|[ :\u2013\u2014-]+$", "")
    rows = rows.withColumn("company", company)
    named = F.col("head") & F.col("company").isNotNull() & (F.col("company") != "")
    begun = F.last(F.when(named, F.struct("pos", "heading", "company")), ignorenulls=True).over(Window.partitionBy("doc", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -2))
    clean = F.transform(cells, lambda c: F.btrim(F.regexp_replace(c, r"[\\*]", "")))
    person = _without_brackets(clean[0])
    found = rows.withColumn("t", begun).where(raw.startswith("|") & F.col("t").isNotNull() & person.rlike(r"\S\s+\S") & ~person.rlike(r"\d"))
    role = F.when(F.size(clean) > 1, F.get(clean, F.lit(1))).otherwise("")
    found = found.select("doc", (F.col("t.pos") + 1).alias("table_line"), "t.heading", "t.company", (F.col("pos") + 1).alias("line"), person.alias("person"), role.alias("role"))
    return found.where(~F.col("company").rlike(NO_COMPANY))


def linked_pairs(texts: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, line, company, person, role): '- **A:** Connected solely through **Person** on the **B** board' as a row for A, or
    for each of several companies joined by an ampersand after their legal form, and one for B."""
    rows = texts.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw")).where(F.col("raw").rlike(LINK))
    part = lambda n: F.nullif(F.regexp_extract("raw", LINK, n), F.lit(""))
    leaves = F.split(F.regexp_replace(part(1), rf"\b({'|'.join(LEGAL_FORMS)})(\.?)\s+&\s+", "$1$2\u0001"), "\u0001")
    named = lambda company, role: F.struct(company.alias("company"), role.alias("role"))
    claimed = F.coalesce(part(3), F.lit("claimed link"))
    targets = F.concat(F.transform(leaves, lambda c: named(c, claimed)), F.array(named(part(4), F.lit("board member (claimed)"))))
    found = rows.select("doc", (F.col("pos") + 1).alias("line"), _without_brackets(part(2)).alias("person"), F.inline(targets)).where("company is not null")
    company = F.btrim(F.split(_without_brackets(F.replace(F.col("company"), F.lit("\\"), F.lit(""))), "/")[0])
    return found.select("doc", "line", company.alias("company"), "person", "role")
