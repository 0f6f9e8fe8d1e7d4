"""Reports as blocks: Markdown to headings, paragraphs, lists and tables, and back to Markdown or HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INDENT = "    "


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.btrim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: F.btrim(c))


def to_blocks(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, block, kind, level, text, items, head, rows): the blocks of each text, numbered from 0 with gaps.

    Kinds: h (level, text), p (text: its lines joined by a space), ul (items; lines indented by four spaces belong to the item
    above), table (head, rows; rules of dashes and empty rows are left out, and so is a table without rows). A block ends where
    the kind of line changes, at an empty line and at a heading. A null or empty text has no blocks. Rows that share a
    document are read as one text in no defined order: make ``doc`` unique. One window pass over a text's lines."""
    lines = docs.select(F.col(doc).alias("doc"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "raw"))
    raw = F.col("raw")
    kind = F.when(raw.startswith("#"), "h").when(raw.startswith("- "), "ul").when(raw.startswith("|"), "table").when(F.btrim(raw) == "", "").otherwise("p")
    w = Window.partitionBy("doc").orderBy("pos")
    # An indented line goes on with an item if the last line that is not indented is one.
    opened = F.last(F.when(~raw.startswith(INDENT), kind), ignorenulls=True).over(w)
    lines = lines.withColumn("more", raw.startswith(INDENT) & opened.eqNullSafe("ul")).withColumn("kind", F.when(F.col("more"), "ul").otherwise(kind))
    starts = (F.col("kind") == "h") | ~F.col("kind").eqNullSafe(F.lag("kind").over(w))
    lines = lines.withColumn("block", F.sum(starts.cast("long")).over(w) - 1).where("kind <> ''")
    item = F.sum((~F.col("more")).cast("int")).over(Window.partitionBy("doc", "block").orderBy("pos"))
    lines = lines.withColumn("item", item)
    got = lines.groupBy("doc", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "item", "raw"))).alias("l"))
    first = F.col("l")[0]["raw"]
    joined = F.array_join(F.transform("l", lambda x: F.btrim(x["raw"])), " ")
    piece = lambda x: F.when(x["raw"].startswith("- "), F.substring(x["raw"], 3, 2_000_000_000)).otherwise(F.concat(F.lit(" "), F.btrim(x["raw"])))
    items = F.transform(F.sequence(F.lit(1), F.array_max(F.transform("l", lambda x: x["item"]))), lambda n: F.array_join(F.transform(F.filter("l", lambda x: x["item"] == n), piece), ""))
    table = F.transform("l", lambda x: _cells(x["raw"]))
    body = F.filter(F.slice(table, 2, F.size("l")), lambda r: F.exists(r, lambda c: ~c.rlike("^[-:]*$")))
    got = got.select(
        "doc", "block", "kind", F.when(F.col("kind") == "h", F.length(F.regexp_extract(first, "^#+", 0))).alias("level"),
        F.when(F.col("kind") == "h", F.btrim(F.regexp_replace(first, "^#+", ""))).when(F.col("kind") == "p", joined).alias("text"),
        F.when(F.col("kind") == "ul", items).alias("items"), F.when(F.col("kind") == "table", table[0]).alias("head"), F.when(F.col("kind") == "table", body).alias("rows"),
    )
    return got.where("kind <> 'table' or size(rows) > 0")


def _joined(blocks: DataFrame, block: Column, between: str, name: str) -> DataFrame:
    """(doc, name): the rendered blocks of each document in order."""
    parts = F.array_sort(F.collect_list(F.struct("block", block.alias("out"))))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["out"]), between).alias(name))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(doc, markdown): blocks as text, an empty line between two; bars within cells become slashes. ``to_blocks`` of it
    gives the same blocks."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("/"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform("head", lambda c: F.lit("---|")), ""))
    rows = F.transform("rows", lambda r: row(F.transform(r, cell)))
    table = F.array_join(F.concat(F.array(row(F.col("head")), rule), rows), "\n")
    one = (
        F.when(F.col("kind") == "h", F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text"))).when(F.col("kind") == "p", F.col("text"))
        .when(F.col("kind") == "ul", F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i)), "\n")).otherwise(table)
    )
    return _joined(blocks, F.concat(one, F.lit("\n")), "\n", "markdown")


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def inline(text: Column) -> Column:
    """Escaped text with web links, bold and code; escaping adds no character that tells these apart."""
    linked = F.regexp_replace(escaped(text), r"\[([^\]]+)\]\((https?://[^)\s]+)\)", '<a href="$2" rel="noopener noreferrer">$1</a>')
    return F.regexp_replace(F.regexp_replace(linked, r"\*\*(.+?)\*\*", "<b>$1</b>"), "`([^`]+)`", "<code>$1</code>")


def to_html(blocks: DataFrame) -> DataFrame:
    """(doc, html): blocks as the body of an article; only links to http and https become links."""
    tag = lambda name, inner: F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))
    each = lambda items, name, of: F.array_join(F.transform(items, lambda x: tag(name, of(x))), "")
    level = F.concat(F.lit("h"), F.col("level").cast("string"))
    heading = F.concat(F.lit("<"), level, F.lit(">"), inline(F.col("text")), F.lit("</"), level, F.lit(">"))
    head = tag("thead", tag("tr", each("head", "th", escaped)))
    body = tag("tbody", F.array_join(F.transform("rows", lambda r: tag("tr", each(r, "td", inline))), ""))
    one = F.when(F.col("kind") == "h", heading).when(F.col("kind") == "p", tag("p", inline(F.col("text")))).when(F.col("kind") == "ul", tag("ul", each("items", "li", inline))).otherwise(tag("table", F.concat(head, body)))
    return _joined(blocks, one, "", "html")
