"""Scalars, names, records, text review, log chains."""

import json

from pyspark.sql import functions as F

from quillgraph.functions import scalars
from quillgraph.functions.names import agreement, evidence, parsed
from quillgraph.functions.weights import conflict_weight
from quillgraph.operators import integrity, records, textlint
from quillgraph.sources import markdown


def test_scalars(spark):
    d = spark.createDataFrame([("Acme & Söhne, Inc.", "DPRBOZP0K5RM2YE8UU08", "320193"), (None, "DPRBOZP0K5RM2YE8UU09", None)], "label string, lei string, cik string")
    a, b = d.select(scalars.norm_name(F.col("label")).alias("n"), scalars.loose_name(F.col("label")).alias("l"), scalars.lei_ok(F.col("lei")).alias("ok"), scalars.pad_cik(F.col("cik")).alias("c")).collect()
    assert (a.n, a.l, a.ok, a.c) == ("acme and söhne inc", "acme and söhne", True, "0000320193")
    assert (b.n, b.ok, b.c) == ("", False, None)


def test_identifier_preference_and_weights(spark):
    d = spark.createDataFrame([({"lei": "X", "sec_cik": "7"},), ({"zz": "1", "aa": "2"},)], "ids map<string,string>")
    assert [r[0] for r in d.select(scalars.first_identifier(F.col("ids"))).collect()] == ["sec_cik:7", "aa:2"]
    rows = [("director_of", False, None), ("director_of", True, 50), ("owns", False, 0), ("beneficial_owner_of", False, 5), ("holds_shares_of", True, 5), ("unheard_of", False, None)]
    w = spark.createDataFrame(rows, "r string, f boolean, p int").select(conflict_weight(F.col("r"), F.col("f"), F.col("p")))
    assert [r[0] for r in w.collect()] == [1.0, 0.5, 0.0, 0.72, 0.2, 0.3]


NAME_PAIRS = [
    ("Dorothea (Dot) Q. Marlowe", "Dot Marlowe", "first_last", "first_last"), ("Ivo A. Brandt", "Ivo A Brandt", "full", "full"), ("Ivo A. Brandt", "Ivo B. Brandt", None, None),
    ("Mike Osei", "Brenda Osei", None, None), ("Sting", None, None, None), ("Bram Tolle", "Brenda Tolle", None, None), ("F Quill", "Fenna Quill", "initial", None),
    ("Dr. Bob Reed-Klages, Ph.D.", "Robert Reed", "first_last", "first_last"), ("Mia Lund Berg", "Ana Lund Berg", None, None), ("Jo Lund Berg", "J. L. Berg", "initial", "initials"),
    ("Ivo Brandt Jr.", "Ivo Brandt Sr", "first_last", None), ("Ivo Brandt Jr.", "Ivo Brandt", "first_last", "first_last"), ("Steve Oss", "Stephen Oss", "first_last", "first_last"),
    ("Alexandra Moe", "Alex Moe", "first_last", "first_last"), ("Ivo K. Brandt", "Karl Ivo Brandt", "full", "full"), ("Fenna Maria Quill", "Maria Quill", "first_last", "first_last"),
]


def test_names(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(NAME_PAIRS)], "i int, a string, b string").select("i", parsed(F.col("a")).alias("x"), parsed(F.col("b")).alias("y"))
    kind = agreement(F.col("x"), F.col("y"))
    got = {r.i: (r.kind, r.fact) for r in d.select("i", kind.alias("kind"), evidence(F.col("x"), F.col("y"), kind).alias("fact")).collect()}
    assert got == {i: (k, f) for i, (_, _, k, f) in enumerate(NAME_PAIRS)}


def test_edge_hash_ignores_later_fields(spark):
    edge = {"edge_id": "E", "integrity": {"conflict_weight": 0.95, "recorded_at": "x"}, "note": "é"}
    later = {**edge, "integrity": {**edge["integrity"], "superseded_by": "F", "verification_hash": "0"}}
    a, b = spark.createDataFrame([(json.dumps(edge),), (json.dumps(later),)], "raw string").select(integrity.edge_hash("raw")).collect()
    assert a == b and len(a[0]) == 64


def chain(n):
    out, tip = [], None
    for i in range(n):
        body = {"i": i, "event": "test", "prev": tip}
        body["hash"] = tip = integrity._sha(integrity.canonical(body, compact=True))
        out.append(json.dumps(body))
    return out


def breaks(spark, lines):
    log = spark.createDataFrame(list(enumerate(lines)), "seq long, raw string")
    return sorted((r.seq, r.problem) for r in integrity.verify_chain(log).collect())


def test_chain(spark):
    lines = chain(6)
    assert breaks(spark, ['{"ts":"old"}', *lines, ""]) == []
    assert breaks(spark, [*lines[:2], lines[2].replace('"test"', '"tost"'), *lines[3:]]) == [(2, "content changed")]
    assert breaks(spark, lines[:2] + lines[3:]) == [(2, "does not point to the entry before it")]
    assert breaks(spark, [*lines[:3], "not json", '{"a":1}', *lines[3:]]) == [(3, "unreadable"), (4, "not part of the chain")]
    anchors = spark.createDataFrame([(1, json.loads(lines[1])["hash"]), (2, "gone")], "line long, tip string")
    log = spark.createDataFrame([(i, json.loads(x)["hash"]) for i, x in enumerate(lines)], "seq long, hash string")
    assert [r.line for r in integrity.missing_anchors(anchors, log).collect()] == [2]


def test_chain_stream(spark, tmp_path):
    from quillgraph.streaming.chain import chain_breaks

    lines = chain(5)
    lines[3] = lines[3].replace('"test"', '"tost"')
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "shard string, seq long, raw string")
    rows.where("seq < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chain_breaks(stream).writeStream.format("memory").queryName("breaks").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    rows.where("seq >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert [(r.seq, r.problem) for r in spark.table("breaks").collect()] == [(3, "content changed")]


def test_wording(spark):
    text = "## 1. Text\nThis is illegal and secretly done, in plain words.\nNo fraud was found; \"illegal\" is their word. jane@example.com\n| a | hidden | guilty |\n## 7. Sources\nillegal"
    got = sorted((r.line, r.rule) for r in textlint.wording(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect())
    assert got == [(2, "crime"), (2, "secrecy"), (3, "email"), (4, "guilt")]
    more = [(1, "He knowingly did so, but not secretly; clearly hidden. Never a fraud 3.5 scam", []), (2, "without doubt a scam", None), (3, "Secret Fund Inc paid; the secret fund did not. No crime, call (212) 555-0100", ["Secret Fund Inc", "Sec"]), (4, "a qui tam case of over-billing, isn't a scheme", [])]
    got = sorted((r.doc, r.rule, r.word) for r in textlint.wording(spark.createDataFrame(more, "doc_id long, text string, known array<string>"), names="known").collect())
    assert got == [(1, "certainty", "clearly"), (1, "motive", "knowingly"), (1, "scheme", "scam"), (1, "secrecy", "hidden"), (2, "certainty", "without doubt"), (3, "phone", "(212) 555-0100"), (3, "secrecy", "secret"), (4, "public money", "over-billing"), (4, "public money", "qui tam")]
    hold = spark.createDataFrame([(1, "Medicare invoices"), (2, "medicare\nlegal consult: 2026-01-01 cleared"), (3, "x")], "doc_id long, text string")
    assert [(r.doc, r.hold) for r in textlint.claims_hold(hold).orderBy("doc").collect()] == [(1, True), (2, False)]


def test_markdown_scans(spark):
    text = "# Board\n| Name | Role |\n|---|:-:|\n| Ann | Chair |\nACME Corp:\n- Ann Lee: director\n* Bob\n```\n- sec: 1\n```\n- sec: 2"
    d = spark.createDataFrame([("d", text)], "doc string, text string")
    assert [(r.heading, r.cells) for r in markdown.pipe_tables(d).orderBy("line").collect()] == [("Board", ["Name", "Role"]), ("Board", ["Ann", "Chair"])]
    assert [(r.header, r.item, r.role) for r in markdown.headed_list(d).orderBy("line").collect()][:2] == [("ACME Corp", "Ann Lee", "director"), ("ACME Corp", "Bob", None)]
    assert [(r.kind, r.arg) for r in markdown.watchlist(d).collect()] == [("sec", "2")]


def test_validation_collects_all_errors(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    live = spark.createDataFrame([("A", "B", "OWNS_IT")], "source string, target string, relationship_type string")
    rows = [("ok", "A", "B", "NEW_TIE", "https://x.org", "2020-01-01", "0.5", ""), ("dup", "A", "B", "OWNS_IT", "https://x.org", "2020-01-01", "1", "short"), ("bad", "A", "A", "no", None, "2030-01-01", "0.123", None), ("null", None, None, None, None, None, None, None)]
    c = spark.createDataFrame(rows, "edge_id string, source string, target string, relationship_type string, citation_url string, document_date string, weight string, reason string")
    got = {r.edge_id: (r.errors, r.status) for r in records.validate_edges(c, nodes, live, F.lit("2026-01-01").cast("date")).collect()}
    assert got["ok"] == ("", 201) and got["dup"] == ("supersedes", 409)
    assert got["bad"] == ("citation_url,conflict_weight,document_date,relationship_type,target", 422) and got["null"][1] == 422
