"""Names, identity, validation, review and files on small inputs with known results."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import labels, predicates
from quillgraph.operators import audit, enforcement, identity, review, tallies
from quillgraph.plans import versions
from quillgraph.plans.staging import Staging
from quillgraph.sources import files


def col(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_labels(spark):
    assert col(spark, ["Walmart Inc. / Madrone Capital", "American Airlines Group", "The Gap, Inc.", None, ""], labels.org_key) == ["walmart", "american airlines", "gap", "", ""]
    assert col(spark, ["APPLE INC /DE/", "O'NEIL MCDONALD-SMITH AG", "Already Fine Ltd", "", None], labels.readable_name) == ["Apple Inc", "O'Neil McDonald-Smith AG", "Already Fine Ltd", "", None]
    assert col(spark, ["COOK TIMOTHY D", "VAN DYKE MARY JR", "DOE, JANE", "MONONYM", None], labels.person_in_order) == ["Timothy D Cook", "Mary Van Dyke Jr", "Jane Doe", "Mononym", ""]
    assert col(spark, ["Dina Powell McCormick", "John A. Doe", "Ann Lee"], labels.name_forms) == [["Dina Powell McCormick", "Dina Powell"], ["John A. Doe"], ["Ann Lee"]]
    assert col(spark, ["X Agrees to Pay", "CEO pleads guilty", "U.S. files complaint", "News", None], labels.release_kind) == ["civil settlement", "criminal case", "complaint", "press release", "press release"]


def test_predicates(spark):
    assert col(spark, ["Ann Lee", "Acme Fund LLC", "Ann", "R2 D2", None, ""], predicates.plausible_person) == [True, False, False, False, False, False]
    hosts = lambda c: predicates.host_allowed(c, ["sec.gov"])
    assert col(spark, ["https://www.sec.gov/a", "https://sec.gov", "http://sec.gov", "https://notsec.gov/", "https://sec.gov.evil.org/", None], hosts) == [True, True, False, False, False, False]
    lei = lambda c: predicates.identifier_ok(F.lit("gleif_lei"), c)
    assert col(spark, ["DPRBOZP0K5RM2YE8UU08", "DPRBOZP0K5RM2YE8UU09", "DPRBOZP0K5RM2YE8UU08\n", None], lei) == [True, False, False, False]
    day = datetime.date(2026, 1, 1)
    t = spark.createDataFrame([("2020-01-01", "2021-01-01", False), ("2021-01-01", "2020-01-01", False), ("x", None, True), ("2020-01-01", "2021-01-01", True), (None, None, None)], "a string, b string, c boolean")
    assert [r[0] for r in t.select(predicates.tenure_ok(F.col("a"), F.col("b"), F.col("c"), F.lit(day))).collect()] == [True, False, False, False, True]
    s = spark.createDataFrame([("SEC Form 4", None), ("SEC Form 4", "name_only"), ("blog", None), (None, "high")], "s string, c string")
    assert [r[0] for r in s.select(predicates.is_primary(F.col("s"), F.col("c"))).collect()] == [True, False, False, False]


def test_export_identity(spark):
    ids = [{"sec_cik": "320193", "ein": "123456789"}, {"uk_company": "01234567"}, {"uk_officer": "aBc"}, {"orcid": "0000-000x"}, {"nih_pi": "7"}, {}, {"sec_cik": ""}]
    got = col(spark, ids, identity.export_identity, "map<string,string>")
    assert got == [
        {"sec_cik": "0000320193", "irs_ein": "12-3456789"}, {"canonical_id": "UKCH:01234567"}, {"canonical_id": "UKCH-OFFICER:ABC", "uk_officer_id": "aBc"},
        {"canonical_id": "ORCID:0000-000X"}, {"canonical_id": "NIH-PI:7"}, {}, {},
    ]


def test_same_person(spark):
    people = spark.createDataFrame([
        (1, "Robert Reed", {"sec_cik": "1"}), (2, "Bob Reed", {"manual": "x"}), (3, "Rob Reed", {"manual": "y"}), (4, "John Doe Jr", {}), (5, "John Doe Sr", {}),
        (6, "Ann Lee", {"sec_cik": "6"}), (7, "Ann Lee", {"sec_cik": "7"}), (8, "Sue Ray", {}), (9, "Sue Ray", {}), (10, None, None),
    ], "id long, name string, ids map<string,string>")
    ties = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (4, "A"), (5, "A"), (6, "B"), (7, "B")], "person long, org string")
    got = {(r.a, r.b): (r.decision, r.keep) for r in identity.same_person(people, ties).collect()}
    assert got[(1, 2)] == ("merge", 1) and got[(1, 3)] == ("later", 1) and (4, 5) not in got
    assert got[(6, 7)][0] == "held" and got[(8, 9)][0] == "held"
    assert identity.same_person(people.limit(0), ties).count() == 0
    listed = spark.createDataFrame([(1, 3)], "a long, b long")
    alone = {(r.a, r.b): r.decision for r in identity.same_person(people, ties.limit(0), listed).collect()}
    assert alone[(1, 3)] == "merge" and alone[(1, 2)] == "held"


def test_surname_changes_and_resolution(spark):
    p = spark.createDataFrame([(1, "Mary Smith Jones"), (2, "Mary Smith"), (3, "Ann Smith"), (4, None)], "id long, name string")
    ties = spark.createDataFrame([(1, "A"), (2, "A"), (2, "A")], "person long, org string")
    assert rows(identity.surname_change_pairs(p, ties)) == [(1, 2, 1)]
    claimed = spark.createDataFrame([(1, "Rob Reed", "Boston", None), (2, "Ann Lee", "Paris", False), (3, "J Doe", "Rome", False), (4, "Zed Zim", None, True), (5, "J Doe", None, True)], "id long, name string, city string, backed boolean")
    people = spark.createDataFrame([(10, "Robert Reed", "BOSTON, MA"), (11, "Ann Lee", "London"), (12, "John Doe", "Rome")], "id long, name string, city string")
    assert rows(identity.resolve_people(claimed, people)) == [(1, 10, "high"), (2, 11, "name_only"), (3, 12, "name_only"), (4, None, "unlinked"), (5, 12, "high")]


def test_merge_chain_and_retype(spark):
    ids = spark.createDataFrame([("a", "x", "1"), ("b", "x", "1"), ("b", "y", "2"), ("c", "y", "2"), ("d", "y", "3"), ("e", "y", None)], "id string, scheme string, value string")
    assert rows(identity.merged_by_identifier(ids, Staging(spark, "t"))) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    n = spark.createDataFrame([("p", "Alpha Fund LP", "PERSON"), ("q", "Ann Lee", "PERSON"), ("r", "Beta LLC", "ORGANIZATION")], "id string, label string, entity_type string")
    assert rows(identity.retyped(n), "id") == [("p",)]


def test_audit(spark):
    nodes = spark.createDataFrame([("A", ["DOM_A"]), ("B", ["DOM_Q"]), ("C", None)], "id string, domains array<string>")
    ids = spark.createDataFrame([("A", "sec_cik", "0000000001"), ("B", "sec_cik", "0000000001"), ("C", "sec_cik", "1")], "id string, scheme string, value string")
    schema = "id string, source string, target string, superseded_by string, verification_source string, citation_url string, document_date string, source_reference string, weight double, hash string, real_hash string"
    edges = spark.createDataFrame([
        ("ok", "A", "B", None, "Form D", "u", "d", "r", 0.5, "h", "h"), ("old", "A", "Z", "x", None, None, None, None, None, None, None), ("bad", "A", "Z", None, "see form d p. 4", "u", None, "r", 2.0, "h", "i"), ("none", "A", "B", None, None, "u", "d", "r", 1.0, None, "h"),
    ], schema)
    got = rows(audit.audit(nodes, ids, edges, ["DOM_A"], ["Form D"]), "id", "severity", "message")
    assert got == sorted([
        ("B", "error", "sec_cik is also used by A"), ("B", "warning", "unknown domain DOM_Q"), ("C", "error", "not valid: sec_cik"), ("old", "resolved", "replaced by x"), ("bad", "error", "target is no node: Z"),
        ("bad", "warning", "cites in free text: Form D"), ("bad", "warning", "missing document_date"), ("bad", "error", "weight missing or out of range"), ("bad", "error", "edited after it was recorded"),
        ("none", "error", "no accepted source type"), ("none", "info", "no verification hash"),
    ])


def test_review(spark):
    text = "## 4. Findings\n| What | x |\n| a | [s](http://x) |\n| b | none |\n## 5. Limits\n## 6. Right of reply\n| Organization | Contacted | Response |\n|---|---|---|\n| A | 2026-01-01 | |\n| B | 2026-03-01 | |\n| C | 2026-03-01 | yes |\n\n## 7. All sources"
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc string, text string")
    got = {r.doc: (r.missing, r.unlinked) for r in review.check_structure(docs, ("## 5. Limits", "## 2. Scope")).collect()}
    assert got == {"d": ("## 2. Scope", 1), "e": ("## 5. Limits; ## 2. Scope", 0)}
    named = spark.createDataFrame([("d", x) for x in "ABCD"] + [("e", "A")], "doc string, org string")
    got = rows(review.reply_status(docs, named, F.lit("2026-03-05").cast("date")))
    assert got == [("d", "A", "done"), ("d", "B", "waiting"), ("d", "C", "done"), ("d", "D", "not_contacted"), ("e", "A", "not_contacted")]
    s = spark.createDataFrame([("1", "r", "r 0000000005"), ("2", "r", "r"), ("3", "r", "x"), ("4", None, None), ("5", None, "t")], "source string, ref string, text string")
    p = spark.createDataFrame([("1", "5"), ("2", "5")], "source string, cik string")
    assert rows(review.check_sources(s, p)) == [("1", "ok"), ("2", "warn"), ("3", "block"), ("4", "block"), ("5", "ok")]


def test_enforcement(spark):
    releases = spark.createDataFrame([
        ("1", "Blackstone Agrees to Pay", ""), ("2", "x", "Blackstone Medical and Blackstone Medical"), ("3", None, "blackstone paid. Then Blackstone, of Ohio, paid"), ("4", "Target Corp sued", None), ("5", "Target practice", "target"), ("6", "x", "Ann B. Lee and Ann Lee"),
    ], "uuid string, title string, text string")
    nodes = spark.createDataFrame([("b", "Blackstone Inc.", "ORGANIZATION"), ("t", "Target", "ORGANIZATION"), ("p", "Ann Lee", "PERSON"), ("z", "Xy", "ORGANIZATION"), ("n", None, "PERSON")], "id string, label string, entity_type string")
    assert rows(enforcement.release_matches(releases, nodes), "id", "uuid", "place") == [("b", "1", "title"), ("b", "3", "text"), ("p", "6", "text"), ("t", "4", "title")]
    people = spark.createDataFrame([("a", "Ann B. Lee", "CA"), ("b", "Ann Lee Jr", "ca"), ("c", "Ann Lee", None)], "id string, label string, state string")
    listed = spark.createDataFrame([(1, "ANN", "C", "LEE", "CA"), (2, "Ann", None, "Lee", "CA")], "entry long, first string, middle string, last string, state string")
    assert rows(enforcement.excluded_people(people, listed)) == [("a", 2), ("b", 1), ("b", 2)]


def test_files(spark, tmp_path):
    assert files._front_matter("---\ntitle: 'A b'\ntags: [x, y]\nlist:\n  - 1\n  - 2\nempty:\ndone: yes\n---\nbody") == {"title": "A b", "tags": "x, y", "list": "1, 2", "empty": None, "done": "true"}
    assert col(spark, ["---\na: 1\n---", "none", None], files.front_matter) == [{"a": "1"}, None, None]
    assert col(spark, ["A1", "AB7", "z3"], files.column_number) == [1, 28, 26]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>Name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="s"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"/></row></sheetData></worksheet>')
    assert rows(files.read_xlsx(spark, str(tmp_path / "w.xlsx")), "row", "cell", "text") == [(1, "A1", "Name"), (1, "B1", "7"), (2, "A2", "Ann")]
    (tmp_path / "x.xml").write_text('<a xmlns:n="u"><n:p k="1"><name>Ann</name></n:p><n:p k="2"><name>Bob</name></n:p></a>')
    assert rows(files.read_xml(spark, str(tmp_path / "x.xml"), "p", "_k int, name string")) == [(1, "Ann"), (2, "Bob")]
    (tmp_path / "l.csv").write_bytes("NAME,STATE\nJosé,CA\n".encode("latin-1"))
    assert rows(files.read_csv(spark, str(tmp_path / "l.csv"), "NAME string, STATE string")) == [("José", "CA")]
    (tmp_path / "p.json").write_text('{"uuid":"1","n":1}\n{"uuid":"1","n":2}\n{"uuid":"2","n":1}\n')
    assert rows(files.read_json_pages(spark, str(tmp_path / "p.json"), "uuid string, n long", "uuid")) == [("1", 2), ("2", 1)]


def test_versions(spark, tmp_path):
    t = versions.VersionedTable(spark, f"file://{tmp_path}/t")
    one, two = spark.range(3), spark.range(5)
    assert t.versions() == [] and t.save(one, 0) == 1 and t.save(two, 1) == 2
    with pytest.raises(versions.ChangedError):
        t.save(one, 1)
    (tmp_path / "t" / "v=3").mkdir()
    assert t.versions() == [1, 2] and t.read()[1] == 2 and t.read(1)[0].count() == 3
    h = versions.content_hash(two)
    assert h.first() == versions.content_hash(spark.range(5).orderBy(F.desc("id")).repartition(3)).first()
    log = spark.createDataFrame([(1, "x"), (2, h.first().sha256)], "seq long, sha256 string")
    assert versions.graph_matches_log(log, h).first().ok and not versions.graph_matches_log(log.limit(0), h).first().ok
    lines = versions.chained([{"event": "a"}, {"event": "b"}])
    from quillgraph.operators import integrity

    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq long, raw string")
    assert integrity.verify_chain(frame).count() == 0


def test_tallies(spark):
    f = spark.createDataFrame([("a", True, True), ("b", False, False), ("c", None, None)], "org string, related boolean, policy boolean")
    assert rows(tallies.disclosures(f)) == [("a", "related officers"), ("b", "no conflict policy")]


def test_meeting_keys_lose_no_match(spark):
    """Every pair against those that meet on a key."""
    from pyspark.sql import functions as F

    from quillgraph.functions.names import agreement, match_people, parsed

    names = ["Bob Reed", "Robert Reed-Klages", "R Reed", "Dorothea (Dot) Lee", "Dot Lee", "Peggy Lee", "Christopher J Smith", "Chris Smith", "C. Smith", "Ann Mary Smith", "Mary Smith", "Dick Lee-Smith", "Richard Smith", "Al Smith", "Al B Smith", "Sting", "", None]
    frame = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    n = frame.select("id", parsed(F.col("name")).alias("n"))
    pairs = n.crossJoin(n.toDF("id2", "n2")).select("id", "id2", agreement(F.col("n"), F.col("n2")).alias("kind")).where("kind is not null")
    want = sorted((r.id, r.id2, r.kind) for r in pairs.collect())
    assert rows(match_people(frame, frame)) == want and len(want) > 20
