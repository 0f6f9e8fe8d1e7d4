"""Filings are dealt by what their key is made of: the hash is made behind the shuffle, the newest filing kept once."""

import hashlib

from quillgraph.operators.changes import merged_filings


def test_key_is_hashed_behind_the_shuffle(spark):
    cols = "src string, dst string, relation string, qualifier string, source string, filing_date string, evidence_url string, percent int"
    rows = [
        ("a", "b", "R", None, "X one", "2001-01-02", "u1", 1), ("a", "b", "R", None, "X two", "2001-01-02", "u2", None), ("a", "b", "R", "", "X", "2001-01-01", "u3", 3),
        ("a", "b", "R", None, None, None, "u4", 4), ("a", "a", "R", None, "X", "2001-01-01", "u5", 5), ("a", "b", "R", None, "Y", "2001-01-01", None, 6), ("a", "b", "R", None, "Y z", None, "u7", 7),
    ]
    out = merged_filings(spark.createDataFrame(rows, cols), facts=("percent",))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {
        (sha("a|b|R||X"), "a", "b", "R", None, "2001-01-02", "2001-01-02", 2, None, "X two", "u2"), (sha("a|b|R||X"), "a", "b", "R", "", "2001-01-01", "2001-01-01", 1, 3, "X", "u3"),
        (sha("a|b|R||"), "a", "b", "R", None, None, None, 1, 4, None, "u4"), (sha("a|b|R||Y"), "a", "b", "R", None, "2001-01-01", "2001-01-01", 2, 6, "Y", None),
    }
    assert {tuple(r) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2") < plan.index("Aggregate") and "sha2" not in plan[plan.index("Aggregate") :]
