"""Planted boilerplate and long passages go, clean lines and copies stay, at two table sizes."""

import random

import pytest
from parity import duck_rows, spark_rows
from test_operators import docs, words

from quillgraph.llm import lines, queries


@pytest.mark.parametrize("n", [400, 4000])
def test_planted_lines_go_and_clean_ones_stay(spark, n):
    r = random.Random(n)
    common = words(300, 2)
    sentence = lambda k: " ".join(r.choice(common) for _ in range(k))
    passages = [" ".join(words(55, 40 + i)) for i in range(5)]
    assert all(len(p) >= lines.LONG_CHARS for p in passages)
    body = {}
    for i in range(n):
        body[i] = [sentence(r.randint(8, 30)) for _ in range(r.randint(2, 6))]
    # Boilerplate in 3 % of the pages, each passage in four, a short line in 1 %.
    for i in range(0, n, 33):
        body[i].insert(r.randrange(len(body[i])), "site menu and terms")
    for k, p in enumerate(passages):
        for i in range(4):
            body[10 + 7 * k + 60 * i].append(p)
    for i in range(5, n, 100):
        body[i].append("a remark")
    texts = ["\n".join(x) for x in body.values()]
    # Copies: one text many times over, another with a line changed in each.
    base = [" ".join(words(60, 90 + i)) for i in range(9)]
    texts += ["\n".join(base)] * 30
    for i in range(30):
        edited = list(base)
        edited[i % 9] = f"edited {i} " + edited[i % 9]
        texts.append("\n".join(edited))
    # Copies of two lines, of which one is changed in each.
    two = [" ".join(words(60, 190 + i)) for i in range(2)]
    texts += [f"{two[0]}\n{two[1]} edit{i}" for i in range(12)] + ["\n".join(two)] * 5
    got = {x.doc_id: x.text for x in lines.dedup_lines(docs(spark, texts)).collect()}
    gone = {"site menu and terms", *passages}
    for i, t in enumerate(texts):
        assert got[i] == "\n".join(x for x in t.split("\n") if x not in gone)


def test_lines_match_sql_at_a_larger_size(spark):
    assert spark_rows(queries.op9_line_dedup(spark, "/root/testdata/sf0.01")) == duck_rows(queries.ORACLE_SQL["op9_line_dedup"], "/root/testdata/sf0.01")


def test_column_names_and_salted_hosts(spark, monkeypatch):
    d = docs(spark, [f"menu\nunique {i}" for i in range(20)])
    want = sorted(r.text for r in lines.dedup_lines(d).collect())
    odd = d
    for name in ("bad", "By", "salt", "part", "__drop", "__h", "a.b", "t", "k"):
        odd = odd.withColumn(name, d["lang"])
    for most in (lines.BROADCAST_LINES, -1):
        monkeypatch.setattr(lines, "BROADCAST_LINES", most)
        out = lines.dedup_lines(odd)
        assert out.columns == odd.columns and sorted(r.text for r in out.collect()) == want == sorted(f"unique {i}" for i in range(20))
        assert {r["a.b"] for r in out.collect()} == {"en"}
