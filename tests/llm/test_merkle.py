"""The manifest against a sequential tree in plain Python, at several block heights, and its odd inputs."""

import hashlib
import random
import zlib

import pytest
from parity import duck_rows, spark_rows

from quillgraph.llm import merkle, queries

DOC = "text string, doc_id long, lang string, source string, n_chars long, idx long, tree string, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[1], row[3], row[2], row[4], text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    path = []
    for nodes in levels[:-1]:
        lo = i - i % 3
        path.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 3])))
        i //= 3
    return path


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[1] is not None, r[1] or 0, leaf_of(r, r[0]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, (_, _, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, n)
            tampered = r[1] is not None and zlib.crc32(str(r[1]).encode()) % 2 == 0 and r[0] is not None
            digest = leaf_of(r, r[0].replace("\n", "")) if tampered else leaf
            for left, right in path:
                digest = h(left + digest + right)
            out.append((r[1], leaf, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in path)), digest, digest == top[-1][0]))
    return sorted(map(repr, out))


def got(spark, rows, height=7):
    return sorted(repr(tuple(r)) for r in merkle.manifest(spark.createDataFrame(rows, DOC), height).collect())


def some_rows(n, n_sources, seed):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "line\nbreak", "ü\nñ 漢", "plain", "a\n" * 500])
    return [(text(), i - 3, r.choice(["en", None]), r.choice([*(f"s{k}" for k in range(n_sources)), "Z", "é"]), r.choice([None, 7]), 0, "t", "l") for i in range(n)]


@pytest.mark.parametrize("height", [1, 2, 7])
@pytest.mark.parametrize(("n", "n_sources"), [(1, 1), (4, 1), (90, 2), (60, 30)])
def test_manifest_equals_the_sequential_tree(spark, height, n, n_sources):
    rows = some_rows(n, n_sources, 10 * n + height)
    assert got(spark, rows, height) == brute(rows)


def test_one_source_with_all_rows(spark):
    rows = [(f"t{i}\n", i, "en", "only", i, 0, "t", "l") for i in range(700)]
    assert got(spark, rows, 2) == brute(rows)


def test_nulls_ties_repeats_and_nothing(spark):
    rows = some_rows(20, 2, 5)
    rows += [rows[3]] * 6 + [("other", rows[3][1], "en", rows[3][3], 1, 0, "t", "l")] + [("x\ny", None, None, None, None, 0, "t", "l")] * 2 + [("x", 9, None, "", 1, 0, "t", "l"), ("x", 9, None, None, 1, 0, "t", "l")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_tampering_is_found_and_nothing_else(spark):
    rows = [("a\nb" if i % 3 else "ab", i, "en", "s", 3, 0, "t", "l") for i in range(60)]
    for r in merkle.manifest(spark.createDataFrame(rows, DOC)).collect():
        assert r.verified == (r.doc_id % 3 == 0 or zlib.crc32(str(r.doc_id).encode()) % 2 == 1)


def test_manifest_matches_sql(spark, small):
    assert spark_rows(queries.op11_merkle_manifest(spark, small)) == duck_rows(queries.ORACLE_SQL["op11_merkle_manifest"], small)
