"""Substring dedup against all windows of all documents in plain Python, and its odd inputs."""

import hashlib
import random
import re

import pytest

from quillgraph.llm import queries, substrings

DOC = "doc_id long, text string, t long, start int, key string, wanted string"


def brute(rows, window=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, r[0]), r[0])
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < r[0]:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(spark, rows, window=13, gram=7):
    found = substrings.dedup_substrings(spark.createDataFrame([(*r, 1, 2, "k", "w") for r in rows], DOC), window, gram)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted(repr(tuple(r)) for r in found.collect())


def prose(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return ["w%d" % r.randrange(vocabulary) for _ in range(n)]


def corpus(seed):
    """Copies, edited copies, shared passages at any place, and passages cut short."""
    r = random.Random(seed)
    base, passages = prose(300, seed), [prose(r.randint(13, 90), seed + 10 + i) for i in range(6)]
    texts = [base] * 6
    for _ in range(25):
        w = list(base)
        for _ in range(r.randint(1, 6)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = ["edit%d" % r.randrange(5)]
        texts.append(w)
    for i in range(60):
        w = prose(r.randint(0, 120), seed + 100 + i)
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 8)
            at = r.randint(0, len(w))
            w[at:at] = p[cut : len(p) - r.randint(0, 8)]
        texts.append(w)
    r.shuffle(texts)
    return [(i * 3 - 50, r.choice([" ", "\n", "\t \x0b"]).join(w)) for i, w in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_edits_and_passages(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize(("vocabulary", "window", "gram"), [(2, 13, 7), (3, 6, 3), (1, 13, 7), (4, 5, 5), (3, 5, 1)])
def test_few_words_so_that_paths_branch_everywhere(spark, vocabulary, window, gram):
    r = random.Random(vocabulary)
    rows = [(r.randrange(60), " ".join(prose(r.randint(0, 60), 1000 + i, vocabulary))) for i in range(80)]
    assert got(spark, rows, window, gram) == brute(rows, window)


def test_nulls_ties_repeats_and_nothing(spark):
    p, q = " ".join(prose(40, 1)), " ".join(prose(14, 2))
    rows = [(5, p), (5, p), (5, f"{q} {p}"), (7, p), (7, p), (None, p), (None, f"x {p}"), (3, q), (9, None), (10, ""), (11, " \n\t"), (12, " ".join(prose(12, 2))), (6, f"{q} own {p} own {q}"), (8, f"{p} {p}"), (4, "ÄÖ ünï 漢字 " * 9), (13, "ÄÖ ünï 漢字 " * 5)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:1]) == brute(rows[:1])
    assert got(spark, []) == []


def test_long_texts_and_broadcasts(spark, monkeypatch):
    long = " ".join(prose(400_000, 3, 10**6))
    rows = [(1, " ".join(long.split()[1000:1400])), (2, long), (3, "x" * 3_000_000), (4, long[500_000:]), (5, "a b c " * 40)]
    want = brute(rows)
    assert got(spark, rows) == want
    monkeypatch.setattr(substrings, "BROADCAST_DOCS", -1)
    assert got(spark, rows[:1] + corpus(4)) == brute(rows[:1] + corpus(4))


def test_a_span_that_differs_from_its_source_stays(spark):
    h = substrings.np.arange(1, 41, dtype="uint64")
    sums = substrings._sums(h).view("int64")
    for shift in (0, 1):
        spans = substrings.pa.array([[{"lo": 3, "size": 20, "place": 13, "s0": int(sums[3]), "s1": int(sums[23]) + shift}]], substrings.pa.list_(substrings.pa.struct([("lo", "int32"), ("size", "int32"), ("place", "int32"), ("s0", "int64"), ("s1", "int64")])))
        # The same words, ten places later in the source.
        moved = substrings._sums(substrings.np.concatenate([h[:10] * 0, h])).view("int64")
        spans = substrings.pa.array([[{**spans[0].as_py()[0], "s0": int(moved[13]), "s1": int(moved[33]) + shift}]], spans.type)
        assert substrings._verified(h, spans[0]).sum() == (0 if shift else 20)


def test_query_over_the_tables_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = sorted(repr(tuple(r)) for r in queries.op13_substring_dedup(spark, small).collect())
    assert found == brute(rows)
