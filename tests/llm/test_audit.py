"""The filter audit against documents taken one by one through every order."""

import random
import re
from itertools import permutations

import numpy as np
from parity import duck_rows, spark_rows

from quillgraph.llm import audit, queries

DOC = "doc_id long, text string, lang string, part string, m int, mask int, quality int, t string"
LABEL = "doc_id long, quality int, toxic int, id long"


def fails(text, doc_id, rows):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    same = any(r[0] is not None and doc_id is not None and r[0] < doc_id and (r[1] or "") == text for r in rows)
    tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), same)
    return {f for f, t in zip("ABCDE", tests, strict=True) if t}


def brute(rows, labels):
    mark = lambda i, c: any(x[0] == i and x[c] == 1 for x in labels) if i is not None else False
    docs = [(r[2] or "", fails(r[1] or "", r[0], rows), mark(r[0], 1), mark(r[0], 2)) for r in rows]
    out = {}
    for part in {d[0] for d in docs}:
        whole = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[1]]
                before = [d for d in docs if d[0] == part and d not in left]
                left = [d for d in left if name not in d[1]]
                earlier = sum(1 for d in docs if d[0] == part and name in d[1]) - len(gone)
                only = sum(1 for d in docs if d[0] == part and d[1] == {name})
                out[part, "".join(order), step] = [len(left), len(gone), earlier, only, sum(d[2] for d in gone), sum(d[3] for d in gone), name]
                whole[name] += len(gone)
                del before
        for key, v in out.items():
            if key[0] == part:
                v[6] = whole[v[6]]
    return {k: tuple(v) for k, v in out.items()}


def got(spark, rows, labels):
    out = audit.audit_filters(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL)).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}
    assert len(found) == len(out) and all(r.filter == r.filter_order[r.step - 1] for r in out)
    return found


def some(n, seed):
    r = random.Random(seed)
    shared = [" ".join("w%d" % r.randrange(k) for _ in range(m)) for k, m in ((999, 250), (20, 250), (999, 50), (3, 9))]
    rows = []
    for i in range(n):
        text = r.choice([*shared, None, "", " \n\t", " ".join("w%d" % r.randrange(5000) for _ in range(r.choice([199, 200, 201]))) + r.choice(["", " $", " " + "A" * 50, "\x0b|", " x"])])
        rows.append((i, text, r.choice(["en", "de", None, ""]), "p", 1, 1, 1, "t"))
    return rows, [(i, r.choice([0, 1, None]), r.choice([0, 1]), 1) for i in range(0, n, 2)]


def test_audit_equals_documents_one_by_one(spark):
    rows, labels = some(150, 1)
    assert got(spark, rows, labels) == brute(rows, labels)


def test_nulls_ties_repeats_and_nothing(spark):
    rows, labels = some(20, 2)
    rows += [rows[4]] * 3 + [(5, "same", "en", "p", 1, 1, 1, "t"), (5, "same", "de", "p", 1, 1, 1, "t"), (None, "same", "en", "p", 1, 1, 1, "t"), (6, "same", "en", "p", 1, 1, 1, "t"), (None, "alone", "xx", "p", 1, 1, 1, "t"), (-9, "same", "de", "p", 1, 1, 1, "t")]
    labels += [(5, 0, 0, 1), (5, 1, 1, 1), (None, 1, 1, 1)]
    assert got(spark, rows, labels) == brute(rows, labels)
    assert got(spark, [], labels) == {}
    assert got(spark, rows, []) == brute(rows, [])


def test_one_long_text_and_many_copies(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(i, long if i < 2 else "copy # of one text", "en", "p", 1, 1, 1, "t") for i in range(300)]
    found = got(spark, rows, [])
    assert found["en", "EABCD", 1][:2] == (2, 298) and found["en", "ABCDE", 5][:4] == (1, 1, 297, 1)


def test_matrices_account_for_every_mask():
    by = audit.outcome_matrices()
    assert all(m.shape == (32, 600) for m in by.values())
    removed = by["removed"].reshape(32, 120, 5)
    assert np.array_equal(removed.sum(axis=2) + by["kept"].reshape(32, 120, 5)[:, :, -1], np.ones((32, 120), int))


def test_audit_matches_sql(spark, small):
    assert spark_rows(queries.op12_filter_audit(spark, small)) == duck_rows(queries.ORACLE_SQL["op12_filter_audit"], small)
