"""The pipeline's stages, each on the output of the one before, against brute force."""

import re

import corpus_pipeline
from test_operators import components, docs, shingles, words

from quillgraph.llm import toxicity


def test_stages_and_run(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash_near_dedup", "decontamination", "mixing"]
    before, seen = d, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, small).cache()
        seen[name] = (before.collect(), after.collect())
        assert name == "mixing" or after.schema.names == d.schema.names
        before = after

    was, now = seen["toxicity"]
    machine = toxicity.train(d, spark.read.parquet(f"{small}/labels.parquet"))
    terms = toxicity.Terms()
    assert {r.doc_id for r in now} == {r.doc_id for r in was if machine.score(terms.of((r.text or "").encode())) < 0.5} and len(now) < len(was)

    was, now = seen["line_dedup"]
    assert [r.doc_id for r in sorted(was)] == [r.doc_id for r in sorted(now)] and all(r.n_chars == len(r.text) for r in now)

    was, now = seen["minhash_near_dedup"]
    s = {r.doc_id: shingles(r.text, 5) for r in was}
    linked = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
    label = components(s, linked)
    assert {r.doc_id for r in now} == {i for i in s if label[i] == i} and linked

    was, now = seen["decontamination"]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    items = [plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in now} == {r.doc_id for r in was if not any(i in plain(r.text) for i in items)} and len(now) < len(was)

    was, now = seen["mixing"]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in was)
    assert 0 <= 1.5 * total - sum(r.taken for r in now) <= 20 and {r.doc_id for r in now} <= {r.doc_id for r in was}

    assert sorted((r.doc_id, r.taken) for r in corpus_pipeline.run(spark, small).collect()) == sorted((r.doc_id, r.taken) for r in now)


def test_odd_documents_pass_through(spark, small):
    copy = " ".join(words(40, 1))
    d = docs(spark, [None, "", copy, copy, copy + " x", "menu\nmenu", " ".join(words(9000, 2))], {i: f"site{i}" for i in range(7)})
    d = d.union(d.where("doc_id = 3"))
    before = d
    for name, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, small).cache()
        assert name == "mixing" or before.columns == d.columns
        if name == "minhash_near_dedup":
            assert sorted(r.doc_id for r in before.collect()) == [0, 1, 2, 5, 6]
    assert before.count() >= 1
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0
