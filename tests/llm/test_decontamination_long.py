"""Very long texts: read in pieces, hits in batches, results as for short ones."""

import numpy as np
from pyspark.sql import functions as F
from test_operators import docs, words

from quillgraph.llm import decontaminate as op


def test_one_text_of_fifty_megabytes(spark):
    item = " ".join(words(40, 31))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    filler = F.expr("repeat('zebra quince 12 Maria yonder, ', 900000)")
    texts = spark.createDataFrame([(1, item), (2, ""), (3, item[: len(item) // 5])], "doc_id long, end string")
    long = texts.select("doc_id", F.concat(filler, F.col("end"), filler).alias("text"))
    assert long.where("doc_id = 1").select(F.length("text")).first()[0] > 50_000_000
    got = {r.doc_id: list(r["items"]) for r in op.decontaminate(long, bench).collect()}
    assert got == {1: [7], 2: [], 3: []}


def test_pieces_give_the_words_of_the_whole():
    text = " ".join(words(400_000, 32)).encode()
    pieces = list(op._pieces(text))
    assert len(pieces) > 1 and b"".join(pieces) == text
    split = op.Words()
    [named, plain, verbatim] = op.streams(split, [text, b"", b"one two"])
    assert [split.words[i] for i in verbatim.ids] == text.split() + [b"one", b"two"]
    assert np.bincount(verbatim.owner, minlength=3).tolist() == [400_000, 0, 2]


def test_more_hits_than_a_batch(spark):
    item = " ".join(words(30, 33))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    [row] = op.decontaminate(docs(spark, [" ".join([item] * (2 * op.HITS // 25))]), bench).collect()
    assert row["contaminated"] and list(row["items"]) == [1] and row["coverage"] == 1.0
