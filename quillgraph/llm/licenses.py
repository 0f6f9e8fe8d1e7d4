"""License scan by diagonal voting.

Every rolling word k-gram of every document is joined in Spark to the positions of the same k-gram in
the license templates. A pair of positions votes for the offset diagonal (document position minus
template position); votes are counted per diagonal, neighbouring diagonals of long templates are merged
(an inserted or missing word moves the diagonal by one), and a span counts once enough of the
template's k-grams stand on it: all of them for a phrase, a share for a long notice.

Odd input: a null text is empty and has no words; every row gives a row, exact repeats included; a null
doc_id keeps its row; extra columns are ignored. A document without
hits has n_base 0, null first_word and last_word, empty labels and score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.words import WordHashes, plain_words, rolling, slices, texts

# The base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases and their labels.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
}
# Opening sentences of license notices.
NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

#: Template positions this many or fewer may be broadcast (a few dozen bytes each).
BROADCAST_POSITIONS = 500_000
PHRASE_K, NOTICE_K = 2, 5


def templates(phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> list[tuple]:
    """(gram, template, tpos, grams, label, base, phrase) rows of the templates; hashes at their k."""
    rows = []
    more = MORE_PHRASES if phrases is None else phrases
    known = [(t, label, True, PHRASE_K) for t, label in BASE_PHRASES.items()] + [(t, label, False, PHRASE_K) for t, label in more.items()]
    known += [(t, label, False, NOTICE_K) for label, t in (NOTICES if notices is None else notices).items()]
    hashes = WordHashes()
    for n, (text, label, base, k) in enumerate(known):
        grams = rolling(hashes.of(plain_words(text.encode())), k).view(np.int64)
        rows += [(int(g), n, i, len(grams), label, base, k == PHRASE_K) for i, g in enumerate(grams)]
    return rows


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per k-gram; and one closing row per document: null gram, its id, its number of words."""
    hashes = WordHashes()
    for part in slices(batches, 256):
        uids, ids = part.column(0).to_pylist(), part.column(1)
        owner, pos, grams, n_words = [], [], [], []
        for uid, text in zip(uids, texts(part.column(2)), strict=True):
            h = hashes.of(plain_words(text))
            n_words.append(len(h))
            for g in [rolling(h, k) for k in (PHRASE_K, NOTICE_K) if len(h) >= k]:
                owner.append(np.full(len(g), uid)), pos.append(np.arange(len(g), dtype=np.int32)), grams.append(g.view(np.int64))
        found = sum(map(len, grams))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([*owner, np.array(uids, np.int64)])), pa.concat_arrays([pa.nulls(found, pa.int64()), ids]),
                pa.array(np.concatenate([*pos, np.array(n_words, np.int32)])), pa.concat_arrays([pa.array(np.concatenate([*grams, np.empty(0, np.int64)])), pa.nulls(len(uids), pa.int64())]),
            ],
            ["row", "doc_id", "pos", "gram"],
        )


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None, share: float = 0.6, gap: int = 2) -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score, and the spans.

    ``spans`` lists (label, first word, end word, share of the template's k-grams found).
    """
    spark = docs.sparkSession
    rows = templates(phrases, notices)
    table = spark.createDataFrame(rows, "gram long, template int, tpos int, grams int, label string, base boolean, phrase boolean")
    if len(rows) <= BROADCAST_POSITIONS:
        table = F.broadcast(table)
    # All that refers to a row's number comes from the one task that reads it.
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    grams = read.mapInArrow(_grams, "row long, doc_id long, pos int, gram long")
    hits = grams.join(table, "gram", "left").where("template is not null or gram is null")

    # Votes by diagonal. The closing row of a document goes along as the group without a template.
    places = hits.withColumn("diag", F.col("pos") - F.col("tpos"))
    votes = places.groupBy("row", "template", "diag").agg(
        F.collect_set("tpos").alias("at"), F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("template").isNull(), F.col("pos"))).alias("n_words"),
        *[F.max(c).alias(c) for c in ("grams", "label", "base", "phrase")],
    )
    w = Window.partitionBy("row", "template").orderBy("diag")
    apart = F.col("phrase") | F.lag("diag").over(w).isNull() | (F.col("diag") - F.lag("diag").over(w) > gap)
    merged = votes.withColumn("cluster", F.sum(apart.cast("int")).over(w)).groupBy("row", "template", "cluster").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"), F.min(F.col("diag") + F.array_min("at")).alias("start"),
        F.max(F.col("diag") + F.array_max("at")).alias("last_gram"), F.min("diag").alias("diag"), *[F.max(c).alias(c) for c in ("doc_id", "n_words", "grams", "label", "base", "phrase")],
    )
    cover = F.col("found") / F.col("grams")
    ok = F.when(F.col("phrase"), F.col("found") == F.col("grams")).otherwise(cover >= share)
    spans = merged.withColumn("score", cover).withColumn("ok", F.coalesce(ok, F.lit(False)))
    here, place = F.col("ok") & F.col("base"), F.col("start").cast("long")
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(NOTICE_K)
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"), F.count(F.when(here, 1)).alias("n_base"),
        F.min(F.when(here, place)).alias("first_word"), F.max(F.when(here, place)).alias("last_word"),
        joined(here).alias("base_labels"), joined(F.col("ok")).alias("labels"), F.coalesce(F.max(F.when(F.col("ok"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("label", place.alias("start"), (F.col("last_gram") + k).cast("long").alias("end"), "score")))).alias("spans"),
    ).drop("row")
