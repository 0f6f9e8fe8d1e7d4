"""Edited, partial and placeholder-only copies of benchmark items."""

import random
import re

from pyspark.sql import functions as F
from test_operators import docs, words

from quillgraph.llm import decontaminate


def changed(item, *at):
    w = item.split()
    for i in at:
        w[i] = "changed"
    return " ".join(w)


def test_edited_and_partial_copies(spark):
    short, long = " ".join(words(20, 21)), " ".join(words(40, 22))
    slots = "first take 12 red stones then put 5 blue ones beside all 12 of them and count again"
    numbers = "12 7 Maria 30 9 41 Tom 8 15 2 77 Ann"
    texts = [
        short,  # 0
        *[f"intro words {changed(short, i)} last words" for i in (1, 3, 10, 17)],  # 1-4
        changed(long, 12, 27),  # 5
        " ".join(long.split()[10:26]),  # 6: a passage
        slots.replace("12", "13", 1),  # 7: verbatim but for one of two equal numbers
        f"see {numbers} there",  # 8
        numbers.replace("30", "31").replace("7", "6").replace("9", "4").replace("15", "3"),  # 9: same shape, other values
        " ".join(long.split()[10:18]),  # 10: too little
        slots.replace("12", "13", 1).replace("red", "old").replace("blue", "new").replace("all", "both"),  # 11: other slots and words
        " ".join(words(60, 23)),  # 12
    ]
    bench = spark.createDataFrame([(1, short), (2, long), (3, slots), (4, numbers)], "item_id long, text string")
    got = {r.doc_id: list(r["items"]) for r in decontaminate.decontaminate(docs(spark, texts), bench).collect()}
    assert got == {0: [1], 1: [1], 2: [1], 3: [1], 4: [1], 5: [2], 6: [2], 7: [3], 8: [4], 9: [], 10: [], 11: [], 12: []}


def test_numbers_units_and_short_items(spark):
    slots = "Maria drives 30 km in 5 hours and then she walks 12 km more before Maria sleeps in Rome"
    items = [(1, "Compute 12 37 45 99 3 and 18"), (2, slots), (3, "What now?"), (4, "Solve it, x y z w v u"), (5, "the 1,250 apples of a farm cost how much in all")]
    texts = [
        "Compute 12 37 45 99 3 and 18",  # 0: mostly values, verbatim
        "Compute 11 38 44 98 2 and 17",  # 1: other values: mostly placeholders, so no match
        slots.replace("30 km", "30km"),  # 2: the same values
        slots.replace("5 hours", "7.5 hours"),  # 3
        slots.replace("12 km", "twenty-five km"),  # 4
        slots.replace("Maria", "Tom Smith").replace("Rome", "New York"),  # 5
        slots.replace("Maria sleeps", "Ann sleeps"),  # 6: one name becomes two: only its words tell
        "WHAT NOW",  # 7: a short item is the whole text
        "well, what now?",  # 8: more than a short item
        "the 1250 apples of a farm cost how much in all",  # 9: the same value
        "the 999 apples of a farm cost how much in all",  # 10
        "solve it x y z w v u " * 3,  # 11
    ]
    d = docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (list(r["items"]), r.reparameterised) for r in decontaminate.decontaminate(d, bench).collect()}
    assert got == {0: ([1], False), 1: ([], False), 2: ([2], False), 3: ([2], True), 4: ([2], True), 5: ([2], True), 6: ([2], False), 7: ([3], False), 8: ([], False), 9: ([5], False), 10: ([5], True), 11: ([4], False)}
    again = decontaminate.decontaminate(d.union(d.where("doc_id < 3")).union(d.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))), bench).collect()
    assert len(again) == len(texts) + 4 and sum(r.doc_id == 0 for r in again) == 2 and [r.contaminated for r in again if r.doc_id is None] == [True]


def slots_of(text):
    """Template of a text by brute force: (tokens, slot values), numbers and names as slots."""
    tokens, values = [], []
    for w in re.findall(r"[A-Za-z0-9]+", text):
        kind = "number" if w[0].isdigit() else "name" if w[0].isupper() else None
        if kind and tokens and tokens[-1] == f"<{kind}>":
            values[-1] += "." + w if kind == "number" else w.lower()
        else:
            tokens.append(f"<{kind}>" if kind else w.lower())
            values.append(w.lower() if kind else None)
    return tokens, values


def test_slots_against_brute_force(spark):
    """Random re-parameterised copies: found exactly if templates are equal and values map one to one way."""
    r = random.Random(4)
    plain = [w for w in words(40, 30) if w not in decontaminate.UNITS and w not in decontaminate.NUMBERS]
    items, texts = [], []
    for i in range(12):
        t = [r.choice(plain) if n % 4 else r.choice(["Ann", "Bob", "7", "12", "30"]) for n in range(24)]
        items.append((i, " ".join(t)))
        for _ in range(6):
            swap = {v: r.choice(["Cid", "Dan"]) if v[0].isupper() else str(r.randint(40, 44)) for v in set(t) if v[0].isupper() or v[0].isdigit()}
            copy = [swap.get(w, w) for w in t]
            if r.random() < 0.5:  # one slot breaks the mapping
                at = r.choice([n for n in range(24) if n % 4 == 0])
                copy[at] = "Eve" if t[at][0].isupper() else "99"
            # Plain words that change keep the verbatim share under the threshold.
            texts.append((i, " ".join(copy)))
    got = {g.doc_id: g for g in decontaminate.decontaminate(docs(spark, [t for _, t in texts]), spark.createDataFrame(items, "item_id long, text string"), cover=0.9, run=100).collect()}
    known = dict(items)
    for n, (i, text) in enumerate(texts):
        (a, va), (b, vb) = slots_of(known[i]), slots_of(text)
        pairs = {(x, y) for x, y in zip(va, vb, strict=True) if x}
        consistent = a == b and len({x for x, _ in pairs}) == len(pairs)
        w, v = known[i].lower().split(), text.lower().split()
        verbatim = sum(x == y for x, y in zip(w, v, strict=True)) >= 0.9 * len(w)
        assert (i in got[n]["items"]) == (consistent or verbatim), (known[i], text)
        assert got[n].reparameterised == (consistent and any(x != y for x, y in pairs))
