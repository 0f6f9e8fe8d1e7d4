"""What the driver holds and plans: rounds of components that are needed, arrays of the features that are there."""

import tracemalloc

import numpy as np

from quillgraph.llm import minhash, toxicity
from quillgraph.operators.components import connected_components
from quillgraph.plans.staging import Staging


class Named(Staging):
    def write(self, df, name="t"):
        self.names = [*getattr(self, "names", []), name]
        return super().write(df, name)


def test_stars_are_components_without_a_round(spark):
    st = Named(spark, "t")
    links = spark.createDataFrame([(1, 5), (6, 1), (1, 5), (7, 2), (2, 2)], "src long, dst long")
    assert sorted(tuple(r) for r in connected_components(links, st).collect()) == [(1, 1), (2, 2), (5, 1), (6, 1), (7, 2)]
    assert st.names == ["edges"]
    # A chain needs rounds, the last of which is not repeated.
    st = Named(spark, "t")
    chain = spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "src long, dst long")
    assert {r.component for r in connected_components(chain, st).collect()} == {1}
    assert len(st.names) <= 3


def test_late_links_join_components_not_documents():
    sets = [np.arange(i, 100 + i, dtype=np.uint64) for i in (0, 0, 1)]
    assert minhash._links_of(np.array([7, 7, 9]), np.array([False, False, True]), sets, 80, 100) == ([9], [7])


def test_labels_of_late_links_reach_all_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}x{j}" for j in range(30))) for i in range(6)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "_open", lambda labelled: labelled.sparkSession.range(1))
    monkeypatch.setattr(minhash, "_across", lambda docs, *_: docs.sparkSession.createDataFrame([(4, 2)], "src long, dst long"))
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (2, True), 3: (2, False), 4: (2, False), 5: (2, False)}


def test_training_holds_the_features_of_its_rows():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 1 << toxicity.BITS, 50).astype(np.int32)) for _ in range(40)]
    tracemalloc.start()
    machine = toxicity.fit(rows, np.arange(40) % 2.0, sparse=0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and machine.weights.any() and machine.factors.shape == (1 << toxicity.BITS, toxicity.RANK)
    for x in [*rows, rows[0][:0]]:
        assert (toxicity._unpacked(toxicity._packed(x)) == x).all()
