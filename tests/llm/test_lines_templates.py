"""Line dedup on sites with a template: what stands on all pages goes, however little else a page has."""

import pytest
from test_operators import docs, words

from quillgraph.llm import lines


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("own", [1, 2, 3])
@pytest.mark.parametrize("n_template", [3, 8, 20, 50])
def test_templates_vanish_whole(spark, n_template, own, copies):
    template = [f"menu entry {i} of this site" for i in range(n_template)]
    pages = [[f"page {i} has its own line {j} here" for j in range(own)] for i in range(300)]
    texts = ["\n".join([*template[: n_template // 2], *p, *template[n_template // 2 :]]) for p in pages]
    base = [" ".join(words(30, 50 + i)) for i in range(8)]
    edited = [[*base[: i % 8], f"note {i} {base[i % 8]}", *base[i % 8 + 1 :]] for i in range(24)] if copies else []
    texts += ["\n".join([*template, *p]) for p in edited]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {i: "\n".join(p) for i, p in enumerate(pages + edited)}


def test_plain_ratio_over_different_texts(spark):
    texts = [f"often\nrare{i % 100}\ntext number {i} alone" for i in range(400)] + ["a copy\nof one page"] * 200
    got = [r.text for r in lines.dedup_lines(docs(spark, texts), ratio=0.012).collect()]
    assert sorted(got) == sorted([f"rare{i % 100}\ntext number {i} alone" for i in range(400)] + ["a copy\nof one page"] * 200)
