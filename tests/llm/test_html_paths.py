"""Tag-path scores decide: on pages without telling tags or names, and against switched-off scores."""

import html as entities
import re
import time

import pyarrow.parquet as pq
import pytest

from quillgraph.llm import html

ARTICLE = "<h1>Title</h1><p>A first, long sentence of the article; it has commas, and more.</p><p>The second one, as long as the first, ends the article here.</p>"
WHOLE = "Title\n\nA first, long sentence of the article; it has commas, and more.\n\nThe second one, as long as the first, ends the article here."


def article_of(page):
    body = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.DOTALL)[1])
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(filter(None, parts))


@pytest.fixture(scope="module")
def rows():
    return [r["html"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]


def test_pages_without_article_elements(rows):
    for page in rows:
        assert html.main_text(page.replace("article>", "div>")) == article_of(page)


def test_pages_whose_tags_and_names_say_nothing(rows):
    """Menus, adverts and footers are bare divs: the articles are whole, and most texts are nothing else."""
    bare = lambda p: re.sub(r"</?(?:nav|footer|article)>", lambda m: "</div>" if "/" in m[0] else "<div>", p).replace(' class="ad"', "")
    got = [(html.main_text(bare(p)), article_of(p)) for p in rows]
    assert all(want in text for text, want in got)
    assert sum(text == want for text, want in got) >= 0.6 * len(got)


def test_switched_off_scores_change_texts(rows, monkeypatch):
    monkeypatch.setattr(html, "path_scores", lambda page: {page.path[b[0]]: 1 / page.factor[page.path[b[0]]] for b in page.blocks})
    assert all(html.main_text(p) != article_of(p) for p in rows)


def test_names_never_empty_a_page():
    for name in ("content no-sidebar", "entry-content has-related", "main-content with-sidebar", "post share-enabled", "article-comments-closed", "sidebar", "comments"):
        for tag in ("article", "div"):
            page = f'<html><body><nav><ul><li><a href="/">Home, sweet home</a></ul></nav><div class="{name}"><{tag}>{ARTICLE}</{tag}></div><footer>Me, myself, and I.</footer></body></html>'
            assert html.main_text(page) == WHOLE


def test_text_inside_an_article_stays():
    page = f"<article>{ARTICLE}<p><label>A label</label> <output>42</output> <math><mi>x</mi></math> <object>fallback</object></p><button>Share</button></article>"
    assert html.main_text(page) == WHOLE + "\n\nA label 42 x fallback"


def test_time_is_linear_in_depth():
    n = 100_000
    for page in ("<div>a" * n, "<div>" * n + "a", "<table><td><table>" + "<div>" * n + "<tr>" * n + "a", "<li><ul>" + "<div>" * n + "<li>" * n, "<" * n, "<!--" * n, "<script>" * n, '<a "' * n):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 10
