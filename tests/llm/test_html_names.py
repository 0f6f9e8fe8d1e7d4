"""Articles on pages whose markup names, nests or closes things in other ways."""

from quillgraph.llm.html import main_text

TEXT = "A first, long sentence of the article; it has commas, and more."
MORE = "The second one, as long as the first, ends the article here."
ARTICLE = f"<article><h1>Title</h1><p>{TEXT}</p><p>{MORE}</p></article>"
WHOLE = f"Title\n\n{TEXT}\n\n{MORE}"


def page(body, head="<head><title>T</title></head>"):
    return f"<html>{head}<body>{body}</body></html>"


def test_names_around_an_article_do_not_drop_it():
    for name in ("content-sidebar-wrap", "has-sidebar", "with-nav"):
        assert main_text(page(f'<div class="{name}">{ARTICLE}<div class="sidebar"><p>Other, things.</p></div></div>')) == WHOLE
        assert main_text(page(f'<div class="{name}"><h1>Title</h1><p>{TEXT}</p><p>{MORE}</p></div>')) == WHOLE


def test_parts_of_an_article_stay():
    parts = f'<section id="discussion"><h2 id="related-work">Related work</h2><p class="notice">{TEXT}</p><p>{MORE}</p></section>'
    got = main_text(page(f'<article><p>{TEXT}</p>{parts}<div class="comments"><p>I agree, great post, thanks.</p></div><div class="ad">Buy, now!</div></article>'))
    assert got == f"{TEXT}\n\nRelated work\n\n{TEXT}\n\n{MORE}"


def test_comments_go_however_long():
    assert main_text(page(f'<div><h1>Title</h1><p>{TEXT}</p><p>{MORE}</p></div><div class="comments">{f"<p>{TEXT}</p>" * 20}</div>')) == WHOLE


def test_head_without_end_and_closed_svg():
    assert main_text(page(ARTICLE, "<head><title>T</title>")) == WHOLE
    assert main_text(f"<head><title>T</title><p>{TEXT}") == TEXT
    assert main_text(f"<head><title>T</title>{TEXT}") == TEXT
    assert main_text(page(ARTICLE.replace("<h1>", '<svg class="x" viewBox="0 0 1 1"/><h1>'))) == WHOLE


def test_content_outside_the_largest_part_stays():
    assert main_text(page(f"<div><div><p>{TEXT}</p><p>{MORE}</p><p>{TEXT}</p><p>{MORE}</p></div><div><p>{TEXT}</p></div></div>")).count(TEXT) == 3
