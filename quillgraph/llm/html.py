"""Main text of web pages by tag-path ratios.

A page is cut into text blocks, each at the end of a root-to-leaf path of block tags; a step of a path is its
tag with the word, if any, that its class, id or role names it by (``div.comments``). Per path the length of
text and the punctuation are added up and divided by the path's nodes, and fused to one score. Tags and names
that stand for menus, footers, adverts, forms, reader comments and the like lower the scores of all paths
through them; what is lowered is still compared with the page's best path, so a page that has all of its text
under such a name keeps it.

Scores are then smoothed: a block takes at least the mean score of the blocks that share its section (the
nearest sectioning element around it), half of the mean of the article's section if it lies in it, and a heading
half of what follows it. The article's section is the innermost one with ``HOLDS`` of the text on paths above the
threshold. Blocks whose smoothed score reaches ``LEAST_SHARE`` of the best path's are the text, in page order.

Every page is handled on its own in one pass, linear in its size however deep its markup, so there is no shuffle
and no group that could be hot.

Odd input: a null or blank page has an empty text; broken or unclosed markup is read on as browsers do,
roughly; a page whose blocks all score alike keeps them; repeated rows repeat; a null page_id stays null; extra
columns are ignored. Text of ``canvas``, ``svg`` and ``iframe`` is no text; that of ``math`` and ``object`` is.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html head body article main section div header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption form fieldset legend details summary dialog address hgroup menu search center hr option select button".split()
)
# Elements that make a section of what they hold.
SECTIONS = frozenset("html head body article main section div header footer nav aside td th form fieldset details dialog menu search center".split())
# Elements that have no end tag.
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
# An open element that a new one of these closes, and what stops the search for it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BARRIERS = ("ul", "ol", "dl", "table", "select")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold something other than the article.
OTHER_TAGS = frozenset("head nav footer aside form fieldset select button option menu dialog search legend".split())
# Words that name something other than the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion promotions cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login paywall sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc toolbar"
    " comment comments commentlist discussion disqus respond reply replies share sharing social related recommended recommendations trending popular"
    " footer masthead copyright legal widget widgets skip contentinfo complementary search form hidden".split()
)
# Those of them that parts of an article have too; within an article or main element they lower nothing.
SHARED = frozenset("alert discussion form legal notice notices popular related recommended recommendations reply replies respond search share sharing social toc trending".split())
# Last words of a name that say where or how, not what.
PLACES = frozenset("area bar block box container content group holder inner item items link links list outer panel row section text wrap wrapper".split())
# Words that make a name say that something is there or not, or on or off.
STATES = frozenset("closed disabled enabled has is no non not off on open with without".split())

#: Factors by which a tag, a name and a hidden element lower the paths through them.
BY_TAG, BY_NAME, BY_HIDDEN = 0.02, 0.05, 0.001
#: Share of the best path's score from which a block is text; share of the content that the article's section holds.
LEAST_SHARE, HOLDS = 0.3, 0.7
#: Share of its surroundings' score that a block takes when smoothed.
SMOOTH = 0.5

# Elements whose content is no markup, up to their end tag.
RAW = frozenset("script style noscript template textarea iframe svg canvas title xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?])")
QUOTED_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
PLAIN_REST = re.compile(r"[^>]*>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
PART = re.compile(r"[a-z]+")
# A slash closes a foreign element at once; the slash that ends an unquoted value does not.
VALUE = re.compile(r"=\s*[^\s\"'=>]+$")
PUNCTUATION = re.compile(r"[.,;:!?…。，、؟]")


def named(attrs: str) -> str:
    """The word by which class, id or role name an element as something other than an article, or "".

    A name is its last word, but for words of place: ``comment-list`` is ``comment``, ``content-sidebar`` is
    ``sidebar``; one that speaks of a state names nothing: ``has-sidebar``, ``comments-closed``."""
    for m in NAMED.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = PART.findall(HUMP.sub("-", name).lower())
            if STATES.intersection(parts):
                continue
            while len(parts) > 1 and parts[-1] in PLACES:
                parts.pop()
            if parts and parts[-1] in NAMES:
                return parts[-1]
    return ""


def _tokens(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" or "", tag, attributes) of each tag, and the text that is left with an empty tag.

    Quotes in attributes are honoured until a quote is found that never closes; from there on they are
    not, so that no page makes the reading quadratic."""
    last, at, text_from, rest_of_tag = page.rfind(">"), 0, 0, QUOTED_REST
    while m := OPEN.search(page, at):
        if m.start() > last:
            break
        if m[1]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        else:
            rest = rest_of_tag.match(page, m.end())
            if not rest:
                rest_of_tag = PLAIN_REST
                rest = rest_of_tag.match(page, m.end())
            end = rest.end()
        tag, before = (m[3] or "").lower(), page[text_from : m.start()]
        attrs = page[m.end() : end - 1] if tag else ""
        if tag in RAW and not m[2] and not (tag == "svg" and attrs.endswith("/") and not VALUE.search(attrs)):
            close = RAW_END[tag].search(page, end)
            end = close.end() if close else len(page)
        yield before, m[2] or "", tag, attrs
        at = text_from = end
    yield page[text_from:], "", "", ""


class Page:
    """Nodes, paths and blocks of a page; the node of a block points to its parent, its path and its section."""

    def __init__(self, page: str):
        self.parent, self.path, self.section, self.is_section = [-1], [0], [0], [True]
        self.paths: dict[tuple, int] = {("",): 0}
        self.factor = [1.0]  # by path
        self.blocks: list[tuple[int, str, int, str]] = []  # node, text, characters in links, tag
        open_nodes, tags, at = [0], [""], defaultdict(list)  # ``at``: where in the stack each tag stands
        text: list[str] = []
        linked: list[int] = [0]
        in_link = False

        def close(tag: str, barriers: tuple[str, ...] = ()) -> None:
            """Close the innermost open ``tag`` and all within, unless a barrier stands inside it."""
            if at[tag] and not any(at[b] and at[b][-1] > at[tag][-1] for b in barriers):
                keep = at[tag][-1]
                while len(tags) > keep:
                    at[tags.pop()].pop()
                    open_nodes.pop()

        def flush() -> None:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                if tags[-1] == "head":  # text in a head begins the body
                    close("head")
                self.blocks.append((open_nodes[-1], words, min(linked[0], len(words)), tags[-1]))
            linked[0] = 0

        for before, end, tag, attrs in _tokens(page):
            text.append(before)
            if in_link:
                linked[0] += len(before.strip())
            if tag == "br":
                text.append("\n")
            if tag == "a":
                in_link = not end
            if tag not in BLOCKS:
                continue
            flush()
            if end:
                close(tag)
                continue
            if tag not in ("html", "head"):
                close("head")  # its end tag may be left out
            close("p")  # any block ends a paragraph
            for other in CLOSES.get(tag, ()):
                close(other, BARRIERS)
            if tag in VOID:
                continue
            up = open_nodes[-1]
            node = len(self.parent)
            self.parent.append(up)
            self.path.append(self._step(self.path[up], tag, attrs, bool(at["article"] or at["main"])))
            self.is_section.append(tag in SECTIONS)
            self.section.append(node if tag in SECTIONS else self.section[up])
            at[tag].append(len(tags))
            tags.append(tag), open_nodes.append(node)
        flush()

    def _step(self, up: int, tag: str, attrs: str, inside: bool) -> int:
        """The path one tag further down."""
        name = hidden = ""
        if attrs and tag not in ("html", "body"):
            hidden = "hidden" if HIDDEN.search(attrs) else ""
            if tag not in HEADINGS and tag not in ("article", "main"):
                name = named(attrs)
                if inside and name in SHARED:
                    name = ""
        other = tag in OTHER_TAGS or (tag == "header" and not inside)
        key = (up, tag, name, hidden, other)
        found = self.paths.get(key)
        if found is None:
            found = self.paths[key] = len(self.factor)
            self.factor.append(self.factor[up] * min(BY_TAG if other else 1.0, BY_NAME if name else 1.0, BY_HIDDEN if hidden else 1.0))
        return found


def path_scores(page: Page) -> dict[int, float]:
    """Score of each path with text, before lowering: length and punctuation by node, fused."""
    length, marks, nodes, last = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for node, text, _, _ in page.blocks:
        p = page.path[node]
        length[p] += len(text)
        marks[p] += len(PUNCTUATION.findall(text))
        nodes[p] += last.get(p) != node
        last[p] = node
    return {p: ((n / nodes[p]) * (1 + marks[p] / nodes[p])) ** 0.5 * (1 + n) ** 0.25 for p, n in length.items()}


def article_section(page: Page, on: list[bool]) -> int:
    """Innermost section with ``HOLDS`` of the text of the blocks that are ``on``."""
    held = [0] * len(page.parent)
    for (node, text, _, _), yes in zip(page.blocks, on, strict=True):
        held[node] += len(text) * yes
    for node in range(len(held) - 1, 0, -1):  # children have larger numbers than their parents
        held[page.parent[node]] += held[node]
    enough = HOLDS * held[0]
    # Nodes with over half of the text lie on one way down, so the last of them is the innermost.
    return max((n for n, h in enumerate(held) if h >= enough and page.is_section[n]), default=0)


def smoothed_scores(page: Page) -> list[float]:
    """Score of each block as a share of the best path's."""
    raw = path_scores(page)
    best = max(page.factor[p] * s for p, s in raw.items())
    factor = [page.factor[page.path[b[0]]] for b in page.blocks]
    own = [raw[page.path[b[0]]] / best for b in page.blocks]
    root = article_section(page, [f * s >= LEAST_SHARE for f, s in zip(factor, own, strict=True)])
    inside = [False] * len(page.parent)
    inside[root] = True
    for node in range(root + 1, len(inside)):
        inside[node] = inside[page.parent[node]]
    # Mean score by section of the blocks that are lowered as much as it, and how much of the section is links.
    total, weight, links = defaultdict(float), defaultdict(int), defaultdict(int)
    for (node, text, linked, _), f, s in zip(page.blocks, factor, own, strict=True):
        at = page.section[node]
        if f >= page.factor[page.path[at]]:
            total[at] += len(text) * s
            weight[at] += len(text)
            links[at] += linked
    mean = {at: total[at] / weight[at] for at in weight}
    whole = sum((len(b[1]) * f * s for b, f, s in zip(page.blocks, factor, own, strict=True) if inside[b[0]]), 0.0) / max(1, sum(len(b[1]) for b in page.blocks if inside[b[0]]))
    out: list[float] = []
    following = 0.0
    for (node, _, _, tag), f, s in zip(reversed(page.blocks), reversed(factor), reversed(own), strict=True):
        at = page.section[node]
        s = max(s, mean.get(at, 0.0)) * f
        # Half of the article's score, lowered by what lies between; a part of links alone takes nothing from around it.
        if inside[node] and (at == root or 2 * links[at] < weight[at]):
            s = max(s, SMOOTH * max(whole, LEAST_SHARE / SMOOTH) * f / page.factor[page.path[root]])
        if tag in HEADINGS and f >= page.factor[page.path[root]]:
            s = max(s, SMOOTH * following if following < LEAST_SHARE else LEAST_SHARE)
        elif tag not in HEADINGS:
            following = s
        out.append(s)
    return out[::-1]


def main_text(html: str) -> str:
    page = Page(html)
    if not page.blocks:
        return ""
    return "\n\n".join(b[1] for b, s in zip(page.blocks, smoothed_scores(page), strict=True) if s >= LEAST_SHARE)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page or "") for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
