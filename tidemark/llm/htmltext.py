"""Main text of web pages by tag-path ratios.

A page is read as a tree of block elements with blocks of text. Each block belongs to its root-to-leaf path of tags (with
the class or id of grouping elements). Per path the text length, punctuation and link text are aggregated; both ratios
(text per block, punctuation per block) are smoothed over paths in page order, fused by their product and discounted by
the share of link text. A path through an element whose tag speaks of a menu, a form or the like counts for TAG_PRIOR of
that only, one through an element whose class, id or role does for NAME_PRIOR: a name alone cannot overrule the ratios.

The ratios decide. Every element holds the fused ratios of the blocks in it (elements whose tag says that they are beside the
article, and those named as reader comments, hold nothing and are never chosen, however long they are, unless a page has
nothing else), and from the page's root the content node is
found by going down while one child holds at least SHARE of what its parent holds. All blocks of the content node stay,
tables, short lists and reference links too, but those in its elements for menus, adverts, forms and comments. Where no
element holds the content (the node is the page or its body), its elements stay by their own ratio: at least THRESHOLD of
the page's.

Edge cases: null or empty html gives empty text; text outside any tag counts as a block of the root path; unclosed and
stray tags and unbalanced quotes are tolerated; a page of one path keeps all its blocks; very long pages are read whole, in
time and memory proportional to them; rows are independent, so repeated and null ids stay as they are, and an empty table
gives no rows; input columns beyond those named take no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import begin, small_batches

# Fixed values of the HTML language: elements without content, raw-text elements, block elements.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that group others, and whose class and id are read.
GROUPS = {"article", "aside", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul"}
#: Elements for what is not article text; the page's own header is one too.
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "svg", "object", "canvas", "audio", "video", "label"}
# Words that name such parts in class, id or role, and words that only say how a part is laid out.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "notice", "gdpr", "comment", "comments", "disqus", "replies", "sidebar", "widget", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "share", "sharing", "social", "related", "newsletter", "subscribe", "popup", "modal", "pagination",
    "complementary", "contentinfo", "search", "alert",
}
LAYOUT = {
    "area", "bar", "block", "body", "bottom", "box", "buttons", "column", "container", "content", "form", "global", "group", "inner", "item", "items", "left", "links",
    "list", "main", "message", "outer", "overlay", "page", "panel", "posts", "reader", "right", "row", "section", "site", "slot", "thread", "top", "unit", "user", "wrap", "wrapper",
}
# Those of NAMES that name reader comments.
COMMENTS = {"comment", "comments", "disqus", "replies"}
#: Weight of paths through such elements, by tag and by name; share of its parent's ratios by which an element is taken for the content's; and
#: share of the page's mean ratio by which an element stays where none is.
TAG_PRIOR, NAME_PRIOR, SHARE, THRESHOLD = 0.05, 0.25, 0.6, 0.1
#: Weights of a path and of its neighbours in page order.
KERNEL = (0.25, 0.5, 0.25)

_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)").match
_plain = re.compile(r"[^>\"']*").match
_marked = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_punctuation = re.compile(r"[.,;:!?…。，；：！？]").findall
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_ends = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
#: What an opening block tag closes if it is still open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}


def names_aside(token: str) -> bool:
    """Whether a class or id names a part beside the article: one of NAMES, and else only layout words and numbers."""
    parts = [p.lower() for p in _parts(token)]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in LAYOUT for p in parts)


class Page:
    """The tree of a page's block elements. Node 0 is the page; a node's number is above its parent's."""

    def __init__(self) -> None:
        self.parent, self.tag, self.aside, self.barred, self.path = [-1], [""], [False], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters of link text; in page order

    def add(self, parent: int, tag: str, attributes: str) -> int:
        label, aside = tag, tag in ASIDE
        barred = aside
        if attributes and tag in GROUPS:
            tokens = [(m[1].lower(), t) for m in _marked.finditer(attributes) for t in (m[2] or m[3] or m[4] or "").split()]
            named = [t for _, t in tokens if names_aside(t)]
            aside = aside or bool(named)
            barred = barred or any(p.lower() in COMMENTS for t in named for p in _parts(t))
            label += "".join(f".{t}" for kind, t in tokens if kind != "role")
        self.parent.append(parent)
        self.tag.append(tag)
        self.aside.append(aside)
        self.barred.append(barred)
        self.path.append(self.paths.setdefault((self.path[parent], label), len(self.paths) + 1))
        return len(self.parent) - 1


def read_page(page: str) -> Page:
    out = Page()
    stack, opened = [0], Counter()
    parts: list[str] = []
    linked = links = 0
    last = {quote: page.rfind(quote) for quote in "\"'"}

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.blocks.append((stack[-1], text, min(linked, len(text))))
        parts.clear()
        linked = 0

    def close() -> str:
        tag = out.tag[stack.pop()]
        opened[tag] -= 1
        return tag

    def after(position: int, mark: str) -> int:
        """Position behind the next mark, or the end."""
        found = page.find(mark, position)
        return n if found < 0 else found + len(mark)

    position, n = 0, len(page)
    while position < n:
        start = page.find("<", position)
        raw = page[position : n if start < 0 else start]
        if raw:
            parts.append(raw)
            linked += len(raw) if links else 0
        if start < 0:
            break
        match = _tag(page, start)
        if not match:
            if page.startswith("<!--", start):
                position = after(start + 4, "-->")
            elif page.startswith("<![CDATA[", start):
                position = after(start, "]]>")
            elif page.startswith(("<!", "<?", "</"), start):
                position = after(start, ">")
            else:  # a lone sign is text
                parts.append("<")
                position = start + 1
            continue
        # The tag ends at the first > outside quotes; a quote that is never closed is an ordinary character.
        end = begin_of = match.end()
        while (end := _plain(page, end).end()) < n and page[end] != ">":
            quote = page[end]
            end = page.find(quote, end + 1) + 1 if end < last[quote] else end + 1
        attributes, position = page[begin_of:end], min(n, end + 1)
        tag = match[2].lower()
        if match[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK or tag in ASIDE:
                flush()
                if opened[tag] > 0:
                    while close() != tag:
                        pass
                links = 0
            continue
        if tag in RAW:
            found = _ends[tag].search(page, position)
            position = after(found.end(), ">") if found else n
        elif tag == "br" or tag == "hr":
            parts.append(" ")
        elif tag == "a":
            links += 1
        elif (tag in BLOCK or tag in ASIDE) and tag not in VOID:
            flush()
            links = 0
            if out.tag[stack[-1]] == "p" and tag != "p":
                close()
            closes = _CLOSES.get(tag, {"p"} if tag == "p" else ())
            while out.tag[stack[-1]] in closes:
                close()
            stack.append(out.add(stack[-1], tag, attributes))
            opened[tag] += 1
    flush()
    return out


def path_ratios(page: Page) -> dict[int, float]:
    """The fused ratio of every path that has a block."""
    sums: dict[int, list[float]] = {}
    weight, of_path = [1.0] * len(page.parent), {0: 1.0}
    for node in range(1, len(page.parent)):
        own = TAG_PRIOR if page.tag[node] in ASIDE else NAME_PRIOR if page.aside[node] else 1.0
        of_path[page.path[node]] = weight[node] = min(own, weight[page.parent[node]])
    for node, text, linked in page.blocks:
        own = sums.setdefault(page.path[node], [0, 0, 0, 0])
        for i, v in enumerate((1, len(text), len(_punctuation(text)), linked)):
            own[i] += v
    order = list(sums)
    smooth = []
    for k in (1, 2):
        ratio = [sums[p][k] / sums[p][0] for p in order]
        padded = [ratio[0], *ratio, ratio[-1]] if ratio else []
        smooth.append([sum(w * v for w, v in zip(KERNEL, padded[i : i + 3], strict=True)) for i in range(len(order))])
    return {p: smooth[0][i] * (1 + smooth[1][i]) * (1 - sums[p][3] / sums[p][1]) * of_path[p] for i, p in enumerate(order)}


def content_blocks(page: Page, fused: dict[int, float]) -> list[str]:
    """Texts of the blocks that stay, in page order."""
    nodes = len(page.parent)
    beside = page.barred[:]  # in an element that is surely not the article
    for node in range(1, nodes):
        beside[node] = beside[node] or beside[page.parent[node]]
    if all(beside[node] for node, *_ in page.blocks):  # the page has nothing else, as when all of it is one form
        beside = [False] * nodes
    held, count = [0.0] * nodes, [0] * nodes
    for node, *_ in page.blocks:
        held[node] += 0.0 if beside[node] else fused[page.path[node]]
        count[node] += not beside[node]
    for node in range(nodes - 1, 0, -1):  # what an element holds, with all below it
        held[page.parent[node]] += held[node]
        count[page.parent[node]] += count[node]
    best: dict[int, int] = {}  # the child that holds most
    for node in range(1, nodes):
        up = page.parent[node]
        if not beside[node] and (page.tag[node] in GROUPS or page.tag[node] in ("html", "body")):
            best[up] = node if up not in best or held[node] > held[best[up]] else best[up]
    chosen = 0
    while chosen in best and held[best[chosen]] >= SHARE * held[chosen] and count[best[chosen]]:
        if page.tag[best[chosen]] in ("ul", "ol", "dl", "table", "figure"):  # parts of a text, not its place
            break
        chosen = best[chosen]
    whole = page.tag[chosen] in ("", "html", "body")
    least = THRESHOLD * held[chosen] / max(1, count[chosen])
    stays = [False] * nodes
    stays[chosen] = True
    for node in range(chosen + 1, nodes):
        up = page.parent[node]
        stays[node] = stays[up] and not page.aside[node]
        if whole and stays[node] and (up == chosen or page.tag[up] in ("html", "body")):
            low = page.tag[node] in GROUPS and held[node] < least * count[node]
            stays[node] = page.tag[node] != "header" and not low
    return [text for node, text, _ in page.blocks if stays[node]]


def extract(page: str) -> str:
    """Main text: content blocks joined by an empty line."""
    tree = read_page(page)
    return "\n\n".join(content_blocks(tree, path_ratios(tree)))


def extract_pages(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns `keep`, text and n_chars (code points) of every page. Map-only."""
    small_batches(pages.sparkSession)
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("htmltext")
        for batch in batches:
            texts = [extract(v.as_py() or "") for v in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + ", text string, n_chars long"
    return pages.select(*keep, F.col(html_column).cast("string").alias("html")).mapInArrow(run, schema)
