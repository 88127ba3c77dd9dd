"""Main text of web pages by composite text density.

Each block element of a page gets the characters per tag of its subtree, lowered by the share of
characters that lie in links. The element whose children's densities sum highest is the core of the
content. All blocks of the page's article, main element or else body are kept, with the text directly in
them; outside the core, blocks made of links go when they are sparser than the sparsest element on the
core's way up. Menus, headers, footers, forms, adverts and the like are left out: known by element, or
by role, class or id where these agree with the links and the share of the text they mark.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import small_batches

# Element names of HTML and words used for parts of a page.
BLOCKS = frozenset(
    "html body head article aside nav header footer main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption form fieldset legend address center details summary dialog hr hgroup menu search noscript template object iframe svg "
    "select option optgroup button canvas audio video map datalist".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE = frozenset(
    "head nav footer aside button select option datalist menu dialog noscript template object iframe svg canvas audio video map search".split()
)
# Pages are wrapped in one form by some servers, so these are judged by their text, as elements with noise words are.
FORMS = frozenset(["form", "fieldset"])
CONTROLS = frozenset(["input", "select", "textarea", "button"])
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notices newsletter subscribe signup comment comments disqus respond replies related recommended share sharing social footer header "
    "masthead popup modal overlay widget widgets toolbar pagination pager contentinfo complementary search dialog alert alertdialog skip".split()
)
# Words that content bears too: inside an article or main element they need links as a second sign.
LOOSE_WORDS = frozenset("share sharing social notice notices promo promotion banner header masthead widget widgets alert skip overlay related recommended search consent".split())
HEAD_WORDS = frozenset("header masthead banner".split())
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
# A compound with one of these says how a page is laid out, not what the element is.
STATE_FIRST, STATE_LAST = frozenset("has with without no not".split()), frozenset("open opened closed enabled disabled on off".split())
SHARE, LOOSE_SHARE = 0.5, 0.1  # of a page's plain characters: what a word marks in all must be less
ENDS_BEFORE = {
    **{tag: frozenset(["p"]) for tag in BLOCKS - {"html", "body", "head", "option", "optgroup", "button", "iframe", "svg", "canvas", "audio", "video", "map", "object"}},
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head", "p"]),
}
KEEPS_OPEN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "p": ("td", "th", "button", "object", "template")}
_TAG = re.compile(r"""<(?:!--(?P<comment>)|[!?][^>]*>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(?P<loose>/?[a-zA-Z][^>]*>))""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden|href)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element: its place in the tree, its counts, whether it is noise of a page, and the noise words
    that it bears, with whether the word stands alone."""

    __slots__ = ("chars", "controls", "density", "inside", "link_chars", "link_tags", "noise", "own_links", "parent", "sum", "tag", "tags", "words")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.noise = self.inside = self.own_links = False
        self.words: dict[str, bool] = {}
        self.controls = 0


def _marks(rest: str) -> tuple[dict[str, bool], bool]:
    """Noise words of the attributes, with whether they stand alone, and whether attributes hide the element."""
    words: dict[str, bool] = {}
    hidden = False
    for name, value in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                parts = _WORD.findall(token)
                if len(parts) > 1 and (parts[0] in STATE_FIRST or parts[-1] in STATE_LAST):
                    continue
                for word in NOISE_WORDS.intersection(parts):
                    words[word] = words.get(word, False) or len(parts) == 1
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
    return words, hidden


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Nodes in page order, the root first, and the runs of text with their block; open tags are closed
    as browsers do for paragraphs, list items and table cells. Time and memory are linear in the page."""
    root = Node("html", None)
    nodes, runs, stack = [root], [], [root]
    opened: dict[str, int] = {"html": 1}
    link_depth, at, end_of_page = 0, 0, len(page)

    def text(value: str) -> None:
        if not value:
            return
        value = html.unescape(value) if "&" in value else value
        node = stack[-1]
        runs.append((node, value))
        size = len(_SPACE.sub(" ", value).strip())
        node.chars += size
        if link_depth:
            node.link_chars += size

    def close_to(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1
        if link_depth > len(stack):
            link_depth = 0

    def close(names: frozenset[str], bounds: tuple[str, ...]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                close_to(depth)
                return close(names, bounds)
            if stack[depth].tag in bounds:
                return None

    while at < end_of_page:
        found = _TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        if found["comment"] is not None:
            stop = page.find("-->", found.start() + 4)
            at = end_of_page if stop < 0 else stop + 3
            continue
        name, rest, ends = found["name"], found["rest"] or "", found["end"]
        if name is None:
            if not found["loose"]:
                continue
            loose = found["loose"].rstrip(">")
            ends, name = ("/", loose[1:]) if loose[0] == "/" else ("", loose)
            name, _, rest = name.partition(" ")
        name = name.lower().rstrip("/")
        if ends:
            if name == "a":
                link_depth = 0
            elif name in BLOCKS and name not in ("html", "body") and opened.get(name):
                depth = len(stack) - 1
                while stack[depth].tag != name:
                    depth -= 1
                close_to(max(depth, 1))
            continue
        if name in CONTROLS:
            stack[-1].controls += 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = end_of_page if not stop else page.find(">", stop.end()) + 1 or end_of_page
            continue
        if name not in BLOCKS:
            stack[-1].tags += 1
            if name == "a":
                link_depth = len(stack)
                stack[-1].link_tags += 1
            elif name in ("br", "img", "wbr"):
                runs.append((stack[-1], " "))
            continue
        if name == "html":
            continue
        if name in ENDS_BEFORE:
            close(ENDS_BEFORE[name], KEEPS_OPEN.get(name, KEEPS_OPEN["p"]))
        node = Node(name, stack[-1])
        words, hidden = _marks(rest) if rest.strip() else ({}, False)
        node.noise = name in NOISE or hidden or (name == "header" and not (opened.get("article") or opened.get("main")))
        if words and not node.noise and name not in ("body", "main"):
            node.words = words
        if name in FORMS and not node.noise:
            node.words = {**node.words, name: True}
        nodes.append(node)
        if name in EMPTY:
            continue
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1
    return nodes, runs


def _measure(nodes: list[Node]) -> Node:
    """Fill in counts, noise and densities; gives the body, or the page's only main element or article."""
    none: frozenset[tuple[str, bool]] = frozenset()
    above, within, core, titled, plain = {id(nodes[0]): none}, set(), set(), set(), 0
    for node in nodes:  # page order, own counts
        node.own_links = _of_links(node)
        up = node.parent
        if up is not None:
            node.noise = node.noise or up.noise
            above[id(node)] = above[id(up)].union(up.words.items()) if up.words else above[id(up)]
            if id(up) in within or up.tag in ("article", "main"):
                within.add(id(node))
        if not node.noise:
            plain += node.chars - node.link_chars
        # Comments are articles too, in another article or in a list of comments.
        comment = not COMMENT_WORDS.isdisjoint(node.words) and (id(node) in within or any(w in COMMENT_WORDS for w, _ in above[id(node)]))
        if node.tag == "main" or (node.tag == "article" and not comment):
            core.add(id(node))
    for node in reversed(nodes[1:]):
        up = node.parent
        up.chars += node.chars
        up.tags += node.tags + 1
        up.link_chars += node.link_chars
        up.link_tags += node.link_tags
        up.controls += node.controls
        if id(node) in core:
            core.add(id(up))
        if id(node) in titled or (node.tag == "h1" and node.chars and not _mostly_links(node)):
            titled.add(id(up))
    ratio = nodes[0].link_chars / nodes[0].chars if nodes[0].chars else 0.0
    for node in nodes:
        node.density = _density(node, ratio)
        if node.parent is not None and not node.noise:
            node.parent.sum += node.density
    _drop_marked(nodes, above, within, core, titled, plain)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    for tag in ("main", "article"):
        inside: set[int] = set()  # of an element of this name; page order, parents come first
        outer = []
        for node in nodes:
            if node.tag == tag and not node.noise and node.chars and id(node.parent) not in inside:
                outer.append(node)
            if id(node.parent) in inside or (node.tag == tag and not node.noise and node.chars):
                inside.add(id(node))
        if len(outer) == 1:
            body = outer[0]
            break
    return body


def _drop_marked(nodes: list[Node], above: dict[int, frozenset[tuple[str, bool]]], within: set[int], core: set[int], titled: set[int], plain: int) -> None:
    """Make noise of elements whose words name a noisy part, if they consist of links or if all that a word
    marks is a small share of the page's plain characters; never an article, or the element whose
    children's densities sum highest, or one around these."""
    best: Node | None = max((n for n in nodes if not n.noise), key=lambda n: n.sum, default=None)
    safe = set(core)
    while best is not None:
        safe.add(id(best))
        best = best.parent
    held: dict[tuple[str, bool], int] = {}  # compounds count apart
    for node in nodes:
        if node.words and not node.noise and id(node) not in core:
            if id(node) in titled:
                node.words = {w: alone for w, alone in node.words.items() if w not in HEAD_WORDS}
            for word in node.words.items():
                if word not in above[id(node)]:
                    held[word] = held.get(word, 0) + node.chars - node.link_chars

    def dropped(node: Node) -> bool:
        if 2 * node.link_chars > node.chars:
            return True
        for word, alone in node.words.items():
            loose = word in LOOSE_WORDS
            if (loose and id(node) in within) or (word == "fieldset" and not node.controls):
                continue
            share = SHARE if word in COMMENT_WORDS or (alone and not loose) else LOOSE_SHARE
            if held[word, alone] < share * plain:
                return True
        return False

    for node in nodes[1:]:
        if node.parent.noise:
            node.noise = True
        elif node.words and not node.noise and id(node) not in safe and dropped(node):
            node.noise = True
            node.parent.sum -= node.density


def _of_links(node: Node) -> bool:
    """Whether a block is a list of links: three at least, with over two thirds of its characters."""
    return node.link_tags >= 3 and _mostly_links(node)


def _mostly_links(node: Node) -> bool:
    return 3 * node.link_chars > 2 * node.chars


def _density(node: Node, ratio: float) -> float:
    """Characters per tag, adjusted by the characters and tags of links; `ratio` is that of the page."""
    if not node.chars:
        return 0.0
    tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
    density = node.chars / tags
    base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
    share = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
    return density * math.log(max(share, 1.0) + 1.0) / math.log(base + 1.0)


def main_text(page: str | None) -> str:
    """Main text of a page: blocks joined by line feeds, white space inside a block made one space.

    Null, empty and textless pages give an empty text.
    """
    if not page:
        return ""
    nodes, runs = parse(page)
    body = _measure(nodes)
    body.inside = True
    for node in nodes:  # page order: parents come first
        node.inside = node is body or (node.parent is not None and node.parent.inside)
    eligible = [n for n in nodes if n.inside and not n.noise]
    best = max(eligible, key=lambda n: n.sum, default=body)
    threshold, node, way = math.inf, best, set()
    while node is not None:
        way.add(id(node))
        threshold = min(threshold, node.density)
        if node is body:
            break
        node = node.parent
    content: set[int] = set()
    core, lists = {id(best)}, set()
    for node in eligible:  # page order: parents come first
        up = id(node.parent)
        if up in core:
            core.add(id(node))
        if id(node) in core:
            kept = True
        elif id(node) in way:
            kept = not node.own_links  # this is about the text directly in it
        elif up in lists:
            kept = not _mostly_links(node)
        else:
            kept = node.density >= threshold or not _of_links(node)
        if kept:
            content.add(id(node))
        elif id(node) not in way:
            lists.add(id(node))
    blocks, last, part = [], None, []
    for node, value in [*runs, (None, "")]:
        if node is not last:
            blocks.append("".join(part))
            last, part = node, []
        if node is not None and id(node) in content:
            part.append(value)
    joined = (_SPACE.sub(" ", b).strip() for b in blocks)
    return "\n".join(b for b in joined if b)


def extract(column: str | Column) -> Column:
    """Main text of a column of pages."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(v if isinstance(v, str) else None) for v in batch], dtype="object")

    return run(F.col(column) if isinstance(column, str) else column)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html); one row per input row, other columns
    are ignored, null pages give an empty text."""
    small_batches(pages.sparkSession)
    texts = pages.select("page_id", "url", extract("html").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op10_html_density")
def op10_html_density(spark: SparkSession, folder: str) -> DataFrame:
    return extract_pages(table(spark, folder, "pages"))
