"""Main text of job pages by composite text density.

Every node of a page's tree gets its number of characters, characters inside links, tags
and tags that are links. Its density is characters per tag, lowered where much of the
text is link text; the sum over its children says how much dense text it holds together.
The threshold is the smallest density on the path from the body to the node with the
largest density sum; the subtree around that node, climbed to while what is added reaches
it, is the article. ``article`` and ``main`` elements bound this climb, see ``select``.
What is never article text (menus, headers, footers, sidebars, forms, scripts and the like,
by tag, role or class) is taken out of the tree before anything is counted.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from rankspark.llm.common import pick

# HTML elements by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "head script style noscript template title nav header footer aside form button select option datalist"
    " textarea iframe object svg math canvas audio video map menu dialog".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search"
    " section summary table tbody td tfoot th thead tr ul".split()
)
# an opening tag (left) ends an open element of these kinds
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
# what leaves an open head open
IN_HEAD = frozenset("head title base link meta style script noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
# words of class and id names that mark what is not article text
NOT_ARTICLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored sponsor promo promotion"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar side-bar aside footer header masthead"
    " cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup login"
    " comment comments reply replies disqus respond share sharing social related recommended widget".split()
)
# what such a word stands before in the names of boxes: "share-buttons", but not "share-price"
BOX_WORDS = frozenset(
    "area bar bars bottom box block blocks body button buttons card cards container content form frame group grid holder icon icons"
    " inner item items label left link links list lists main nav outer panel popup post posts region right row section slot"
    " strip text thread title toggle top unit widget widgets wrap wrapper zone"
    " ad ads banner footer header menu message notice overlay sidebar".split()
)
LAYOUT_WORDS = frozenset("fixed sticky static open closed visible hidden primary secondary small large wide narrow inline mobile desktop".split())
_NAME_PARTS = re.compile(r"[^a-z0-9-]+")
_SPACE = re.compile(r"\s+")


def marked_out(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """Whether an element is no part of the article: ``never``, ``maybe`` (unless it is around most of the page) or empty.

    ``maybe`` are forms, which some layouts put around the whole page, and names that only begin with a listed word, of
    which some name layouts ("sidebar-right", "header-fixed").
    """
    if tag == "form":
        return "maybe"
    if tag in NO_TEXT:
        return "never"
    if tag in ("html", "body", "article", "main"):
        return ""
    found = ""
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "never"
        if name == "role" and value in NOT_ARTICLE_ROLES:
            return "never"
        if name in ("class", "id") and value:
            for whole in _NAME_PARTS.split(value):
                if whole in NOT_ARTICLE_WORDS:
                    return "never"
                first, *more = whole.split("-")
                if more and first in NOT_ARTICLE_WORDS and (more[-1] in BOX_WORDS | NOT_ARTICLE_WORDS | LAYOUT_WORDS or not more[-1].isalpha()):
                    found = "maybe"
    return found


class Node:
    """An element with its children, which are elements and pieces of text."""

    __slots__ = ("tag", "out", "maybe", "children", "chars", "link_chars", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, mark: str = "") -> None:
        self.tag, self.out, self.maybe = tag, mark == "never", mark == "maybe"
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


class Tree(HTMLParser):
    """Builds the tree of what can be article text; tolerates missing and wrong end tags.

    A marked-out element is opened and ended like any other, by implied ends too, but is no
    child of the element around it, so the finished tree lacks it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.open_tags: Counter[str] = Counter()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or tag not in IN_HEAD:
            self._end_head(tag == "body")
        if tag in ("html", "body"):
            if tag == "body" and len(self.open) == 1:
                self._push(Node(tag))
            return
        if tag in BLOCK:
            # a block ends an open paragraph, and a heading an open heading, of the same container
            self._close_open({"p"} | (HEADINGS if tag in HEADINGS else set()), stop=BLOCK - {"p"} - HEADINGS)
        if tag in ENDS:
            self._close_open(ENDS[tag], stop={"ul", "ol", "dl", "table", "select"})
        node = Node(tag, marked_out(tag, attrs))
        if tag not in VOID:
            self._push(node)
        elif not node.out:
            self.open[-1].children.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # "/" closes nothing in HTML, except for void elements
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._close_from(at)
                return
            if self.open[at].out and tag not in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._end_head(False)
        if data:
            self.open[-1].children.append(data)

    def _push(self, node: Node) -> None:
        if not node.out:
            self.open[-1].children.append(node)
        self.open.append(node)
        self.open_tags[node.tag] += 1

    def _close_from(self, at: int) -> None:
        for node in self.open[at:]:
            self.open_tags[node.tag] -= 1
        del self.open[at:]

    def _end_head(self, all_in_it: bool) -> None:
        if len(self.open) > 1 and self.open[1].tag == "head" and (all_in_it or len(self.open) == 2):
            self._close_from(1)

    def _close_open(self, kinds: set[str], stop: frozenset[str] | set[str]) -> None:
        last, left = None, sum(self.open_tags[k] for k in kinds)
        for at in range(len(self.open) - 1, 0, -1):
            if not left:
                break
            if self.open[at].tag in kinds:
                last, left = at, left - 1
            elif self.open[at].tag in stop:
                break
        if last is not None:
            self._close_from(last)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    _prune(tree.root)
    return tree.root


def _prune(root: Node) -> None:
    """Take out the elements that may be no part of the article, unless they hold most of what is left of the page's text."""
    nodes = _in_order(root)
    if not any(n.maybe for n in nodes):
        return
    chars: dict[int, int] = {}
    for node in reversed(nodes):
        chars[id(node)] = sum(chars[id(c)] if isinstance(c, Node) else len(_SPACE.sub("", c)) for c in node.children)
    half = chars[id(root)] / 2
    for node in nodes:
        node.children = [c for c in node.children if not (isinstance(c, Node) and c.maybe and chars[id(c)] <= half)]


def _in_order(root: Node) -> list[Node]:
    """All elements, parents before children, without recursion (pages may be nested very deeply)."""
    found = [root]
    for node in found:
        found.extend(c for c in node.children if isinstance(c, Node))
    return found


def measure(root: Node) -> list[Node]:
    """Fill counts, densities and density sums of all nodes."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.link_tags += c.link_tags + (c.tag == "a")
            else:
                node.chars += len(_SPACE.sub("", c))
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = root.link_chars / max(1, root.chars)
    for node in nodes:
        n, links, tags, link_tags = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if n:
            plain = max(1, n - links)
            base = math.log(n / plain * links + ratio * n + math.e)
            node.density = n / tags * max(0.0, math.log(max(1.0, n * tags / (max(1, links) * link_tags))) / math.log(max(base, 1.0 + 1e-9) + 1.0))
    for node in nodes:
        node.total = math.fsum(c.density for c in node.children if isinstance(c, Node))
    return nodes


def select(root: Node) -> Node:
    """The subtree of the article.

    The node with the largest density sum is where the article's blocks hang. Blocks of the
    article that hang elsewhere are reached by climbing: a node joins its parent while what
    the parent adds is for the most part as dense as the threshold. An ``article`` or ``main``
    element is not selected for its tag. It only ends a climb that has come to it, unless
    an ``article`` as dense as the threshold stands outside of it; and up to the outermost one
    short blocks (headings, closing lines) join as well, so what is added need only be text
    that is for the most part no links.
    """
    nodes = measure(root)
    parent = {id(c): n for n in nodes for c in n.children if isinstance(c, Node)}
    best = max(nodes, key=lambda n: (n.total, n.chars))
    path = [best]
    while id(path[-1]) in parent:
        path.append(parent[id(path[-1])])
    threshold = min(n.density for n in path)
    held: dict[int, int] = {}  # dense articles in a subtree
    for n in reversed(nodes):
        own = n.tag == "article" and n.chars > 0 and n.density >= threshold
        held[id(n)] = own + sum(held[id(c)] for c in n.children if isinstance(c, Node))
    around = sum(n.tag == "article" for n in path)  # articles on the path are as dense as the threshold
    outermost = max((at for at, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    for at, (below, above) in enumerate(zip(path, path[1:])):
        if below.tag in ("article", "main"):
            around -= below.tag == "article"
            if held[id(below)] + around == held[id(root)]:
                return below
        others = [c for c in above.children if isinstance(c, Node) and c is not below]
        added = above.chars - below.chars
        if at < outermost:
            joins = added - (above.link_chars - below.link_chars)
        else:
            joins = sum(c.chars for c in others if c.density >= threshold)
        if 2 * joins < added:
            return below
    return path[-1]


def blocks(node: Node) -> list[str]:
    """Text of a subtree, one entry per block, white space folded."""
    found: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            found.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append(" ")
        else:
            if x.tag in BLOCK:
                end()
                todo.append(None)
            todo.extend(reversed(x.children))
    end()
    return found


def main_text(html: str | None) -> str:
    """Article text of one page; empty for null, for an empty page and for one without article text."""
    if not html:
        return ""
    return "\n".join(blocks(select(parse(html))))


def extract_job_texts(jobs: DataFrame, job_id: str = "job_id", html: str = "html") -> DataFrame:
    """``job_id, jd_text, n_chars`` for job pages: the text of the job without the page around it.

    The records of the library hold job texts as plain text only, so ``jobs`` may be any
    table of pages with an id and their markup. ``jd_text`` is never null: null, empty and
    text-free pages give "". Every row gives one row, repeated and null ids included; the
    text is whole, however long; an empty table gives an empty result, and other columns
    are not read. ``n_chars`` counts code points.
    """
    pages = pick(jobs, job_id=job_id, html=html)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("job_id"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["job_id", "jd_text", "n_chars"],
            )

    kind = pages.schema["job_id"].dataType.simpleString()
    return pages.mapInArrow(run, f"job_id {kind}, jd_text string, n_chars bigint")
