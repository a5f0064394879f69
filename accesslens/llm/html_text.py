"""Main text of web pages by composite text density.

A page is parsed into nodes.  Each node has a density, its characters per tag,
lowered where much of it is link text; the sum of its children's densities
marks the node whose children hold the text.  The node with the largest sum is
the article, among those that reach the least density on the path from the
densest node to the body.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, read_table

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption dd dt td th tr tbody thead tfoot legend optgroup option".split())
#: An element of the first kind ends open ones of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("article aside blockquote body button caption div footer form header html li main nav object section table td th".split())
#: Elements whose content is never read as text.
HARD = frozenset("audio button canvas datalist head iframe input map math noscript option script select style svg template textarea title video".split())
#: Page furniture by element, role and class or id: not article text, unless it holds the page.
FURNITURE = frozenset("aside dialog form label menu object".split())
EDGES = frozenset("nav footer".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe toolbar".split()
)
#: Reader comments: not article text, however long.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
#: Parts of a class token that tell of something else than the element itself.
NEUTRAL = frozenset("has no not with without is container wrapper wrap layout content page main body inner".split())
HEADERS = frozenset("header site-header site_header top-header main-header global-header".split())
PLAIN, LENIENT, STRICT, NEVER = range(4)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "parent", "parts", "mark", "off", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, mark: int):
        self.name, self.parent, self.mark, self.off = name, parent, mark, mark == NEVER
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def marked(token: str, marks: frozenset[str]) -> bool:
    """Whether a class token names one of ``marks``: as a whole, or as a part beside no neutral one."""
    if token in marks:
        return True
    parts = WORD.findall(token)
    return len(parts) > 1 and not marks.isdisjoint(parts) and NEUTRAL.isdisjoint(parts)


def mark_of(name: str, attributes: str, inside: bool) -> int:
    """How sure it is that an element is no article text.  ``inside``: within an article or main part, where headers are its own."""
    if name in HARD:
        return NEVER
    mark = STRICT if name in EDGES else LENIENT if name in FURNITURE or (name == "header" and not inside) else PLAIN
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value) or key == "role" and value in ROLES:
            mark = max(mark, LENIENT)
        elif key in ("class", "id") and name not in ("body", "html", "article", "main"):
            tokens = value.split()
            if any(marked(t, COMMENTS) for t in tokens):
                mark = STRICT
            elif any(marked(t, MARKS) or not inside and t in HEADERS for t in tokens):
                mark = max(mark, LENIENT)
    return mark


def parse(page: str) -> Node:
    """The tree of a page; elements that are left open end where a browser would end them."""
    root = Node("html", None, PLAIN)
    stack, at, inside = [root], 0, 0
    open_ = root
    end = len(page)
    while at < end:
        m = TAG.search(page, at)
        if m is None:
            open_.parts.append(page[at:])
            break
        if m.start() > at:
            open_.parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br" or name == "p" and all(x.name != "p" for x in stack):
                open_.parts.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    inside -= sum(x.name in ("article", "main") for x in stack[i:])
                    del stack[i:]
                    open_ = stack[-1]
                    break
                if stack[i].name in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                    break
            continue
        if name in ("html", "body"):
            if name == "body" and all(x.name != "body" for x in stack):
                inside -= sum(x.name in ("article", "main") for x in stack[1:])
                del stack[1:]
                open_ = Node("body", root, PLAIN)
                root.parts.append(open_)
                stack.append(open_)
            continue
        if name == "br":
            open_.parts.append(" ")
            open_.tags += 1
            continue
        cut = None
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    cut = i
                    break
                if stack[i].name in SCOPE:
                    break
        if name in ENDS:
            ended, bound = ENDS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ended:
                    cut = i
                elif stack[i].name in bound:
                    break
        if cut is not None:
            inside -= sum(x.name in ("article", "main") for x in stack[cut:])
            del stack[cut:]
            open_ = stack[-1]
        node = Node(name, open_, mark_of(name, m[3] or m[6] or "", inside > 0))
        open_.parts.append(node)
        if name in RAW and not (m[3] or m[6] or "").endswith("/"):
            close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(node)
            open_ = node
            inside += name in ("article", "main")
    return root


def switch_off(root: Node) -> None:
    """Switch off the marked nodes that are page furniture, which most of them are.

    Where all unmarked text of a page is little beside one leniently marked
    node, as with a form around the whole page, that node is no furniture; what
    is marked inside it is judged again.  Articles and main parts with text of
    their own settle the matter.  Navigation, footers and comments come in only
    where there is no other text.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.off)

    plain, whole, inner = {}, {}, {}  # text outside of marked nodes, all but strictly marked text, and the topmost marked nodes
    for node in reversed(order):
        below = [x for x in node.parts if isinstance(x, Node) and not x.off]
        own = 0 if node.name == "a" else sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        free = own + sum(plain[x] for x in below if x.mark == PLAIN and x.name != "a")
        plain[node] = math.inf if free and node.name in ("article", "main") else free
        whole[node] = own + sum(whole[x] for x in below if x.mark != STRICT and x.name != "a")
        inner[node] = [x for x in below if x.mark != PLAIN] + [y for x in below if x.mark == PLAIN for y in inner.pop(x)]

    def admit(kind: int, least: int) -> None:
        nonlocal base, shut
        while ripe := [x for x in shut if x.mark == kind and least * base < whole[x]]:
            node = max(ripe, key=whole.get)
            node.mark = PLAIN
            base += plain[node]
            shut = [x for x in shut if x is not node] + inner[node]

    base, shut = plain[root], inner[root]
    admit(LENIENT, 10)
    if not base:
        admit(STRICT, 1)
    for node in order:
        node.off = node.mark != PLAIN


def measure(root: Node) -> list[Node]:
    """Densities of all nodes that may hold text, children before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and not x.off)
    order.reverse()
    for node in order:
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x) - x.count(" ") if x.isspace() else len(x)
            elif not x.off:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * lc + share * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / math.log(base) if base > 1 else 0.0
        node.total = sum(x.density for x in node.parts if isinstance(x, Node) and not x.off)
    return order


def article(root: Node) -> Node | None:
    """The node that holds the main text."""
    switch_off(root)
    order = [n for n in measure(root) if n.chars]
    if not order:
        return None
    densest = max(order, key=lambda n: n.density)
    least, node = densest.density, densest
    while node is not None and node.name not in ("body", "html"):
        least, node = min(least, node.density), node.parent
    if node is not None and node.density:
        least = min(least, node.density)
    best = max((n for n in order if n.density >= least), key=lambda n: n.total)
    if best.total == 0:
        best = densest
    outer = None
    node = best
    while node is not None:
        if node.name in ("article", "main"):
            outer = outer or node
        node = node.parent
    best = outer or best
    while best.name not in BLOCK and best.parent is not None:
        best = best.parent
    return best


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a node, in page order."""
    out, now = [], []

    def close():
        if now:
            text = " ".join(html.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif not x.off or x is node:
            if x.name in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.parts))
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks joined by empty lines; the empty string if there is none."""
    if not page or not page.strip():
        return ""
    found = article(parse(page))
    return "\n\n".join(blocks(found)) if found is not None else ""


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points of it).

    Reads the whole ``html``; null, empty and pages without text give the empty
    string.  ``keep`` names the columns to carry along (all, if not given);
    columns named like the results are replaced, any other name is the user's.
    Each row stands for itself, so repeated rows are repeated and empty tables
    give empty results.  A worker holds a batch of rows and one page's tree;
    nothing is shuffled.
    """
    carried = Carried(pages, keep, ["text", "n_chars"])

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["carried", "text", "n_chars"])

    rows = pages.select(carried.column, F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, carried.schema("text string, n_chars long")).select(*carried.fields(), "text", "n_chars")


def op8_query(spark, sf_dir):
    return extract(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
