"""HTML main-text extraction by tree scoring, in Arrow batches.

The page is parsed into a tree. Every paragraph-like block gives points for its
commas and its length to its parent, and half of them to its grandparent; a
container's points are discounted by its link density. The container with most
points is the main one. Siblings of it stay if they score at least a fifth of
it, or are prose with few links. Blocks that are never part of an
article (navigation, asides, forms, scripts, adverts, notices, comments and the
like, by tag, role or class) are removed before scoring, unless they enclose
most of the page's text.

Defined results: a null or empty page, or one without text, gives the empty
string; unclosed and stray tags are read as browsers do, except that a slash which
is no part of a value closes any tag; a very long page takes its tree, some ten times its
length; repeated rows each get
their text; an empty table gives an empty result; other columns are kept, and
columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption legend summary html body".split())
DROPPED_TAGS = frozenset(
    "script style noscript template iframe object embed svg canvas form button input select textarea label option fieldset nav aside footer "
    "header menu dialog head title meta link audio video map noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tooltip".split())
NAMES = (
    r"ads?|adverts?|advertisement|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|ted)?|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|sidebar|side-?bar|aside|widget|footer|masthead|site-?header|page-?header|topbar|toolbar|"
    r"comments?|commentlist|disqus|replies|respond|discussion|share|sharing|social|related|recommend(?:ed|ations)?|outbrain|taboola|skip-?link|hidden|print-only"
)
#: Outside an article a part of a class or id is enough; inside, the whole name must say so, but for what names a box.
DROPPED_NAMES = re.compile(rf"(?:^|[\s_-])(?:{NAMES})(?:$|[\s_-])", re.I)
BOXES = r"box|boxes|container|wrapper|wrap|block|section|area|list|bar|buttons?|btns?|links?|icons?|form|slot|unit|top|bottom|inline|banner|notice|message|posts?|articles?|stories|content|media|tools?|\d+"
DROPPED_WHOLE = re.compile(rf"(?:^|\s)(?:(?:site|page|post|article|entry|main|inline|reader|user|social|cookie|privacy)[_-]+)?(?:{NAMES})(?:[_-]+(?:{NAMES}|{BOXES}))*(?:$|\s)", re.I)
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Siblings of the main container that are looked at for prose.
TEXTS = frozenset("p div section blockquote pre".split())
SCORED = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 div section article figcaption dt".split())
#: A tag's quoted values end before white space, a slash or the tag's end; where a quote is never closed so, the tag ends at the next ``>``.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*)>|([^>]*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: The slash of ``<a name="x" />``; that of ``<a href=/x/>`` is the value's.
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("kids", "parent", "raw", "read", "tag")

    def __init__(self, tag: str, raw: str, parent: Node | None):
        self.tag, self.raw, self.parent, self.kids, self.read = tag, raw, parent, [], None

    @property
    def attrs(self) -> dict[str, str]:
        """Values by name; the first of equal names counts."""
        if self.read is None:
            self.read = {}
            for m in ATTR.finditer(self.raw):
                self.read.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return self.read

    def attr(self, name: str) -> str:
        return self.attrs.get(name, "")


#: Start tags that end an open element of the same kind, and what keeps them apart.
KINDS = {
    "p": (("p",), BLOCK),
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
KIND_OF = dict.fromkeys(ENDS_P, "p") | {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}


def parse(html: str) -> Node:
    """A tree of elements; texts are strings among the children. Every step is paid for by the tags that it opens or closes."""
    root = here = Node("#root", "", None)
    stack = [root]
    # for each open element, where in the stack the innermost open one of each kind is
    inner = [dict.fromkeys(KINDS, 0)]
    count: dict[str, int] = {}

    def close(depth: int) -> None:
        while len(stack) > depth:
            count[stack.pop().tag] -= 1
            inner.pop()

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            here.kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if count.get(tag):
                while stack[-1].tag != tag:
                    close(len(stack) - 1)
                close(len(stack) - 1)
                here = stack[-1]
            continue
        for kind in ("p", KIND_OF.get(tag)) if tag in ENDS_P else (KIND_OF.get(tag),):
            if kind and inner[-1][kind]:
                close(inner[-1][kind])
                while kind != "p" and stack[-1].tag in KINDS[kind][0]:
                    close(len(stack) - 1)
        here = stack[-1]
        attrs = m[3] if m[3] is not None else m[4]
        node = Node(tag, attrs, here)
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            node.kids.append(html[at : end.start()] if end else html[at:])
            at = end.end() if end else n
        elif tag not in VOID and not CLOSED.search(attrs):
            own = inner[-1]
            changed = {k: len(stack) if tag in same else 0 for k, (same, stop) in KINDS.items() if tag in same or tag in stop}
            stack.append(node)
            inner.append(own | changed if changed else own)
            count[tag] = count.get(tag, 0) + 1
            here = node
    return root


def _measure(root: Node) -> tuple[dict[Node, int], dict[Node, int]]:
    """Characters of text, and of text in links, below every element; without recursion, as trees may be deep."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    size, linked = {}, {}
    for node in reversed(order):
        size[node] = sum(size[k] if isinstance(k, Node) else len(k.strip()) for k in node.kids)
        linked[node] = size[node] if node.tag == "a" else sum(linked[k] for k in node.kids if isinstance(k, Node))
    return size, linked


def _unwanted(node: Node, article: bool) -> bool:
    if node.tag in DROPPED_TAGS:
        # an article's own header holds its title
        return not (node.tag == "header" and article)
    if not node.raw or node.tag in ("html", "body", "article", "main"):
        return False
    attrs = node.attrs
    if "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true":
        return True
    if HIDDEN_STYLE.search(attrs.get("style", "")) or attrs.get("role", "").strip().lower() in DROPPED_ROLES:
        return True
    named = DROPPED_WHOLE if article else DROPPED_NAMES
    return ("class" in attrs or "id" in attrs) and bool(named.search(f"{node.attr('class')} {node.attr('id')}"))


def prune(root: Node) -> None:
    """Removes what is never part of an article."""
    size, _ = _measure(root)
    todo = [(root, False)]
    while todo:
        node, article = todo.pop()
        article = article or node.tag in ("article", "main")
        kept = []
        for k in node.kids:
            if isinstance(k, Node):
                if _unwanted(k, article) and (k.tag in DROPPED_TAGS or 2 * size[k] < size[root] or not size[root]):
                    if k.tag in BLOCK:
                        kept.append(Node("hr", "", node))
                    continue
                todo.append((k, article))
            kept.append(k)
        node.kids = kept


def best(root: Node) -> list[Node]:
    """The best container and those of its siblings that belong to it, in page order."""
    size, linked = _measure(root)
    points: dict[Node, float] = {}
    # size holds every element after those below it; with blocks below, the text is theirs
    outer: set[Node] = set()
    for node in size:
        if node.parent is not None and (node.tag in BLOCK or node in outer):
            outer.add(node.parent)
    for node in reversed(size):
        if node.tag not in SCORED or node.parent is None or node in outer:
            continue
        text = _inline(node)
        if len(text) < 25:
            continue
        gain = 1 + text.count(",") + min(len(text) / 100, 3)
        points[node.parent] = points.get(node.parent, 0) + gain
        if node.parent.parent is not None:
            points[node.parent.parent] = points.get(node.parent.parent, 0) + gain / 2
    if not points:
        return [root]
    bonus = {"article": 25, "main": 20, "section": 2, "div": 5}
    score = {n: (p + bonus.get(n.tag, 0)) * (1 - linked[n] / max(1, size[n])) for n, p in points.items()}
    top = max(score, key=lambda n: (score[n], size[n]))
    # an article is one piece: do not stop at a part of it
    node = top
    while node.parent is not None:
        node = node.parent
        if node.tag == "article":
            top = node
    if top.parent is None or top.tag == "body":
        return [top]
    least = max(10.0, 0.2 * score.get(top, 0))
    out = []
    for k in top.parent.kids:
        if not isinstance(k, Node):
            continue
        density = linked[k] / max(1, size[k])
        prose = k.tag in TEXTS and (size[k] > 80 and density < 0.25 or 0 < size[k] <= 80 and density == 0 and "." in _inline(k))
        if k is top or score.get(k, 0) >= least or prose:
            out.append(k)
    return out


def _inline(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append(" ")
        else:
            todo += reversed(k.kids)
    return SPACE.sub(" ", "".join(out)).strip()


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of all blocks, white space as one space, in page order."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            out.append(text)
        line.clear()

    todo: list = [*reversed(nodes)]
    while todo:
        k = todo.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            line.append(k)
        elif k.tag == "br":
            line.append(" ")
        elif k.tag in BLOCK or k.tag == "#root":
            flush()
            todo.append(None)
            todo += reversed(k.kids)
        else:
            todo += reversed(k.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of one page; its blocks joined by line feeds."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    return "\n".join(blocks(best(root)))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every page, and drops ``html``."""
    kept = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [main_text(h) for h in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return common.map_batches(pages.select(*names, F.col(html).alias("__html")), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
