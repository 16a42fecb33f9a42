"""Main text of HTML pages by composite text density.

A page is read whole into a small DOM (start and end tags, implied ends of
paragraphs, list items and table cells, raw text elements, comments; broken
or cut markup never fails).  Then, after Sun, Song and Liao (SIGIR 2011):

1. every node gets its composite text density: characters per tag, adjusted
   by the shares of link characters and link tags in it and in the body;
2. every node gets the sum of its children's densities; the node of the
   largest sum is the core of the page;
3. the lowest density on the path from the core to the body is the threshold.
   The selected subtree is the core's highest ancestor below the body, or the
   body if it is the core.  At every level of the path above the core, and under
   the body, containers below the threshold stay out.  Tags only break ties: an
   article or main element beside the path stays whatever its density.

Elements that are never part of an article (navigation, forms, scripts, hidden
ones, those whose class, id or role names a menu, advert, notice, comment list
and so on) are pruned before, and blocks made of links after; inside the article
(article and main elements and the core) paragraphs, list items, table cells
and all else stay, however much of them is linked, and whatever their names say
unless it is adverts or comments.

A null, empty or textless page gives an empty text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_rows, table

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.IGNORECASE) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: Start tag: the open elements it ends, and the elements beyond which it does not look.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
NEVER = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button "
    "select option textarea input menu dialog datalist title xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark a part as not belonging to the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar sidenav "
    "menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup signin login share sharing social related "
    "recommended recommendations widget widgets toolbar pagination pager search copyright disclaimer alert toast skip "
    "hidden paywall tags".split()
)
#: Of these, the names that mean the same inside an article, where other words may be about the subject.
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion".split())
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply discussion".split())
#: A name of these words and none of the above marks the article, whatever other names say.
CONTENT = frozenset("article main post entry story".split())
#: Names that begin so tell how a part is laid out, not what it is.
LAYOUT = frozenset("has with without no is".split())
HINT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
CONTAINERS = frozenset("div section article main td body center blockquote details".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "attrs", "within", "noise", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.parts: list[Node | str] = []
        #: whether an article or main element is above
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.noise = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_noise(node: Node) -> bool:
    if node.tag in NEVER:
        return True
    if node.tag == "header":
        return not node.within
    if not node.attrs or node.tag in ("html", "body"):
        return False
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)}
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.IGNORECASE):
        return True
    noisy, content = False, node.tag in ("article", "main")
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in HINT.findall(name)]
        if not words or words[0] in LAYOUT:
            continue
        if not COMMENTS.isdisjoint(words):
            return True
        if not (ADVERTS if node.within else NOISE).isdisjoint(words):
            noisy = True
        elif not CONTENT.isdisjoint(words):
            content = True
    return noisy and not content


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes, parents before children.

    For every tag the places of its open elements are kept, so that no start or
    end tag walks the open elements, however many there are.
    """
    root = Node("html", None)
    nodes, stack, at = [root], [root], 0
    size = len(html)
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []  # of open elements that are neither inline nor paragraphs

    def close(i: int) -> None:
        for node in reversed(stack[i:]):
            places[node.tag].pop()
            if node.tag not in INLINE and node.tag != "p":
                blocks.pop()
        del stack[i:]

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        if node.tag not in INLINE and node.tag != "p":
            blocks.append(len(stack))
        stack.append(node)

    def last(tag: str) -> int:
        open_ones = places.get(tag)
        return open_ones[-1] if open_ones else 0

    while at < size:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name not in ("body", "html") and last(name):
                close(last(name))
            continue
        if name == "html":
            continue
        if name in ENDS_P and last("p"):
            if last("p") > (blocks[-1] if blocks else 0):
                close(last("p"))
        elif name in SIBLINGS:
            ended, stop = SIBLINGS[name]
            border = max(map(last, stop))
            found = [open_ones[k] for tag in ended if (open_ones := places.get(tag)) and (k := bisect_right(open_ones, border)) < len(open_ones)]
            if found:
                close(min(found))
        if name == "body":
            # whatever an unclosed head left open ends here
            close(1)
        node = Node(name, stack[-1], m["attrs"])
        stack[-1].parts.append(node)
        nodes.append(node)
        if name in RAW:
            end = RAW_END[name].search(html, at)
            at = end.start() if end else size
            push(node)
        elif name not in VOID:
            push(node)
    return root, nodes


def measure(root: Node, nodes: list[Node]) -> None:
    """Prune, count, and set every node's density and density sum."""
    for node in nodes:
        node.noise = (node.parent is not None and node.parent.noise) or _is_noise(node)
    for node in reversed(nodes):
        if node.noise:
            continue
        node.chars += sum(len(" ".join(unescape(p).split())) for p in node.parts if isinstance(p, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        if node.noise or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, node.link_tags
        # the published base is ln(..) >= 1; e - 1 more keeps it a base where nothing is linked
        base = math.e - 1 + math.log(c / max(1, c - lc) * lc + share * c + math.e)
        node.density = c / t * max(0.0, math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base))
        if node.parent is not None:
            node.parent.total += node.density


def select(root: Node, nodes: list[Node]) -> tuple[Node, float, list[Node], Node | None]:
    """The subtree of the article, the threshold of its path to the body, the nodes whose children it holds for, and the core below the body."""
    live = [n for n in nodes if not n.noise and n.chars]
    core = max(live, key=lambda n: (n.total, n.density))
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    below = [n for n in path if n.tag not in ("html", "body")]
    found = below[-1] if below else path[-1]
    while found.tag not in CONTAINERS and found.parent is not None:
        found = found.parent
    if found.tag in ("article", "main") and sum(n.tag == found.tag and n.parent is found.parent for n in live) > 1:
        found = found.parent  # its siblings stay
    inner = None if core.tag in ("html", "body") else core
    return found, threshold, [n for n in path if n is not inner], inner


def _linked(node: Node) -> bool:
    """A block made of links: a menu or list of other pages."""
    return node.tag not in INLINE and node.link_tags >= 2 and node.link_chars > 0.5 * node.chars


def texts(node: Node, threshold: float, held: list[Node], core: Node | None) -> str:
    """Text of a subtree: white space as one space, blocks joined by one space."""
    out: list[str] = []
    levels = {id(n) for n in held}
    work: list[tuple[Node | str, bool, bool]] = [(node, False, False)]
    while work:
        part, outer, article = work.pop()
        if isinstance(part, str):
            out.append(unescape(part))
            continue
        article = article or part.tag in ("article", "main") or part is core
        if part.noise or (part is not node and not article and _linked(part)):
            out.append(" " if part.tag not in INLINE else "")
            continue
        if outer and part.tag in CONTAINERS and part.tag not in ("article", "main", "body") and part.density < threshold:
            out.append(" ")
            continue
        edge = "" if part.tag in INLINE else " "
        inside = id(part) in levels
        work.append((edge, False, False))
        work.extend((p, inside, article) for p in reversed(part.parts))
        work.append((edge, False, False))
    return " ".join("".join(out).split())


def main_text(html: str | None) -> str:
    """The article of a page; empty if there is none."""
    root, nodes = parse(html or "")
    measure(root, nodes)
    if not root.chars:
        return ""
    return texts(*select(root, nodes))


def extract_text(df: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, kept columns, text) per row: one pass, no shuffle; repeated rows each get a result."""
    fields = [df.schema[c] for c in (key, *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"
    return map_rows(
        df.select(*[F.col(c) for c in (key, *keep)], F.col(html)), lambda *row: (*row[:-1], main_text(row[-1])), schema
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text and its length in code points for every page."""
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
