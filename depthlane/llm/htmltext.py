"""Main-text extraction by consensus host paths.

Each page is parsed once to score its containers (text outside links of their blocks, semantic tags preferred) and to name
the best by its generalised path: tags and classes from the root, with digits and ids left out. Per host Spark counts the
votes of the pages' paths; every page is then extracted again from the winning path of its host, or from its own best
container where it has no such path or no text there. Votes are counts of pages, so a host of any size is a partial
aggregate; winners are joined by host, and Spark broadcasts them only where their table is small.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by tag, role
or class word; a heading's own header ("post-header") stays, only a header element or that of a site goes. Null or empty html gives an empty text; a null url is a host of its own. Repeated rows are extracted each.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise, ship

SCHEMA = "page_id long, url string, text string, n_chars long"
# HTML's element names by how they behave, and the class words that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("head nav header footer aside form script style noscript template iframe object embed button select option input textarea svg canvas audio video dialog menu title".split())
CONTAINER = frozenset("article body div main section td center blockquote".split())
ENDS_P = BLOCK - {"body", "html", "tr", "td", "th", "tbody", "thead", "tfoot"}
DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice banner popup modal newsletter subscribe share sharing social related recommended comment comments reply replies disqus nav navbar navigation menu breadcrumb breadcrumbs footer header masthead pagination pager login signup widget".split())
COMMENT_WORDS = frozenset("comment comments reply replies".split())  # as a whole class; "has-comments" marks an article that has some
# What may stand beside a drop word in a compound of the same meaning; "header" only beside words of the whole site.
SITE = frozenset("site global top primary secondary".split())
BESIDE = SITE | frozenset("area bar block bottom box button buttons container form inner item left link links list main outer overlay page panel post posts right row slot toggle unit wrap wrapper".split())
# Drop words of the page's frame rather than of what is no article; an element with most of the page's text is not one.
FRAME = frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pager pagination promo promotion recommended related share sharing sidebar social widget".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_PLAIN = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: What the start of an item, row or cell closes, and where the search for it stops.
_LISTS = frozenset("ul ol dl table select".split())
SIBLINGS = {
    "li": ({"li"}, _LISTS), "dd": ({"dd", "dt"}, _LISTS), "dt": ({"dd", "dt"}, _LISTS), "option": ({"option"}, _LISTS),
    "tr": ({"tr"}, _LISTS), "td": ({"td", "th"}, _LISTS | {"tr"}), "th": ({"td", "th"}, _LISTS | {"tr"}),
}
SCOPED = _LISTS | frozenset(SIBLINGS)
SVG = frozenset("path g rect circle use".split())
DAMPING = 0.6
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


def drop_words(name: str) -> set[str]:
    """The drop words of a class or id that is one, or a compound of nothing but such words, digits and those of BESIDE."""
    if name in DROP_WORDS:
        return {name}
    parts = {w for w in _PART.split(name) if w and not w.isdigit()}
    found = parts & DROP_WORDS
    return found if found and parts - found <= (SITE if "header" in found else BESIDE) else set()


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "dropped", "words", "name")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        if not attributes:
            self.dropped, self.words, self.name = tag in DROP, frozenset(), tag
            return
        classes = attributes.get("class", "").lower().split()
        named = classes if tag in HEADINGS else [*classes, attributes.get("id", "").lower()]
        words = set() if tag in ("body", "html", "article", "main") else {w for c in named for w in drop_words(c)}
        style = attributes.get("style", "").replace(" ", "").lower()
        self.dropped = (
            tag in DROP or (tag == "article" and not COMMENT_WORDS.isdisjoint(classes)) or attributes.get("role", "").lower() in DROP_ROLES
            or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
        )
        self.words = frozenset() if self.dropped else frozenset(words)
        self.dropped = self.dropped or bool(words)
        self.name = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes} - {""})])


def attributes_at(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from the end of its name on, by HTML's rules, and the place after the tag; -1 where the page
    ends inside it. A quote matters only at the start of a value; of equal names the first holds."""
    found: dict[str, str] = {}
    end = len(page)
    while True:
        at = _GAP.match(page, at).end()
        if at >= end:
            return found, -1
        if page[at] == ">":
            return found, at + 1
        m = _KEY.match(page, at)
        name, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(page, at):
            at = m.end()
            quote = page[at : at + 1]
            if quote == '"' or quote == "'":
                close = page.find(quote, at + 1)
                if close < 0:
                    return found, -1
                value, at = page[at + 1 : close], close + 1
            else:
                m = _PLAIN.match(page, at)
                value, at = m[0], m.end()
        found.setdefault(name, html.unescape(value) if "&" in value else value)


class _Open:
    """The open elements. Every element is pushed and popped once, and what may close is known without a search."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.levels: list[Counter] = [Counter()]  # the open inline elements within each open block element, by tag
        self.blocks: list[int] = [0]  # places of the open block elements, the root first
        self.scoped: list[int] = []  # places of the open list and table elements
        self.counts: Counter = Counter()  # open block elements by tag

    def push(self, node: Node) -> None:
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
            self.levels.append(Counter())
            self.counts[node.tag] += 1
        else:
            self.levels[-1][node.tag] += 1
        if node.tag in SCOPED:
            self.scoped.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, to: int) -> None:
        """Close everything from this place on."""
        while len(self.nodes) > to:
            node = self.nodes.pop()
            if node.tag in BLOCK:
                self.blocks.pop(), self.levels.pop()
                self.counts[node.tag] -= 1
            else:
                self.levels[-1][node.tag] -= 1
            if node.tag in SCOPED:
                self.scoped.pop()

    def starts(self, tag: str) -> None:
        """What the start of this tag closes: a paragraph, or the item, row or cell of the same list or table."""
        if tag in ENDS_P and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in SIBLINGS:
            closes, stops = SIBLINGS[tag]
            for place in reversed(self.scoped):  # elements that close each other never pile up without a stop between
                if self.nodes[place].tag in closes:
                    self.cut(place)
                    break
                if self.nodes[place].tag in stops:
                    break

    def ends(self, tag: str) -> None:
        """An inline end tag reaches up to the block around it, that of a block element any element of its tag."""
        if (self.counts if tag in BLOCK else self.levels[-1])[tag]:
            place = len(self.nodes) - 1
            while self.nodes[place].tag != tag:
                place -= 1
            self.cut(place)


def parse(page: str) -> Node:
    """A tree of nodes and strings, in time linear in the page. Tags are read by HTML's rules; unclosed paragraphs, items and
    cells end where the next one starts. A tag, comment or raw element that the page leaves unfinished goes."""
    root = Node("#root", {}, None)
    open_, at, end = _Open(root), 0, len(page)
    while at < end:
        less = page.find("<", at)
        if less < 0:
            open_.nodes[-1].children.append(html.unescape(page[at:]))
            break
        if less > at:
            open_.nodes[-1].children.append(html.unescape(page[at:less]))
        sign = page[less + 1 : less + 2]
        if sign == "!" or sign == "?":
            if page.startswith("<!--", less):
                short = 1 if page.startswith(">", less + 4) else 2 if page.startswith("->", less + 4) else 0
                close = _COMMENT_END.search(page, less + 4) if not short else None
                at = less + 4 + short if short else close.end() if close else end
            else:
                at = page.find(">", less) + 1 or end
            continue
        m = _NAME.match(page, less + (2 if sign == "/" else 1))
        if m is None:
            if sign == "/":
                at = page.find(">", less) + 1 or end
            else:
                open_.nodes[-1].children.append("<")
                at = less + 1
            continue
        tag, at = m[0].lower(), m.end()
        attributes: dict[str, str] = {}
        if page.startswith(">", at):
            at += 1
        else:
            attributes, at = attributes_at(page, at)
            if at < 0:
                break
        if sign == "/":
            open_.ends(tag)
            continue
        open_.starts(tag)
        node = Node(tag, attributes, open_.nodes[-1])
        open_.nodes[-1].children.append(node)
        if tag in RAW:
            close = _RAW_END[tag].search(page, at)
            at = (page.find(">", close.end()) + 1 or end) if close else end
        elif tag not in VOID and not (tag in SVG and page.startswith("/>", at - 2)):
            open_.push(node)  # HTML ignores the slash of an element of its own that is not void
    _spare(root)
    return root


def _spare(root: Node) -> None:
    """Elements dropped by their words alone stay if they hold a main or the longest article, or, where the words are of
    the page's frame, most of the page's text outside links."""
    order, size, linked, named, stack = [], {}, set(), {}, [root]
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "a" or id(node.parent) in linked:
            linked.add(id(node))
        named[id(node)] = bool(node.words - FRAME) or (node.parent is not None and named[id(node.parent)])
        size[id(node)] = 0 if id(node) in linked else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        stack += [c for c in node.children if isinstance(c, Node) and (not c.dropped or c.words)]
    if not any(n.words for n in order):
        return
    for node in reversed(order):
        if node.parent is not None:
            size[id(node.parent)] += size[id(node)]
    unnamed = root_size = size[id(root)]
    unnamed -= sum(size[id(n)] for n in order if n.words - FRAME and not named[id(n.parent)])
    articles = [n for n in order if n.tag == "article"]
    holders = [n for n in order if n.tag == "main"] + ([max(articles, key=lambda n: size[id(n)])] if articles else [])
    holds: set[int] = set()
    for node in holders if root_size else ():
        while node.parent is not None and id(node.parent) not in holds:
            node = node.parent
            holds.add(id(node))
    for node in order:
        if node.words and (id(node) in holds or (node.words <= FRAME and 2 * size[id(node)] > unnamed)):
            node.dropped = False


def blocks(node: Node) -> list[tuple[str, Node, int]]:
    """(text, nearest block element, characters in links) of each block below node, in page order."""
    out: list[tuple[str, Node, int]] = []
    run: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                out.append((text, owner, linked))
            run.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]  # node, next child, block around, in a link
    while stack:
        own, k, around, link = stack.pop()
        if k < len(own.children):
            stack.append((own, k + 1, around, link))
            child = own.children[k]
            if isinstance(child, str):
                run.append(child)
                linked += len(child) if link else 0
            elif not child.dropped:
                if child.tag == "br":
                    run.append(" ")
                elif child.tag in BLOCK:
                    flush(around)
                    stack.append((child, 0, child, link))
                else:
                    stack.append((child, 0, around, link or child.tag == "a"))
        elif own is around:
            flush(own)
    return out


def path(node: Node) -> str:
    names = []
    while node.parent is not None:
        names.append(node.name)
        node = node.parent
    return "/".join(reversed(names))


def best_container(root: Node) -> Node:
    """The container whose blocks have most text outside links; an enclosing article or main is taken instead.

    A block counts in full for the nearest container and DAMPING as much for each one further out.
    """
    gains: dict[int, float] = {}
    for text, owner, linked in blocks(root):
        gains[id(owner)] = gains.get(id(owner), 0.0) + max(0, len(text) - 2 * linked) + (20 if owner.tag == "p" else 0)
    if not gains:
        return root
    order, depth, stack = [], {id(root): 0}, [root]
    while stack:
        node = stack.pop()
        order.append(node)
        for child in node.children:
            if isinstance(child, Node) and not child.dropped:
                depth[id(child)] = depth[id(node)] + 1
                stack.append(child)
    best, score = root, (-1.0, 0)
    for node in reversed(order):  # children before their parents
        own = gains.get(id(node))
        if own is None or node.parent is None:
            continue
        if node.tag in CONTAINER:
            if (own, -depth[id(node)]) >= score:  # of equals the outer, then the first on the page
                best, score = node, (own, -depth[id(node)])
            own *= DAMPING
        gains[id(node.parent)] = gains.get(id(node.parent), 0.0) + own
    up = best
    while up.parent is not None:
        if up.tag in ("article", "main") or up.attributes.get("role") == "main":
            best = up
        up = up.parent
    return best


def find(root: Node, wanted: str) -> list[Node]:
    """All elements on this generalised path that are not dropped, in page order."""
    level = [root]
    for name in wanted.split("/"):
        level = [c for n in level for c in n.children if isinstance(c, Node) and not c.dropped and c.name == name]
    return level


def extract(page: str, wanted: str | None = None) -> str:
    """Blocks of all elements on the wanted path, or else on that of the page's own best container, joined by empty lines."""
    root = parse(page)
    found = [t for n in find(root, wanted) for t, _, _ in blocks(n)] if wanted else []
    if not found:
        own = path(best_container(root))
        found = [t for n in (find(root, own) if own else [root]) for t, _, _ in blocks(n)]
    return "\n\n".join(found)


def _vote(frames):
    for frame in frames:
        yield pd.DataFrame({"host": frame["host"], "path": [path(best_container(parse(h))) if isinstance(h, str) and h.strip() else "" for h in frame["html"]]})


def _extract(frames):
    for frame in frames:
        texts = [extract(h, w if isinstance(w, str) else None) if isinstance(h, str) and h.strip() else "" for h, w in zip(frame["html"], frame["path"])]
        yield pd.DataFrame({"page_id": pd.Series([int(i) if isinstance(i, str) else None for i in frame["page_id"]], dtype="Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path that most pages of the host vote for (ties: the lesser path)."""
    votes = pages.select("host", "html").mapInPandas(_vote, "host string, path string").where("path <> ''").groupBy("host", "path").count()
    first = Window.partitionBy("host").orderBy(F.desc("count"), "path")
    return votes.withColumn("n", F.row_number().over(first)).where("n = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    winners = materialise(winning_paths(own), "host-paths")
    return own.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInPandas(_extract, SCHEMA)
