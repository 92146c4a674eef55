"""Main text of web pages by tree scoring.

A page is read into a tree by a forgiving parser (implied end tags, stray end tags, raw-text elements, cut-off pages).
Elements that are never part of an article (scripts, menus, adverts, reader comments...) are dropped; a form, or an element that
only the head word of its class names so, is not if it is or holds the article, or most of the page's text. Every block
with text of its own then gets points for its length and its commas, discounted by the share of its text that is
link text, and passes them on: all to its parent, half to the grandparent, ever less to ancestors further up; an
article element takes all points of what is in it, a main element three quarters. The element with the most points is the
container, the outermost of equals; siblings with enough points of their own, or of its class and mostly no links, join it. The text of what is kept comes out block by block,
in page order. Lists of links alone are menus where they open the container or stand outside of articles, not under a heading or paragraph.

A page is read, pruned and scored in time in proportion to its elements, however deep they are: sums are made once, from the leaves up.

Rows: null and empty html give an empty text; html without tags is one block; text cut off inside a tag or a character
reference is kept as far as it goes; repeated rows get a result each; other columns are left out, whatever they are
called; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import small_batches

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside button datalist dialog embed footer head iframe input map menu nav noscript object script select style svg template textarea title audio video canvas math".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option"), "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th")}
WALLS = frozenset("article aside body div footer form header html li main nav ol section table td th ul".split())
#: Parts of class names and ids, and roles, of what is not article.
PARTS = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promoted promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall sidebar aside rail widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation pagination pager masthead footer comment comments commentlist disqus reply replies respond toolbar skip".split())
#: Words that stand behind the word that names an element, or say where it is.
BEHIND = frozenset("list box block wrapper wrap container section area bar unit slot item items links posts articles content inner outer group panel left right top bottom main primary secondary js this form".split())
WHOLE = frozenset("header site-header page-header top-header global-header topbar".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BODY = frozenset("article main body html".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:(>)|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("attrs", "children", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs, self.children, self.points = tag, parent, attrs, [], 0.0


def parse(text: str) -> Node:
    """The tree of a page."""
    root = Node("html", None)
    here, at, n = root, 0, len(text)
    open_ = collections.Counter()  # elements of each kind around here, at least: no climb for a kind that is not open
    while at < n:
        m = _TAG.search(text, at)
        if not m:
            here.children.append(text[at:])
            break
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        name = m[3] or m[7]
        if m[1] is not None:
            here.children.append(m[1].replace("&", "&amp;"))
        if not name:
            continue
        name = name.lower()
        if not (m[5] or m[9]):  # the page ends inside a tag
            break
        if m[2] or m[6]:
            up = here if open_[name] else root
            while up is not root and up.tag != name:
                if up.tag in WALLS and name not in WALLS and name not in BLOCK:
                    up = root
                    break
                up = up.parent
            if up is not root:
                here = _close(here, up.parent, open_)
            elif name == "p":
                here.children.append(Node("p", here))
            continue
        attrs = m[4] or m[8] or ""
        if name in ("html", "body"):
            if name == "body":
                while here.tag in ("head", "title") and here.parent:
                    here = _close(here, here.parent, open_)
            continue
        if name in SAME:
            up = here if any(open_[t] for t in SAME[name]) else root
            while up is not root and up.tag not in SAME[name] and up.tag not in ("ul", "ol", "dl", "table", "select", "menu"):
                up = up.parent
            if up.tag in SAME[name]:
                stop = "table" if name[0] == "t" and name not in ("td", "th") else None
                while up.parent.tag in SAME[name] and stop:
                    up = up.parent
                here = _close(here, up.parent, open_)
        elif name in CLOSES_P:
            up = here if open_["p"] else root
            while up is not root and up.tag != "p" and up.tag not in WALLS:
                up = up.parent
            if up.tag == "p":
                here = _close(here, up.parent, open_)
        node = Node(name, here, attrs)
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and (name in BLOCK or not attrs.endswith("/")):
            here = node
            open_[name] += 1
    return root


def _close(here: Node, until: Node, open_: collections.Counter) -> Node:
    """until, an ancestor of here, after what is open below it was closed."""
    while here is not until:
        open_[here.tag] -= 1
        here = here.parent
    return until


def _unwanted(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article; inside: it stands in an article or main element."""
    if node.tag in NEVER or node.tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(node.attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    return not inside and any(name.lower() in WHOLE for value in (found.get("class", ""), found.get("id", "")) for name in value.split())


def _worded(node: Node) -> bool:
    """Whether an element is a form, or the head word of its class or id (the last that is not a general one) names what is no part
    of an article: comment-list and sidebar do, related-work does not."""
    if node.tag == "form":
        return True
    if not node.attrs or node.tag in BODY - {"article"}:
        return False
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(node.attrs)}
    for value in (found.get("class", ""), found.get("id", "")):
        for name in value.split():
            words = [w for w in _SPLIT.split(_CAMEL.sub("-", name).lower()) if w and not w.isdigit()]
            while len(words) > 1 and words[-1] in BEHIND:
                words.pop()
            if words and words[-1] in PARTS:
                return True
    return False


def _prune(root: Node) -> set[Node]:
    """Drops what is no part of an article; gives the elements kept although a word of their class says so.

    A word alone drops no element that the article may be in: one that is an article, or holds an article or main
    element or most of the page's text, while no better one is left without it.
    """
    stack, order, worded = [(root, False)], [], set()
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not _unwanted(c, inside)]
        order.append(node)
        if _worded(node):
            worded.add(node)
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]
    if not worded:
        return set()
    # characters that are no link, of all below a node and without its worded elements; whether an article is in it
    every, plain, holds = {}, {}, {}
    for node in reversed(order):
        below = [c for c in node.children if not isinstance(c, str)]
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        link = node.tag == "a"
        every[node] = 0 if link else own + sum(every[c] for c in below)
        plain[node] = 0 if link else own + sum(plain[c] for c in below if c not in worded)
        holds[node] = node.tag in ("article", "main") or any(holds[c] for c in below)
    kept: set[Node] = set()
    region: Node | None = root
    while region is not None:
        stack, found, rest = [region], [], 0
        while stack:
            for c in stack.pop().children:
                if isinstance(c, str):
                    continue
                if c in worded:
                    found.append(c)
                    continue
                if c.tag in ("article", "main"):
                    rest = max(rest, plain[c])
                stack.append(c)
        total, left = every[region], plain[region]

        def may(c: Node) -> bool:
            if c.tag == "article":
                return every[c] > max(rest, left / 2)
            return holds[c] and 10 * rest < total and every[c] > left / 2 or 2 * every[c] > total and 5 * left < total

        region = max(filter(may, found), key=every.get, default=None)
        if region is not None:
            kept.add(region)
    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or c not in worded or c in kept]
    return kept


class Sums:
    """By element, characters and link characters of all text below it; by block, those and the commas of its own text."""

    def __init__(self, root: Node):
        self.all: dict[Node, tuple[int, int]] = {}
        self.own: dict[Node, list[int]] = {}
        self.order: list[Node] = []  # parents before children, in page order
        link, stack = {}, [(root, root, False)]
        while stack:
            node, block, in_link = stack.pop()
            self.order.append(node)
            if node.tag in BLOCK and node.tag != "br":
                block = node
                in_link = False
                self.own[node] = [0, 0, 0]
            link[node] = in_link = in_link or node.tag == "a"
            own = self.own.setdefault(block, [0, 0, 0])
            for c in node.children:
                if isinstance(c, str) and (k := len(c.strip())):
                    own[0] += k
                    own[1] += c.count(",") + c.count("，")
                    own[2] += k * in_link
            stack += [(c, block, in_link) for c in reversed(node.children) if not isinstance(c, str)]
        for node in reversed(self.order):
            chars = links = 0
            for c in node.children:
                k, n = (len(c.strip()), 0) if isinstance(c, str) else self.all[c]
                chars, links = chars + k, links + n
            self.all[node] = (chars, chars if node.tag == "a" else links)


#: The part of a block's points that its ancestors get, by distance; all further ones get the last.
SHARES = (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12)
#: And the part of all points in them that these elements get at least.
WHOLES = {"article": 1.0, "main": 0.75}


def _score(sums: Sums) -> None:
    """Points of all elements, from the leaves up: what each passes on is kept by distance."""
    passed: dict[Node, list[float]] = {}
    for node in reversed(sums.order):
        chars, commas, links = sums.own.get(node, (0, 0, 0))
        mine = (1 + commas + min(chars / 100, 30)) * (1 - links / chars) if chars else 0.0
        far = [0.0] * len(SHARES)
        for c in node.children:
            if not isinstance(c, str):
                for k, x in enumerate(passed.pop(c)):
                    far[k] += x
        node.points = sum(x * share for x, share in zip(far, SHARES))
        if node.tag in ("div", "section", "article", "main", "td", "body", "html", "form"):
            node.points += mine
        node.points = max(node.points, WHOLES.get(node.tag, 0) * (mine + sum(far)))
        passed[node] = [mine, *far[:-2], far[-2] + far[-1]]


def _class(node: Node) -> tuple[str, ...]:
    """The names in an element's class, in order."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(node.attrs)} if node.attrs else {}
    return tuple(found.get("class", "").split())


def _menu(node: Node, sums: Sums) -> bool:
    """A list of three items or more, each of them a link and nothing else."""
    items = [c for c in node.children if not isinstance(c, str)]
    return node.tag in ("ul", "ol") and len(items) >= 3 and all(sums.all[c][0] and sums.all[c][0] == sums.all[c][1] for c in items)


def _introduced(node: Node) -> bool:
    """Whether an element stands in an article, or the one before it is a heading or a paragraph with text."""
    up = node.parent
    while up is not None:
        if up.tag == "article":
            return True
        up = up.parent
    before = None
    for c in node.parent.children if node.parent else ():
        if c is node:
            break
        if not isinstance(c, str):
            before = c
    return before is not None and before.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "dl", "blockquote")


def _text(nodes: list[Node], sums: Sums) -> str:
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        words = "".join(map(html.unescape, part)).split()  # a reference stands within one piece of text
        part.clear()
        if words:
            out.append(" ".join(words))

    for top in nodes:
        stack: list = [top]
        while stack:
            c = stack.pop()
            if c is None:
                flush()
            elif isinstance(c, str):
                part.append(c)
            elif c.tag in BLOCK:
                flush()
                if not _menu(c, sums) or _introduced(c):
                    stack.append(None)
                    stack += reversed(c.children)
            else:
                stack += reversed(c.children)
        flush()
    return " ".join(out)


def main_text(page: str) -> str:
    """The article's text."""
    if "<" not in page:
        return " ".join(html.unescape(page).split())
    root = parse(page)
    worded = _prune(root)
    sums = Sums(root)
    _score(sums)
    best = max(sums.order, key=lambda x: x.points)  # the first of equals is the outermost
    if not best.points:
        return _text([root], sums)
    while best.tag in ("p", "tr", "tbody", "b", "span", "ul", "ol", "li", "table") and best.parent is not None:
        best = best.parent
    if best.parent is None:
        return _text([best], sums)
    least, kept, name = max(5.0, 0.2 * best.points), [], _class(best)
    for c in best.parent.children:
        if c is best:
            kept.append(c)
        elif not isinstance(c, str) and c not in worded:
            chars, links = sums.all[c]
            dense = links / chars if chars else 1
            own = sums.own.get(c, (0, 0, 0))
            alike = bool(name) and c.tag == best.tag and _class(c) == name
            if (c.points >= least or alike) and dense < 0.3 or c.tag == "p" and (own[0] > 80 and dense < 0.25 or own[0] and not dense and re.search(r"\.(\s|$)", _text([c], sums))) or c.tag in ("h1", "h2", "h3", "blockquote", "pre") and best.tag not in ("article", "main") and not dense:
                kept.append(c)
    return _text(kept, sums)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py() or "") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
