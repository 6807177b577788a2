"""Main-text extraction by tree scoring.

A page is read into a tree of elements whose leaves are text blocks.  Each paragraph gives
its ancestors points for its length and its commas, the full amount to the nearest, half to
the next, half of that to the one after; a container's points are discounted by the share of
its text that is in links.  The container with the most points is the article; siblings that score well or
read like prose are kept with it, and a lone heading right before it too.  Elements that
never hold article text (scripts, menus, forms, notices, adverts, comments of readers) are
cut out first, by tag, role or words in class and id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.shared import beside

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are left out with all they hold.
DROPPED = frozenset("script style head title nav footer header aside form button select option textarea iframe noscript svg canvas object template dialog menu audio video input label noembed noframes xmp".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Which open elements a start tag ends, and where the search for them stops.
ENDS: dict[str, tuple[set[str], set[str]]] = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH = frozenset("html p pre blockquote td dd li div section article main body figcaption summary".split())
CONTAINER = frozenset("article main section div td body blockquote center html".split())
#: Characters of a paragraph from which it gives points, where any paragraph of the page has so many.
LEAST = 10
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that mark what is not the article.
_UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|"
    r"nav\w*|menu|breadcrumbs?|pagination|pager|sidebar|side|aside|widgets?|footer|foot|header|masthead|topbar|toolbar|"
    r"comments?|disqus|replies|respond|reader-comments|share|sharing|social|related|recommend\w*|more-stories|login|signup|search|skip|hidden|print-only|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|column)(?:$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_INSIDE = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WHITE = re.compile(r"\s+")
_COMMA = re.compile(r"[,，、،]")


#: The families of such tags; a node knows the nearest element around it that each family's search would meet.
FAMILIES = list({id(v): v for v in [({"li"}, {"ul", "ol", "menu", "dir"}), ({"dt", "dd"}, {"dl"}), ({"tr", "td", "th"}, {"table"}), ({"td", "th"}, {"tr", "table"}), ({"option"}, {"select"})]}.values())
_FAMILY = {tag: next(k for k, f in enumerate(FAMILIES) if f == v) for tag, v in ENDS.items()}
_MET = {tag: [k for k, (ended, stop) in enumerate(FAMILIES) if tag in ended | stop] for tag in {t for ended, stop in FAMILIES for t in ended | stop}}


class Node:
    __slots__ = ("tag", "parent", "children", "attributes", "score", "size", "links", "block", "near")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.children: list[Node | str] = []
        self.score = 0.0
        self.size = self.links = 0  # characters of text, and of those in links, with all descendants
        self.block: Node = self if parent is None or tag in BLOCK else parent.block
        self.near: tuple[Node | None, ...] = parent.near if parent else (None,) * len(FAMILIES)
        if tag in _MET:
            self.near = tuple(self if k in _MET[tag] else n for k, n in enumerate(self.near))


class _Tags:
    """Reads tags one after the other; no character is looked at more than a few times.

    An attribute in quotes may hold a ``>``.  Where a quote is never closed, the rest of the page is
    read as if quotes meant nothing.
    """

    def __init__(self, html: str):
        self.html = html
        self.quotes = True

    def end_of(self, at: int) -> int:
        """Place of the ``>`` of the tag whose name ends at ``at``, or -1."""
        if self.quotes:
            end = _INSIDE.match(self.html, at).end()
            if end < len(self.html) and self.html[end] == ">":
                return end
            self.quotes = False
        return self.html.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(begin, end, slash, name, inside) of the next tag; comments and the like have no name."""
        html = self.html
        while (begin := html.find("<", at)) >= 0:
            sign = html[begin + 1 : begin + 2]
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                return begin, len(html) if end < 0 else end + 3, "", "", ""
            if sign in ("!", "?") and sign:
                end = html.find(">", begin)
                if end < 0:
                    return None
                return begin, end + 1, "", "", ""
            name = _NAME.match(html, begin + 1 + (sign == "/"))
            if name:
                end = self.end_of(name.end())
                if end < 0:
                    return None
                return begin, end + 1, sign if sign == "/" else "", name[0].lower(), html[name.end() : end]
            at = begin + 1
        return None


def parse(html: str) -> Node:
    """A forgiving reader: unclosed and misnested elements are closed as browsers do in the usual cases."""
    root = Node("html", None, {})
    here, at = root, 0
    tags = _Tags(html)
    unclosed = {"html": 1}  # how many elements of each tag are open

    def shut(upto: Node | None) -> Node:
        """Ends the open elements below ``upto``."""
        node = here
        while node is not upto:
            unclosed[node.tag] -= 1
            node = node.parent
        return upto

    while True:
        found = tags.next(at)
        if found is None:
            rest = html[at:]
            # An unfinished tag at the end of the page is markup, not text.
            last = rest.rfind("<")
            if last >= 0 and re.match(r"[a-zA-Z/!]", rest[last + 1 :]):
                rest = rest[:last]
            if rest:
                here.children.append(unescape(rest))
            return root
        begin, end, slash, name, inside = found
        if begin > at:
            here.children.append(unescape(html[at:begin]))
        at = end
        if not name or (name == "html" and not slash):
            continue
        if slash:
            if unclosed.get(name) and name != "html":
                up = here
                while up.tag != name:
                    up = up.parent
                here = shut(up.parent)
            continue
        if name in ENDS_P and here.block.tag == "p":
            here = shut(here.block.parent)
        if name in _FAMILY:
            family = _FAMILY[name]
            ended = FAMILIES[family][0]
            while (up := here.near[family]) is not None and up.tag in ended:
                here = shut(up.parent)
        node = Node(name, here, {a[0].lower(): unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(inside)} if inside.strip(" /\n\t") else {})
        here.children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
            close_end = html.find(">", close.end()) if close else -1
            at = close_end + 1 if close_end >= 0 else len(html)
        elif name not in VOID and (not inside.endswith("/") or name in BLOCK):
            here = node  # a slash does not close elements that have content
            unclosed[name] = unclosed.get(name, 0) + 1


def unwanted(node: Node, in_article: bool) -> bool:
    a = node.attributes
    if node.tag in DROPPED:
        # The header of an article is part of it.
        return not (node.tag == "header" and in_article)
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in _ROLES or _HIDDEN.search(a.get("style", "")):
        return True
    if node.tag in ("body", "article", "main", "html"):
        return False
    named = f"{a.get('class', '')} {a.get('id', '')}"
    return bool(_UNLIKELY.search(named)) and not (_LIKELY.search(named) and node.tag in ("div", "section") and not re.search(r"comment|sidebar|nav|menu|footer|\bads?\b|advert|related|share|cookie", named, re.I))


def prune(root: Node) -> None:
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c, inside)]
        stack += [(c, inside) for c in node.children if not isinstance(c, str)]


def blocks_of(node: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) of each run of text, in page order."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    linked = [0]

    def end(owner: Node) -> None:
        text = _WHITE.sub(" ", "".join(parts)).strip()
        if text:
            out.append((owner, text, min(linked[0], len(text))))
        parts.clear()
        linked[0] = 0

    # (node, next child, owner of the text around, whether inside a link); no recursion, as pages nest without bound
    stack: list[list] = [[node, 0, node, node.tag == "a"]]
    while stack:
        frame = stack[-1]
        at, k, owner, link = frame
        if k == len(at.children):
            stack.pop()
            if at.tag in BLOCK:
                end(at)
            continue
        frame[1] += 1
        child = at.children[k]
        if isinstance(child, str):
            parts.append(child)
            if link:
                linked[0] += len(child.strip())
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag in BLOCK:
            end(owner)
            stack.append([child, 0, child, link])
        else:
            stack.append([child, 0, owner, link or child.tag == "a"])
    end(node)
    return out


def in_order(root: Node) -> list[Node]:
    """All elements, each after the one that holds it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def tally(nodes: list[Node], found: list[tuple[Node, str, int]], least: int = LEAST) -> None:
    """Sets score, size and links of all elements, from the innermost outwards; paragraphs shorter than ``least`` give no points."""
    points: dict[int, float] = {}  # what the nearest container around an element, or it, gets in full
    for node in nodes:
        node.score, node.size, node.links = 0.0, 0, 0
    for owner, text, linked in found:
        owner.size += len(text)
        owner.links += linked
        if owner.tag in PARAGRAPH and len(text) >= least:
            worth = (1 + len(_COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))
            points[id(owner)] = points.get(id(owner), 0.0) + worth
    for node in reversed(nodes):
        passed = points.pop(id(node), 0.0)
        if node.tag in CONTAINER:
            node.score = passed
            passed /= 2
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            if passed:
                points[id(node.parent)] = points.get(id(node.parent), 0.0) + passed


def density(node: Node) -> float:
    return node.links / max(node.size, 1)


def extract(html: str) -> str:
    """The main text: blocks of the article joined by two line ends; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    prune(root)
    found = blocks_of(root)
    if not found:
        return ""
    nodes = in_order(root)
    best, most = None, 0.0
    for least in (LEAST, 1):  # where all paragraphs are short, the short ones count
        tally(nodes, found, least)
        full = [n for n in nodes if n.size]
        for node in full:
            if node.tag in CONTAINER:
                bonus = 1.25 if node.tag in ("article", "main") or _LIKELY.search(f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}") else 1.0
                value = node.score * (1 - density(node)) * bonus
                # Of equals, the inner one: it comes later.
                if value >= most and value > 0:
                    best, most = node, value
        if best is not None:
            break
    if best is None:
        # No paragraph that is not a link: an article element still names the text, or else all that is not a link is taken.
        best = next((n for n in full if n.tag in ("article", "main")), None)
        if best is None:
            return "\n\n".join(text for _, text, linked in found if 2 * linked < len(text))
    # An article element around the best container is the article as a whole.
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main") and density(up) < 0.5:
            best = up
        up = up.parent
    keep = {id(best)}
    if best.parent is not None and best.tag not in ("article", "main"):
        floor = max(10.0, 0.2 * most)
        for sibling in best.parent.children:
            if isinstance(sibling, str) or not sibling.size or sibling is best:
                continue
            if sibling.score * (1 - density(sibling)) >= floor:
                keep.add(id(sibling))
            elif sibling.tag == "p" and ((sibling.size > 80 and density(sibling) < 0.25) or (sibling.links == 0 and sibling.size > 20)):
                keep.add(id(sibling))
            elif sibling.tag in HEADING and density(sibling) < 0.25:
                keep.add(id(sibling))
    kept: set[int] = set()
    for node in nodes:
        if id(node) in keep or (node.parent is not None and id(node.parent) in kept):
            kept.add(id(node))
    return "\n\n".join(text for owner, text, _ in found if id(owner) in kept)


ADDED = {"text": "string", "n_chars": "long"}


def extract_pages(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """Adds text and n_chars to the ``carry`` columns, one row per page.

    A null or empty page has an empty text.  Equal pages give equal rows; nothing is merged; an
    empty table gives no rows.  A carried column with the name of an added one is replaced by it.
    The work on a page is proportional to its length, however it is nested.
    """

    def read(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for begin in range(0, len(texts), 256):
            out = [extract(h) for h in texts.slice(begin, 256).to_pylist()]
            yield begin, begin + len(out), [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    return beside(pages, carry, column, ADDED, read)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
