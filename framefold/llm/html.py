"""Main text of web pages by tree scoring.

A page becomes a tree; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
go, by element, role, and words in class or id that name one of these, but for a form or container that holds most of
the text.  Words that only tell a place or may belong to an article (left, top, an alert-story) remove nothing.  Then
every paragraph passes points to its ancestors: one, one more for each comma and for each hundred characters up to
three; the parent gets all of them, the grandparent half, those above (LEVELS at most) a third by level.  A
container's points are discounted by its link density (the share of its text inside links) and weighed by its name:
a half more at most, or a half less.  The container with the most points is the article; it is taken with those
siblings that have a fifth of its points or are long paragraphs with few links.

Blocks are the texts of block elements, in page order.  Character references are decoded, white space in a
block becomes one space, and blocks are joined by an empty line.

Defined cases: null or empty html gives an empty text; a page without any paragraph gives the texts of its
body; markup that is cut off is read as far as it goes; a very long page is read whole, in a pass over its tags and
some over its tree; of containers with equal points the first in page order is taken; a missing url or page_id stays
null; equal rows and page_ids are extracted each; an empty table gives an empty result; other columns aren't read, so
their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefold.llm.common import sliced

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h2 h3 h4 h5 h6 div section article main body".split())
DROPPED = frozenset("nav aside footer form button select input textarea script style noscript template iframe object embed svg canvas audio video dialog menu head title label map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A group of these is a form's.
FIELDS = frozenset("input select textarea button".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())
#: An opening tag ends an open element of these names, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class or id of what isn't the article.
UNLIKELY = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|adsense|adbox|banner|sponsor(?:ed|s)?|promo(?:tion)?s?|cookies?|consent|gdpr|notices?|alerts|alert-?(?:box|bar|message|banner|info|warning|danger|success|dismissible)|popup|modal|overlay|toast|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|follow|comments?|comment-?list|replies|responses|discussion|disqus|respond|related|recommended|recommendations|more-?stories|trending|popular|outbrain|taboola|sidebar|side-?bar|widgets?|rail|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|paging|footer|foot|masthead|site-?header|page-?header|topbar|toolbar|skip-?link|tag-?list|tag-?cloud|tags(?=$| )|meta-?data|copyright|disclaimer|paywall|hidden|sr-only|visually-?hidden)(?:$|[^a-z])"
)
#: Whole classes or ids of what isn't the article, though they occur inside the names of what is.
ALONE = frozenset("header hdr meta teaser teasers announcement warning alert legal tag".split())
#: Whole classes or ids that tell a place, where the article seldom stands.
PLACES = frozenset("top bottom left right".split())
#: Parts of names that tell what stands beside or isn't there.
BESIDE = re.compile(r"(?<![a-z])(?:has|no|with|without|hide|show|is|js)-[a-z-]+")
LIKELY = re.compile(r"(?:^|[^a-z])(?:article|body|content|entry|main|page|post|story|text|blog|column)(?:$|[^a-z])")
#: Words in class or id of what readers say, which may be longer than the article.
TALK = re.compile(r"(?:^|[^a-z])(?:comments?|comment-?list|replies|responses|discussion|disqus|respond)(?:$|[^a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: A form or container of an unlikely name that holds more of the page's text than this may be the article's; with
#: less than FEW of it left, names say nothing.
MOST, FEW = 0.5, 0.1
#: Ancestors above the parent that a paragraph's points reach.
LEVELS = 6

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?=[\s=/>]|$)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "size", "linked")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.linked = 0  # characters of text, and those inside links


def parsed(html: str) -> Node:
    """The tree of a page; text nodes are decoded strings."""
    root = here = Node("html", {}, None)
    at, end = 0, len(html)
    opened: Counter[str] = Counter()  # open elements by name, so that stray tags cost no walk

    def leave(to: Node | None) -> None:
        """Closes the open elements below `to`."""
        nonlocal here
        while here is not to and here.parent:
            opened[here.tag] -= 1
            here = here.parent

    while at < end:
        m = _TAG.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            here.children.append(unescape(html[at:stop]))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if opened[tag]:
                up = here
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            elif tag in ("p", "br"):
                here.children.append(" ")
            continue
        if tag == "html":
            continue
        text = m[3] if m[2] else m[6]
        attrs = {k.lower(): (a or b or c or "").lower() for k, a, b, c in _ATTR.findall(text)} if text else {}
        if tag in ENDS and any(opened[x] for x in ENDS[tag][0]):
            closes, within = ENDS[tag]
            up, to = here, None
            while up and up.tag not in within:
                if up.tag in closes:
                    to = up.parent
                up = up.parent
            if to:
                leave(to)
        if tag in BLOCK and opened["p"]:
            up = here
            while up and up.tag not in ("div", "section", "article", "td", "th", "li", "body", "main", "blockquote", "table"):
                if up.tag == "p":
                    leave(up.parent)
                    break
                up = up.parent
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            if not close:
                break
            after = html.find(">", close.end())
            at = end if after < 0 else after + 1
        elif tag not in VOID and not (text and text.endswith("/") and tag not in BLOCK):
            here = node
            opened[tag] += 1
    return root


def dropped(node: Node, by_name: bool = True) -> bool:
    """Whether an element can't be of the article, by element and role, and by words in class and id."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if tag == "fieldset" and any(x.tag in FIELDS for x in in_order(node)):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in DROPPED_ROLES or HIDDEN.search(attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main", "p") or tag in HEADINGS or tag == "article" and "comment" not in attrs.get("class", "") + attrs.get("id", ""):
        return False
    if not by_name:
        return False
    names = BESIDE.sub("", f"{attrs.get('class', '')} {attrs.get('id', '')}".replace("_", "-"))
    return bool(UNLIKELY.search(names)) and not (tag == "section" and "article" in names) or not ALONE.isdisjoint(names.split())


def names_of(node: Node) -> str:
    return BESIDE.sub("", f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".replace("_", "-")) if node.attrs else ""


def weighed(root: Node) -> None:
    """Sets size: characters of text outside links, comments and what can't be of the article by element or role."""
    nodes: list[Node] = []
    stack = [root]
    while stack:
        one = stack.pop()
        nodes.append(one)
        stack.extend(x for x in one.children if not isinstance(x, str) and x.tag != "a" and not (dropped(x, False) and x.tag != "form") and not TALK.search(names_of(x)))
    for node in reversed(nodes):
        node.size += sum(len(x.strip()) for x in node.children if isinstance(x, str))
        if node.parent:
            node.parent.size += node.size


def holds(node: Node, least: float) -> bool:
    """Whether a form, or a container whose name also tells of an article or that has one inside, holds `least` characters or more."""
    if node.size <= least or dropped(node, False) and (node.tag != "form" or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or HIDDEN.search(node.attrs.get("style", ""))):
        return False
    return node.tag == "form" or bool(LIKELY.search(names_of(node))) or any(x.tag in ("article", "main") for x in in_order(node))


def pruned(node: Node, by_name: bool = True, talk: bool = True) -> int:
    """Removes what can't be of the article; of a header, its headings stay if it stands in an article.

    A form, or a container by its name, stays if it holds most of the page's text.  Without talk, comments go in any case.  The result is how much text the page had, as weighed().
    """
    weighed(node)
    most = MOST * node.size
    stack: list[tuple[Node, bool, bool]] = [(node, False, False)]
    while stack:
        one, inside, header = stack.pop()
        kept: list[Node | str] = []
        for child in one.children:
            if isinstance(child, str):
                if not header:
                    kept.append(child)
            elif dropped(child, by_name) and not holds(child, most) or not talk and child.tag in BLOCK and TALK.search(names_of(child)) or (child.tag in ("header", "hgroup") and not inside):
                kept.append(" ")
            else:
                heading = child.tag in HEADINGS
                below = (header or child.tag == "header") and not heading
                stack.append((child, inside or child.tag in ("article", "main"), below))
                kept.append(child)
        one.children = kept
    return node.size


def in_order(node: Node) -> Iterator[Node]:
    """All elements, parents first."""
    stack = [node]
    while stack:
        one = stack.pop()
        yield one
        stack.extend(x for x in reversed(one.children) if not isinstance(x, str))


def weight(node: Node) -> float:
    """What a container's points are multiplied by, from its element and name."""
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}" if node.attrs else ""
    likely = node.tag in ("article", "main") or bool(LIKELY.search(names))
    return (1.5 if likely else 1.0) * (0.5 if node.tag == "form" or not PLACES.isdisjoint(names.split()) else 1.0)


def scored(root: Node) -> Node | None:
    """Sets size, linked and points; the best container, or None without any text."""
    nodes = list(in_order(root))
    for node in nodes:
        node.size = 0
    direct: dict[int, list[str]] = {}
    for node in reversed(nodes):
        own = [x for x in node.children if isinstance(x, str)]
        node.size += sum(len(x.strip()) for x in own)
        if node.tag == "a":
            node.linked = node.size
        if node.parent:
            node.parent.size += node.size
            node.parent.linked += node.linked
        # Text that stands in this block, with that of its inline children.
        texts = direct.setdefault(id(node), [])
        texts += own
        if node.parent and node.tag not in BLOCK:
            direct.setdefault(id(node.parent), []).extend(texts)
    for node in nodes:
        if node.tag not in PARAGRAPH:
            continue
        text = "".join(direct[id(node)]).strip()
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(3.0, len(text) / 100)
        if len(text) < 25:
            points /= 4
        up, level = (node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") or node.tag in HEADINGS else node), 0
        while up and level <= LEVELS:
            up.points += points if not level else points / 2 if level == 1 else points / (3 * level)
            up, level = up.parent, level + 1
    best = None
    for node in nodes:
        if not node.points:
            continue
        node.points *= weight(node) * (1 - node.linked / max(node.size, 1))
        if node.tag not in ("html", "ul", "ol", "table", "tbody", "tr", "p") and (best is None or node.points > best.points):
            best = node
    return best or (root if root.size else None)


def chosen(best: Node) -> list[Node]:
    """The best container, in its article if it stands in one, and the siblings that belong to it."""
    up = best
    while up.parent:
        up = up.parent
        if up.tag == "article":
            best = up
    if best.tag in ("article", "main", "body") or not best.parent:
        return [best]
    out = []
    for x in best.parent.children:
        if isinstance(x, str):
            continue
        few = x.linked < 0.25 * max(x.size, 1)
        if x is best or x.tag == "h1" or few and (x.points >= 0.2 * best.points or x.tag == "p" and x.size > 80):
            out.append(x)
    return out


def blocks(node: Node) -> Iterator[str]:
    """The texts of the blocks below node, in page order."""
    text: list[str] = []
    stack: list[Node | str | None] = [node]  # None: a block ends
    while stack:
        one = stack.pop()
        if isinstance(one, str):
            text.append(one)
            continue
        if one is None or one.tag in BLOCK:
            if made := " ".join("".join(text).split()):
                yield made
            text = []
            if one is None:
                continue
            stack.append(None)
        elif one.tag in ("br", "td", "th", "img"):
            text.append(" ")
        stack.extend(reversed(one.children))
    if made := " ".join("".join(text).split()):
        yield made


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parsed(html)
    whole = pruned(root)
    best = scored(root)
    for talk in (False, True):  # what the page has is named like something else
        if not best or root.size < FEW * whole:
            root = parsed(html)
            pruned(root, by_name=False, talk=talk)
            best = scored(root) or best
    return "\n\n".join(x for node in chosen(best) for x in blocks(node)) if best else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
