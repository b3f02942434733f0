"""Text blocks of an HTML page, each with its place: inside the article, elsewhere, or in a part that is no content.

One scan over tags, comments and text; unclosed, stray and cut-off tags are taken as browsers take them where that matters for
blocks: a tag without an end runs to the end of the page, an end tag closes up to its start tag, a new paragraph ends the last.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Content that is text for the scanner up to its end tag, and never page text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of the article.
OUTSIDE = frozenset(
    "head nav footer aside form menu dialog button select option optgroup datalist object canvas audio video applet map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split())  # fmt: skip
CELLS = frozenset(("td", "th", "br"))
#: Start tags that end an open element of the same group.
ENDS = {"p": BLOCKS - {"html", "body", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
        "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar status tablist tooltip".split())
#: Words in class and id that tell what is around an article.
AROUND = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion sidebar sidebars sidenav "
    "menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs footer footers foot masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices notification notifications alert popup popups modal overlay lightbox newsletter subscribe subscription signup signin login "
    "share sharing social related recommended recommendations comment comments commentlist discussion respond replies reply disqus widget "
    "widgets pagination pager paging copyright disclaimer banner banners paywall search form forms skip skiplink outbrain taboola".split())  # fmt: skip
HEADERS = frozenset(("header", "headers", "head"))
BODIES = frozenset(("article", "articlebody", "story", "post", "entry", "content", "maincontent", "main"))
#: How sure it is that a block belongs to the article: an article element, a main element, a name, or nothing.
ARTICLE, MAIN, NAMED, OPEN = 0, 1, 2, 3


class Block(NamedTuple):
    text: str
    tier: int
    linked: int  # characters inside links


class _Node:
    __slots__ = ("name", "parent", "out", "maybe_out", "tier", "holds")

    def __init__(self, name: str, parent: _Node | None) -> None:
        self.name, self.parent = name, parent
        self.out = parent.out if parent else False
        self.maybe_out = False  # by name alone: taken back where the element holds the article
        self.tier = parent.tier if parent else OPEN
        self.holds = False

    def outside(self) -> bool:
        node: _Node | None = self
        if self.out:
            return True
        while node is not None:
            if node.maybe_out and not node.holds:
                return True
            node = node.parent
        return False


def _open(name: str, attributes: str, parent: _Node) -> _Node:
    node = _Node(name, parent)
    if name in OUTSIDE or name == "header" and parent.tier > MAIN or name == "article" and parent.tier == ARTICLE:
        node.out = True
    if node.out:
        return node
    tier = OPEN
    if name == "article":
        tier = ARTICLE
    elif name == "main":
        tier = MAIN
    if attributes.strip(" /"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        style = found.get("style", "").lower().replace(" ", "")
        if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
            node.out = True
            return node
        if role == "main":
            tier = min(tier, MAIN)
        if "articlebody" in found.get("itemprop", "").lower():
            tier = ARTICLE
        if name not in ("html", "body", "article", "main") and ("class" in found or "id" in found):
            names = {w.lower() for w in NAME.findall(f"{found.get('class', '')} {found.get('id', '')}")}
            if tier > MAIN and (names & AROUND or names & HEADERS and parent.tier > MAIN):
                node.maybe_out = True
            elif names & BODIES:
                tier = min(tier, NAMED)
        elif name == "article" and "class" in found and {w.lower() for w in NAME.findall(found["class"])} & AROUND:
            node.out = True  # a comment, a teaser
            return node
    if tier < parent.tier:
        node.tier = tier
        if tier <= MAIN:
            up: _Node | None = parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    return node


def page_blocks(page: str | None) -> list[Block]:
    """Blocks with text outside menus, forms, scripts and the like, in page order; white space is one space.

    Only the blocks of the surest tier that has any are the article's; all are returned with their tier.
    """
    page = page or ""
    top = node = _Node("", None)
    found: list[tuple[_Node, list[str], int]] = []
    pieces: list[str] = []
    linked = at = 0
    in_link = False

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not node.out:
            pieces.append(piece)
            if in_link:
                linked += len(piece)

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            found.append((node, pieces, linked))
            pieces, linked = [], 0

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if not m[1]:
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name in BLOCKS:
                flush()
                closes = node
                while closes is not top and name in ENDS.get(closes.name, ()):
                    closes = closes.parent  # type: ignore[assignment]
                if closes is not node:
                    node = closes
            elif name in CELLS:
                text(" ")
            if name == "a":
                in_link = True
            if name not in VOID and (name in BLOCKS or name in OUTSIDE or m[3].strip(" /")) and name != "a":
                node = _open(name, m[3], node)
        else:
            if name == "a":
                in_link = False
            if name in BLOCKS:
                flush()
            elif name in CELLS:
                text(" ")
            closes = node
            while closes is not top and closes.name != name:
                closes = closes.parent  # type: ignore[assignment]
            if closes is not top:
                if name not in BLOCKS and closes is not node and any(n.name in BLOCKS for n in _between(node, closes)):
                    continue  # an inline end tag does not close blocks
                node = closes.parent or top
    text(page[at:])
    flush()
    out = []
    for place, parts, own_linked in found:
        joined = " ".join(html.unescape("".join(parts)).split())
        if joined and not place.outside():
            out.append(Block(joined, place.tier, own_linked))
    return out


def _between(node: _Node, ancestor: _Node) -> list[_Node]:
    out = []
    while node is not ancestor and node.parent is not None:
        out.append(node)
        node = node.parent
    return out
