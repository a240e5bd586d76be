"""A tolerant HTML parser that keeps what text extraction needs.

The tree has block elements only. Text of inline elements belongs to the block
around them, the share of it inside links is counted, and ``<br>`` is white space. An element that is
boilerplate by its name, role, class or id is marked, inline ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary svg table "
    "tbody td template tfoot th thead tr ul video audio canvas object script style textarea title xmp noembed noframes".split()
)
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body button caption frameset head html iframe legend noscript option optgroup select svg template video audio canvas object script style textarea title".split())
#: An open element (key) ended by these start tags.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot", "thead"}, "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"},
}
#: Where the search for such an open element stops.
SCOPE = frozenset("ul ol dl table select article section main body div td th aside nav header footer blockquote form".split())

# What is never article text.
JUNK_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form menu dialog button select textarea iframe svg canvas object video audio noembed noframes xmp".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
JUNK_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer header masthead cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup "
    "share sharing social related recommended comments comment commentlist respond disqus popup modal overlay toolbar widget widgets skip".split()
)
#: Words that make a class or id speak of a layout around such parts, not of one.
LAYOUT_WORDS = frozenset("has with no without layout".split())
CONTENT_WORDS, BOX_WORDS = frozenset("article content main".split()), frozenset("box container grid layout row wrap wrapper".split())
#: Elements that no class or id makes boilerplate.
NEVER_JUNK = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(?=/?[a-zA-Z])[^>]*+(?:>|\Z)", re.S
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


#: Blocks nested deeper have their text in the block above, between marks that end lines; boilerplate stays apart.
DEPTH = 150
_ENDERS = frozenset().union(*ENDS.values())


class Node:
    """An element; ``parts`` has texts (text, in a link) and elements in order."""

    __slots__ = ("inline", "junk", "label", "parts", "tag")

    def __init__(self, tag: str, label: str, junk: bool, inline: bool):
        self.tag, self.label, self.junk, self.inline = tag, label, junk, inline
        self.parts: list[Node | tuple[str, bool]] = []


def _speaks_of_junk(name: str) -> bool:
    """Whether a class or id, in whatever way its words are joined, names boilerplate."""
    words = {w.lower() for w in _WORDS.findall(name)}
    if not words & JUNK_WORDS or words & LAYOUT_WORDS:
        return False
    return not (words & CONTENT_WORDS and words & BOX_WORDS)


def _traits(tag: str, attrs: str) -> tuple[str, bool]:
    """The label that alignment compares, and whether the element is boilerplate."""
    label, junk = tag, tag in JUNK_TAGS
    if attrs and not attrs.isspace():
        names: list[str] = []
        for m in _ATTR.finditer(attrs):
            name, raw = m[1].lower(), (m[2] or "").strip("\"'")
            value = raw.lower()
            if name in ("class", "id"):
                names += raw.split()
            elif name == "role":
                junk |= value in JUNK_ROLES
                label += f"@{value}"
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                junk = True
        junk |= tag not in NEVER_JUNK and any(map(_speaks_of_junk, names))
        if names:
            label += "." + ".".join(sorted({re.sub(r"\d+", "0", n) for n in names}))
    return label, junk


def parse(html: str) -> Node:
    root = Node("", "", False, False)
    stack = [root]
    tags = [""]
    open_tags = Counter(tags)
    links = 0
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append((unescape(piece) if "&" in piece else piece, links > 0))

    def close(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t in tags[k:])
        open_tags.subtract(tags[k:])
        deep = len(tags) > DEPTH and any(t in BLOCK for t in tags[max(k, DEPTH):])
        del tags[k:]
        del stack[k:]
        if deep:
            stack[-1].parts.append(Node("", "", False, False))

    def last(tag: str) -> int:
        return next(k for k in range(len(tags) - 1, -1, -1) if tags[k] == tag)

    for m in iter(lambda: _TOKEN.search(html, at), None):
        text(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "br":
                text(" ")
            elif open_tags[tag]:
                k = last(tag)
                # An inline end tag does not reach out of its block.
                if tag in BLOCK or not any(t in BLOCK for t in tags[k:]):
                    close(k)
            continue
        if tag in ENDS_P and open_tags["p"]:
            k = last("p")
            if not any(t in SCOPE for t in tags[k:]):
                close(k)
        for k in range(len(tags) - 1, 0, -1) if tag in _ENDERS else ():
            if tag in ENDS.get(tags[k], ()):
                close(k)
            elif tags[k] in SCOPE:
                break
        block = tag in BLOCK
        if tag == "br" or (tag in VOID and not block):
            if tag == "br":
                text(" ")
            continue
        label, junk = _traits(tag, m["attrs"]) if block or m["attrs"] else (tag, tag in JUNK_TAGS)
        node = stack[-1]
        if block or junk:
            node = Node(tag, label, junk, not block)
            stack[-1].parts.append(node)
        if tag in VOID or (m["attrs"].endswith("/") and tag == "svg"):
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        if len(stack) > DEPTH and (not junk or stack[-1].junk):
            node = stack[-1]
        tags.append(tag)
        open_tags[tag] += 1
        stack.append(node)
        links += tag == "a"
    text(html[at:])
    return root


def blocks(nodes: list[Node], skip=lambda node, path: False) -> list[str]:
    """The texts of the blocks below ``nodes``, white space made single spaces.

    Boilerplate and what ``skip`` names goes. A heading in a header inside an article stays.
    """
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    def walk(node: Node, path: tuple[str, ...], heading_only: bool) -> None:
        for x in node.parts:
            if isinstance(x, tuple):
                if not heading_only:
                    held.append(x[0])
                continue
            below = (*path, x.label)
            if not x.inline:
                flush()
            heading = re.fullmatch("h[1-6]|hgroup", x.tag) is not None
            if x.tag == "header" and "article" in (p.split(".")[0].split("@")[0] for p in path):
                walk(x, below, True)
            elif not x.junk and not skip(x, below):
                walk(x, below, heading_only and not heading)
            if not x.inline:
                flush()

    for node in nodes:
        walk(node, (node.label,), False)
        flush()
    return out
