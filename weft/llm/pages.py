"""Pages as trees of text blocks: a tolerant parser for the markup of real pages."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from urllib.parse import urlsplit

_HIDDEN = re.compile(r"<(?:!--.*?-->|(script|style|title|noscript|iframe|template|svg|textarea)\b[^>]*>.*?</\1\s*>|!--.*\Z|(?:script|style)\b[^>]*>.*\Z)", re.S | re.I)
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9]*)|[!?])[^>]*>")
_WORDS = re.compile(r"[^<]+|<")

#: Tags that stay within a block, and tags that are no elements with content.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track".split())
#: Tags that end where the next block begins, if they are not closed.
LEAFISH = frozenset("p li h1 h2 h3 h4 h5 h6 span button dt dd option label caption".split())
SCOPE = {"td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",)}

_LINK, _INLINE, _VOID, _BREAK, _BLOCK = range(5)
_KINDS = {None: _INLINE} | dict.fromkeys(INLINE, _INLINE) | dict.fromkeys(VOID, _VOID) | {"a": _LINK, "br": _BREAK, "hr": _BREAK}


@dataclass(slots=True)
class Node:
    """An element with several children, or a block of text (``block`` >= 0)."""

    tag: str
    parent: int
    block: int = -1
    text: str = ""
    linked: int = 0
    zones: tuple = ()
    children: list = field(default_factory=list)


def site_name(url: str | None) -> str:
    """The label before the top-level domain of a URL's host, in lower case."""
    parts = (urlsplit(url).hostname or "").split(".") if url else []
    return parts[-2].lower() if len(parts) > 1 else parts[0].lower() if parts else ""


def title_of(page: str) -> str:
    m = _TITLE.search(page)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def parse(page: str) -> list[Node]:
    """The tree of a page: node 0 is the root; blocks carry their number in page order, from 0.

    A block is the text between two tags that are not inline; its tag is that of the innermost open element that is not
    inline. ``linked`` counts its characters inside links, ``zones`` holds the open elements' tags. Elements without text
    are left out, and elements with a single child are replaced by it. An empty page has the root alone.
    """
    tags, parents, texts, links, zones = ["#root"], [-1], [""], [0], [()]
    stack, open_tags, zone = [0], [], ()
    text: list[str] = []
    linked = link = 0

    # Words, then whether the tag after them closes, and its name.
    parts = [*_TAG.split(_HIDDEN.sub(" ", page)), "", "#end"]
    for words, close, tag in zip(parts[::3], parts[1::3], parts[2::3]):
        if words and (text or not words.isspace()):
            for t in _WORDS.findall(words) if "<" in words else (words,):
                if "&" in t:
                    t = html.unescape(t)
                text.append(t)
                if link:
                    linked += len(t.strip())
        kind = _KINDS.get(tag)
        if kind is None:
            tag = tag.lower()
            kind = _KINDS.get(tag, _BLOCK)
        if kind == _LINK:
            link = 0 if close else 1
            continue
        if kind == _INLINE:
            continue
        if kind == _BREAK:
            text.append(" ")
            continue
        if kind == _VOID:
            continue
        if text:
            t = " ".join("".join(text).split())
            if t:
                top = stack[-1]
                tags.append(tags[top])
                parents.append(top)
                texts.append(t)
                links.append(linked)
                if zone is None:
                    zone = tuple(open_tags)
                zones.append(zone)
            text.clear()
        linked = link = 0
        if close:
            if tag in open_tags:
                at = len(open_tags) - 1
                while open_tags[at] != tag:
                    at -= 1
                del stack[at + 1 :], open_tags[at:]
                zone = None
            continue
        while open_tags and open_tags[-1] in LEAFISH:
            stack.pop()
            open_tags.pop()
        if tag in SCOPE:
            for at in range(len(open_tags) - 1, -1, -1):
                if open_tags[at] == tag:
                    del stack[at + 1 :], open_tags[at:]
                    break
                if open_tags[at] in SCOPE[tag]:
                    break
        stack.append(len(tags))
        open_tags.append(tag)
        zone = None
        parents.append(stack[-2])
        tags.append(tag)
        texts.append("")
        links.append(0)
        zones.append(())

    # A subtree is one run of nodes, so what stays keeps its order.
    kept = [0] * len(tags)
    for i in range(len(tags) - 1, 0, -1):
        if texts[i] or kept[i]:
            kept[parents[i]] += 1
    out, new, blocks = [Node("#root", -1)], [0] * len(tags), 0
    for i in range(1, len(tags)):
        above = new[parents[i]]
        if texts[i]:
            out[above].children.append(len(out))
            out.append(Node(tags[i], above, blocks, texts[i], links[i], zones[i]))
            blocks += 1
        elif kept[i] > 1:
            new[i] = len(out)
            out[above].children.append(len(out))
            out.append(Node(tags[i], above))
        else:
            new[i] = above
    return out
