"""A tolerant HTML reader that keeps what main-text extraction looks at.

Only block-level elements become nodes; inline markup leaves its text to the block around it.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "html", "body", "head", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hgroup", "label", "legend", "li", "main", "menu", "nav", "noscript", "ol", "optgroup", "option",
    "p", "pre", "section", "select", "summary", "svg", "table", "tbody", "td", "template", "tfoot", "th", "thead", "tr", "ul",
}
#: What an element's start closes, up to the nearest of the elements that end the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NO_P_END = {"html", "body", "head", "td", "th", "tr", "li", "label", "button", "option"}


class Node:
    __slots__ = ("tag", "parent", "depth", "words", "texts", "links", "tags", "children", "place")

    def __init__(self, tag: str, parent: int, depth: int, words: tuple, place: int):
        self.tag, self.parent, self.depth, self.words, self.place = tag, parent, depth, words, place
        self.texts = self.links = self.tags = 0
        self.children: list[int] = []


def name_words(attributes: str) -> tuple:
    """The words of the element's class, id and role."""
    if not attributes or "=" not in attributes:
        return ()
    found = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    return tuple(w.lower() for w in WORDS.findall(found))


def read(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes, outer ones first, and text blocks (node, text) in page order."""
    nodes = [Node("", -1, 0, (), 0)]
    blocks: list[tuple[int, str]] = []
    stack = [0]
    pieces: list[str] = []
    linked = in_link = 0

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = nodes[stack[-1]]
                node.texts += len(text)
                node.links += min(linked, len(text))
                blocks.append((stack[-1], text))
            pieces, linked = [], 0

    def add(text: str):
        nonlocal linked
        if "&" in text:
            text = unescape(text)
        pieces.append(text)
        if in_link:
            linked += len(text)

    at, end = 0, len(html)
    lowered = None
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if nodes[stack[k]].tag == tag:
                        flush()
                        del stack[k:]
                        in_link = 0
                        break
                else:
                    if tag == "p":
                        flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                if lowered is None:
                    lowered = html.lower() if len(html.lower()) == len(html) else html
                stop = lowered.find(f"</{tag}", at)
                close = html.find(">", stop) if stop >= 0 else -1
                at = close + 1 if close >= 0 else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag == "a":
            in_link = 1
            nodes[stack[-1]].tags += 1
            continue
        if tag not in BLOCKS:
            if tag == "hr":
                flush()
            nodes[stack[-1]].tags += 1
            continue
        flush()
        in_link = 0
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                own = nodes[stack[k]].tag
                if own in until:
                    break
                if own in closed:
                    del stack[k:]
                    if tag != "tr":
                        break
        elif nodes[stack[-1]].tag == "p" and tag not in NO_P_END:
            stack.pop()
        parent = stack[-1]
        nodes.append(Node(tag, parent, len(stack), name_words(m[3]), len(nodes)))
        nodes[parent].children.append(len(nodes) - 1)
        nodes[parent].tags += 1
        if not m[3].endswith("/") or tag != "svg":
            stack.append(len(nodes) - 1)
    flush()
    return nodes, blocks
