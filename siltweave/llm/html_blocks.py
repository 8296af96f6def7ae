"""A one-pass reader that turns an HTML page into flat text blocks.

Browsers' habits that matter for text are kept: raw elements hold no markup, a block start ends
an open paragraph, an item ends the item before it, stray end tags are ignored, and what is never
shown (scripts, styles, noscript, comments) is skipped. Only a caller that asks for notices gets the
text of noscript elements, as blocks of their own.
"""

from __future__ import annotations

import re
from html import unescape

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|head)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINERS = {"div", "section", "article", "main", "aside", "nav", "header", "footer", "body", "table", "tr", "td", "th", "ul", "ol", "dl", "form", "center", "fieldset", "figure", "details", "tbody", "thead", "tfoot", "html"}
#: What owns the text in it.
_OWNERS = _HEADINGS | {"p", "li", "pre", "blockquote", "dt", "dd", "figcaption", "caption", "button", "summary", "address", "label"}
_BLOCK = _CONTAINERS | _OWNERS | {"hr"}
_KIND = {"p": "p", "li": "li", "pre": "pre", "blockquote": "quote", "caption": "cell", "button": "control", "label": "control", "dt": "p", "dd": "p", "address": "p", "figcaption": "caption", "summary": "p"} | dict.fromkeys(_HEADINGS, "heading")


class Node:
    """A container: its place in the tree and what hangs directly below it."""

    __slots__ = ("at", "parent", "tag", "names", "controls", "depth")

    def __init__(self, at: int, parent: int, tag: str, names: str, depth: int):
        self.at, self.parent, self.tag, self.names, self.depth, self.controls = at, parent, tag, names, depth, 0


class Block:
    """A run of text with one owner; ``linked`` counts its characters inside links."""

    __slots__ = ("kind", "parts", "node", "linked", "text", "tag")

    def __init__(self, kind: str, node: int, tag: str):
        self.kind, self.node, self.tag, self.parts, self.linked, self.text = kind, node, tag, [], 0, ""

    def whole(self) -> str:
        """The text, that of code with its line breaks and indentation."""
        return "".join(self.parts).strip("\n").rstrip() if self.kind == "pre" else self.text


def read(html: str | None, formulas: bool = False, notices: bool = False) -> tuple[list[Node], list[Block]]:
    """Containers and non-empty blocks of a page in document order.

    With ``formulas`` elements of class ``math`` or ``tex`` become blocks of kind ``formula``, with
    ``notices`` noscript elements blocks of kind ``notice``.
    """
    nodes = [Node(0, -1, "body", "", 0)]
    blocks: list[Block] = []
    if not html:
        return nodes, blocks
    stack: list[tuple[str, int, Block | None]] = []  # an open block's tag, and the container and owner outside of it
    node, owner, linked, here = 0, None, False, 0

    def close(k: int) -> None:
        nonlocal node, owner, linked
        _, node, owner = stack[k]
        if owner is not None and owner.tag in _CONTAINERS and owner.kind == "p":
            owner = None  # loose text ends where a block begins
        linked = False
        del stack[k:]

    for m in _TAG.finditer(html):
        at = m.start()
        if at > here:
            value = html[here:at]
            if owner is None and value.strip():
                tag = nodes[node].tag
                owner = Block("cell" if tag in ("td", "th") else "p", node, tag)
                blocks.append(owner)
            if owner is not None:
                if "&" in value:
                    value = unescape(value)
                owner.parts.append(value)
                if linked:
                    owner.linked += len(value.strip())
        here = m.end()
        tag = m[3]
        if tag is None:
            if notices and m[1] and m[1].lower() == "noscript":
                blocks.append(Block("notice", node, "noscript"))
                blocks[-1].parts.append(unescape(_TAG.sub(" ", m[0][m[0].index(">") + 1 :])))
            continue
        tag = tag.lower()
        if tag not in _BLOCK:
            if m[2]:
                if tag == "a":
                    linked = False
                elif stack and stack[-1][0] == tag:  # an inline formula
                    close(len(stack) - 1)
            elif tag == "a":
                linked = True
            elif tag == "br":
                if owner is not None:
                    owner.parts.append("\n")
            elif tag == "input":
                nodes[node].controls += 1
            elif formulas and tag in ("img", "span", "math"):
                names = _CLASS.search(m[4])
                names = (names[1] or names[2] or names[3] or "").split() if names else []
                if tag == "img" and "tex" in names and (alt := _ALT.search(m[4])):
                    blocks.append(Block("formula", node, tag))
                    blocks[-1].parts.append(unescape(alt[1] or alt[2] or ""))
                elif tag == "math" or tag == "span" and "math" in names:
                    stack.append((tag, node, owner))
                    owner = Block("formula", node, tag)
                    blocks.append(owner)
            continue
        if m[2]:  # the end of a block
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "body", "html"):
                    break
            continue
        # what a new block ends
        for k in range(len(stack) - 1, -1, -1):
            t = stack[k][0]
            if t == "p" or t in _HEADINGS or t == "li" and tag == "li" or t in ("dt", "dd") and tag in ("dt", "dd") or t in ("td", "th") and tag in ("td", "th"):
                close(k)
                break
            if t in ("tr", "td", "th") and tag == "tr":
                if t == "tr":
                    close(k)
                    break
            elif t in _CONTAINERS or t in ("li", "blockquote", "dd", "dt"):
                break
        if tag == "hr":
            continue
        if owner is not None and owner.tag in _CONTAINERS and owner.kind == "p":
            owner = None
        stack.append((tag, node, owner))
        if tag in _OWNERS:
            if tag == "p" and owner is not None and owner.kind in ("li", "quote"):
                owner.parts.append(" ")
            else:
                owner = Block(_KIND[tag], node, tag)
                blocks.append(owner)
                if owner.kind == "control":
                    nodes[node].controls += 1
            continue
        names = " ".join(a or b or c for a, b, c in _CLASS.findall(m[4])).lower() if m[4] else ""
        if formulas and tag == "div" and "math" in names.split():
            owner = Block("formula", node, tag)
            blocks.append(owner)
            continue
        nodes.append(Node(len(nodes), node, tag, names, nodes[node].depth + 1))
        node, owner = len(nodes) - 1, None
    if here < len(html) and html[here:].strip():
        if owner is None:
            owner = Block("p", node, nodes[node].tag)
            blocks.append(owner)
        owner.parts.append(unescape(html[here:]))
    out = []
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
        if b.text:
            out.append(b)
    return nodes, out
