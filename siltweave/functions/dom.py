"""A light document tree and the part of CSS that site rules use.

Selectors: tag, .class, #id, [attr], [attr=v], [attr*=v], [attr^=v], [attr$=v], descendant, child
(>) and comma lists. Compiled selectors are cached for each worker process.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Elements whose closing slash browsers ignore.
_BLOCK_LIKE = frozenset("div span p a b i em strong li ul ol td th tr table section article".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())


class Element:
    """An element, or a text if ``tag`` is empty."""

    __slots__ = ("tag", "attrs", "children", "parent", "text")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Element | None = None, text: str = ""):
        self.tag, self.attrs, self.parent, self.text = tag, attrs or {}, parent, text
        self.children: list[Element] = []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        """The elements below this one in document order."""
        stack = list(reversed(self.children))
        while stack:
            e = stack.pop()
            if e.tag:
                yield e
                stack.extend(reversed(e.children))

    def all_text(self) -> str:
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if e.tag:
                stack.extend(reversed(e.children))
            else:
                out.append(e.text)
        return "".join(out)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def find(self, selector: str) -> Iterator[Element]:
        """The elements below this one that a selector fits, in document order."""
        by_tag, by_class, by_id, rest = indexed(selector)
        for e in self.walk():
            rules = by_tag.get(e.tag, ())
            if e.attrs:
                if by_class and (names := e.attrs.get("class")):
                    for c in names.split():
                        rules = (*rules, *by_class.get(c, ()))
                if by_id and (name := e.attrs.get("id")):
                    rules = (*rules, *by_id.get(name, ()))
                rules = (*rules, *rest) if rest else rules
            if rules and any(matches(e, r) for r in rules):
                yield e

    def select(self, selector: str) -> list[Element]:
        return list(self.find(selector))

    def first(self, selector: str) -> Element | None:
        return next(self.find(selector), None)


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea|title|xmp|noembed)\b((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>(.*?)(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        value = a or b or c
        out.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return out


def parse(html: str | None) -> Element:
    """The tree of a document; malformed markup never fails."""
    root = at = Element("#root")
    if not html:
        return root

    def left(tag: str, barrier: tuple[str, ...]) -> Element:
        """Where one stands once an open ``tag`` is closed, unless a barrier is in between."""
        e = at
        while e is not root and e.tag != tag:
            if e.tag in barrier:
                return at
            e = e.parent
        return at if e is root else e.parent

    here = 0
    for m in _TOKEN.finditer(html):
        if m.start() > here:
            text = html[here : m.start()]
            at.children.append(Element("", None, at, unescape(text) if "&" in text else text))
        here = m.end()
        tag = m[5]
        if tag is None:
            if m[1]:  # an element whose content is text
                e = Element(m[1].lower(), _attributes(m[2]) if m[2] else None, at)
                if m[3]:
                    e.children.append(Element("", None, e, unescape(m[3]) if e.tag in ("title", "textarea") else m[3]))
                at.children.append(e)
            continue
        tag = tag.lower()
        if m[4]:
            e = at
            while e is not root and e.tag != tag:
                e = e.parent
            if e is not root:
                at = e.parent
            continue
        if tag in _ENDS_P:
            at = left("p", ("td", "th", "li", "div"))
        if tag in _CLOSES:
            for t in _CLOSES[tag]:
                at = left(t, _BARRIER[tag])
        e = Element(tag, _attributes(m[6]) if m[6] else None, at)
        at.children.append(e)
        if tag not in VOID and not (m[6] and m[6].endswith("/") and tag not in _BLOCK_LIKE):
            at = e
    if here < len(html):
        at.children.append(Element("", None, at, unescape(html[here:])))
    return root


_PART = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]")


@lru_cache(maxsize=1024)
def compiled(selector: str) -> tuple:
    """A comma list as chains of (combinator, tests), rightmost step last; raises on other syntax."""
    rules = []
    for one in selector.split(","):
        chain, child = [], False
        for token in re.sub(r"\s*>\s*", " > ", one).split():
            if token == ">":
                child = True
                continue
            tests, here = [], 0
            for m in _PART.finditer(token):
                if m.start() != here:
                    break
                here = m.end()
                if m[1]:
                    tests.append(("tag", m[1].lower(), ""))
                elif m[2]:
                    tests.append(("class", m[2], ""))
                elif m[3]:
                    tests.append(("id", m[3], ""))
                else:
                    tests.append((m[5] or "has", m[4].lower(), m[6] or ""))
            if here != len(token):
                raise ValueError(f"selector not supported: {selector}")
            chain.append((child, tuple(tests)))
            child = False
        if chain:
            rules.append(tuple(chain))
    return tuple(rules)


@lru_cache(maxsize=1024)
def indexed(selector: str) -> tuple[dict, dict, dict, tuple]:
    """The rules of a selector by what their last step must have: class, id, tag, or another attribute."""
    by_tag, by_class, by_id, rest = {}, {}, {}, []
    for rule in compiled(selector):
        tests = {kind: name for kind, name, _ in rule[-1][1]}
        for kind, index in (("id", by_id), ("class", by_class), ("tag", by_tag)):
            if kind in tests and tests[kind] != "*":
                index.setdefault(tests[kind], []).append(rule)
                break
        else:
            if "tag" in tests:
                raise ValueError("'*' needs a further test in the last step")
            rest.append(rule)
    return by_tag, by_class, by_id, tuple(rest)


def _fits(e: Element, tests: tuple) -> bool:
    for kind, name, value in tests:
        if kind == "tag":
            if name not in ("*", e.tag):
                return False
        elif kind == "class":
            if name not in e.classes:
                return False
        elif kind == "id":
            if e.attrs.get("id") != name:
                return False
        else:
            v = e.attrs.get(name)
            if v is None or kind == "=" and v != value or kind == "*=" and value not in v or kind == "^=" and not v.startswith(value) or kind == "$=" and not v.endswith(value):
                return False
    return True


def matches(e: Element, chain: tuple) -> bool:
    """Whether an element is what a chain of steps ends in."""

    def back(e: Element | None, k: int, child: bool) -> bool:
        while e is not None and e.tag != "#root":
            if _fits(e, chain[k][1]) and (k == 0 or back(e.parent, k - 1, chain[k][0])):
                return True
            if child:
                return False
            e = e.parent
        return False

    return _fits(e, chain[-1][1]) and (len(chain) == 1 or back(e.parent, len(chain) - 2, chain[-1][0]))
