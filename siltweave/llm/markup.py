"""Problem 2: clean text, with its headings, list items, code and formulas, from marked-up documents.

A document (wikitext, an HTML fragment, or converted text in which Markdown, HTML, wiki and LaTeX
mix) is read into segments by form alone: one a line or DOM block, code and formulas being segments of
their own, and also the lines of templates, rows of tables, frames of lists, rules and page links. They are then
labelled content or residue by a minimum cut. A linear classifier, fitted on the labelled table of
:mod:`siltweave.llm.labelled_segments`, gives each segment its costs, which are the terminal capacities;
smoothness edges tie neighbouring segments, the more the nearer they hang in the DOM (in wikitext and
converted text: in the same template, table, list or section), and the segments of one construct. Content
segments give the clean text and the elements.

Everything happens in one Arrow pass without a shuffle.

Defined results: null and empty documents give nothing; unclosed fences, tags and templates run to
the document's end or are taken as text; equal elements of a document are reported once; repeated
rows repeat; very long documents are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.llm import labelled_segments
from siltweave.llm.html_blocks import read
from siltweave.llm.labelled_lines import leaning, weights
from siltweave.llm.mincut import label
from siltweave.llm.words import HAN
from siltweave.session import spread

ELEMENTS = ("heading", "list_item", "code", "formula")

_HIDDEN = re.compile(
    r"(?P<fence>^[ \t]{0,3}(?P<f>`{3,}|~{3,})[^\n]*\n(?P<fbody>.*?)(?:^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|(?P<tag><(?P<t>pre|syntaxhighlight|source|nowiki|math)\b(?P<tattr>[^<>]*)>(?P<tbody>.*?)(?:</(?P=t)\s*>|\Z))"
    r"|(?P<gone><!--.*?(?:-->|\Z)|<ref\b[^<>]*?/\s*>|<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)|<(?:script|style)\b.*?</(?:script|style)\s*>)"
    r"|(?P<tick>(?P<k>`+)(?!`)(?P<kbody>[^\n]*?[^`\n])(?P=k)(?!`))"
    r"|(?P<ictag><(?P<c>code|tt|kbd|samp)\b[^<>]*>(?P<cbody>[^\n]*?)</(?P=c)\s*>)",
    re.S | re.M | re.I,
)
_LATEX = re.compile(
    r"\$\$(?P<a>.*?)\$\$|\\\[(?P<b>.*?)\\\]|\\\((?P<c>.*?)\\\)|\\begin\{(?P<env>equation|align|displaymath|math|gather|eqnarray)\*?\}(?P<d>.*?)\\end\{(?P=env)\*?\}"
    r"|\\begin\{(?P<venv>verbatim|lstlisting|minted)\*?\}(?:\{[^}\n]*\}|\[[^\]\n]*\])*(?P<v>.*?)\\end\{(?P=venv)\*?\}"
    r"|(?<![\w$\\])\$(?![{\[\s$])(?P<e>[^$\n]+?)(?<![\s\\])\$(?![\w$])"
    r"|<img\b(?=[^<>]*class=[\"'][^\"']*\btex\b)[^<>]*\balt=(?:\"(?P<g>[^\"]*)\"|'(?P<h>[^']*)')[^<>]*>"
    r"|<(?:span|div)\s+class=[\"']math[^<>]*>(?P<i>.*?)</(?:span|div)>",
    re.S,
)
_HELD = re.compile("\x00(\\d+)\x01")
_INLINE_TAG = re.compile(r"</?(?:a|b|i|u|s|em|strong|span|small|big|sup|sub|font|mark|cite|var|abbr|del|ins|p|div|center|br|q|tt|code|kbd|samp)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
_MD_LINK = re.compile(r"!?\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\]\((?:[^()\n]|\([^()\n]*\))*\)")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]")
_EXT_LINK = re.compile(r"\[(?:https?:|ftp:|mailto:)?//?[^\s\]]+(?:[ \u00a0]+([^\]\n]*))?\]")
_TEX_MARK = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|text|mathbf|mbox)\{([^{}]*)\}")
_TEX_LINK = re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}")
_STARS = re.compile(r"(?<!\\)(\*{1,3})(?=\S)((?:[^*\n]|\*(?!\1))*?\S)\1(?!\*)")
_UNDER = re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]*?[^\s_])_(?!\w)")
_QUOTES = re.compile(r"'{2,5}")
_FILE = re.compile(r"\[\[(?:File|Image|Media|Category|Datei|Bild|Kategorie|文件|图像|分类)\s*:(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]", re.I)
_MAGIC = re.compile(r"__[A-Z]{3,}__")
_NOTOC = re.compile(r"__(?:NO)?(?:TOC|FORCETOC|INDEX|NOEDITSECTION|NEWSECTIONLINK|NOTITLECONVERT|STATICREDIRECT|NOGALLERY)__|__NO[A-Z]+__|__FORCE[A-Z]+__")

_ATX = re.compile(r"^ {0,3}#{1,6}[ \t\u00a0]+(.*?)(?:[ \t\u00a0]+#+)?[ \t\u00a0]*$")
_WIKI_HEAD = re.compile(r"^\s*(={1,6})(?!=)\s*(.+?)\s*(={1,6})\s*$")
_HTML_HEAD = re.compile(r"<h([1-6])\b[^<>]*>(.*?)(?:</h[1-6]\s*>|$)", re.I)
_TEX_HEAD = re.compile(r"^\s*\\(?:sub)*(?:section|chapter|paragraph)\*?\{(.*)\}\s*$")
_SETEXT = re.compile(r"^ {0,3}(?:={2,}|-{2,})[ \t]*$")
_MD_ITEM = re.compile(r"^[ \t]*(?:[-*+•·]|\d{1,4}[.)])[ \t\u00a0]+(.*)$")
_WIKI_ITEM = re.compile(r"^[:;]*[*#][*#:;]*[ \t]*(.*)$")
_LI = re.compile(r"<li\b[^<>]*>(.*?)(?=<li\b|</li\b|<[uo]l\b|</[uo]l\b|$)", re.I | re.S)
_TEX_ITEM = re.compile(r"\\item\b(?:\[[^\]\n]*\])?[ \t\u00a0]*(.*?)(?=\\item\b|\\end\{|$)")
_LIST_FRAME = re.compile(r"^\s*(?:</?(?:ul|ol|dl)\b[^<>]*>|\\(?:begin|end)\{(?:itemize|enumerate|description)\}|</li>|\s)+$", re.I)
_NBSP_TAG = re.compile(r"<[a-zA-Z]+&nbsp;[^<>]*>")


def _clean(text: str, held: list[tuple[str, str]], wiki: bool) -> str:
    """The text of a line without marks of emphasis, code and links, entities decoded, blanks collapsed."""
    if "[" in text:
        text = _FILE.sub("", text)
        if not wiki:
            text = _MD_LINK.sub(r"\1", text)
        text = _WIKI_LINK.sub(r"\1", text)
        text = _EXT_LINK.sub(lambda m: m[1] or "", text)
    if "<" in text:
        text = _INLINE_TAG.sub(lambda m: " " if m[0][1:3].lower() == "br" else "", text)
    if "\\" in text and not wiki:
        for _ in range(3):
            new = _TEX_LINK.sub(r"\1", _TEX_MARK.sub(r"\1", text))
            if new == text:
                break
            text = new
    if "''" in text:
        text = _QUOTES.sub("", text)
    if not wiki:
        if "*" in text:
            for _ in range(2):
                text = _STARS.sub(r"\2", text)
        if "_" in text:
            text = _UNDER.sub(r"\1", text)
    else:
        text = _NOTOC.sub("", text)
    if "&" in text:
        text = unescape(text)
    if "\x00" in text:
        text = _HELD.sub(lambda m: held[int(m[1])][1], text)
    return " ".join(text.split())


_WIKI_MARK = re.compile(r"\{\{+|\}\}+|^[ \t:]*\{\||^[ \t]*\|\}", re.M)
_LINE = "\x02%s\x03"
_OF_LINE = re.compile("\x02([TB])(\\d+)\x03")


def _constructs(text: str) -> str:
    """Wikitext without the balanced {{templates}} that stand within a line; each line of one that has
    lines of its own, and of a {|table|}, begins with a note of its kind (T, B) and number. What is not
    closed stays as it is."""
    if "{{" not in text and "{|" not in text:
        return text
    spans, open_ = [], []
    for m in _WIKI_MARK.finditer(text):
        mark = m[0].strip(" \t:")
        if mark == "{|":
            open_.append(("|", m.start()))
        elif mark == "|}":
            if open_ and open_[-1][0] == "|":
                _, at = open_.pop()
                if not open_:
                    spans.append(("B", at, m.end()))
        elif mark[0] == "{":
            open_ += [("{", m.start() + 2 * k) for k in range(len(mark) // 2)]
        else:
            for _ in range(len(mark) // 2):
                if open_ and open_[-1][0] == "{":
                    _, at = open_.pop()
                    if not open_:
                        spans.append(("T", at, m.end()))
    out, here = [], 0
    for n, (kind, a, b) in enumerate(spans):
        out.append(text[here:a])
        inner, alone = text[a:b], text[text.rfind("\n", 0, a) + 1 : a].strip(" \t:") == "" and (b == len(text) or text[b] == "\n")
        if alone or kind == "B":
            if kind == "B":
                inner = _without_templates(inner)
            out.append("\n".join(_LINE % f"{kind}{n}" + line for line in inner.split("\n")))
        here = b
    out.append(text[here:])
    return "".join(out)


def _without_templates(text: str) -> str:
    new = text
    while "{{" in text and (new := _FLAT.sub("", text)) != text:
        text = new
    return text


_FLAT = re.compile(r"\{\{[^{}]*\}\}")
_FIELD = re.compile(r"^\|\s*([^|=\n]+?)\s*=\s*(.*)$")
_CELL_END = re.compile(r"(?<!\\)\|\|?")
_WIKI_CELL_END = re.compile(r"\|\||!!")
_CELL_STYLE = re.compile(r"^\s*(?:[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|\"']+)\s*)+\|")
_DEEP = re.compile(r"^(?: {4}|\t)", re.M)


def _row(value: str, wiki: bool) -> str:
    """The cells of a clean table row, or nothing if it only rules lines."""
    if wiki:
        cells = [_CELL_STYLE.sub("", c) for c in _WIKI_CELL_END.split(value.lstrip("|!+"))]
    else:
        cells = _CELL_END.split(value.strip("| "))
    return " | ".join(c.strip() for c in cells) if any(map(str.isalnum, value)) else ""


def segments(text: str | None, wiki: bool = False, whole: bool = False) -> list[tuple[str, str, str, int]]:
    """(kind, text, source, parent) of all that could be content: lines, code and formulas in order.

    Kinds are the four elements and ``text``. The reading is by form alone: the lines of templates are
    read too (their fields as list items), as are rows of tables, rules, frames of lists and links that only
    place a page; what of it is content is left to the cut. ``parent`` numbers what a segment stands
    in: a template or table (negative), a run of list items, or a section. With ``whole`` code keeps its line
    breaks and indentation.
    """
    if not text:
        return []
    held: list[tuple[str, str]] = []

    def hold(kind: str, value: str) -> str:
        if whole and kind == "code":
            held.append((kind, _HELD.sub(lambda m: held[int(m[1])][1], value).strip("\n").rstrip()))
        else:
            held.append((kind, " ".join(value.split())))
        mark = f"\x00{len(held) - 1}\x01"
        return f"\n{mark}\n" if kind == "code" else mark

    def hide(m: re.Match) -> str:
        if m["gone"] is not None:
            return ""
        if m["fence"] is not None:
            return m[0] if wiki else hold("code", m["fbody"])
        if m["tick"] is not None:
            return m[0] if wiki else hold("inline", m["kbody"])
        if m["ictag"] is not None:
            return hold("inline", unescape(_INLINE_TAG.sub("", m["cbody"])))
        tag = m["t"].lower()
        if tag == "math":
            return hold("formula", unescape(m["tbody"]))
        if tag == "nowiki":
            return hold("inline", unescape(m["tbody"]))
        return hold("code", unescape(m["tbody"]))

    for note in _NOTES:
        text = text.replace(note, "")
    text = text.replace("\r\n", "\n")
    if "&nbsp;" in text and "<" in text:
        text = _NBSP_TAG.sub(lambda m: m[0].replace("&nbsp;", " "), text)
    if "`" in text or "~~~" in text or "<" in text:
        text = _HIDDEN.sub(hide, text)
    if wiki:
        text = _constructs(text)
    else:
        if "\n    " in text or "\n\t" in text or text[:1] in " \t":
            text = _indented(text, hold)
        if "$" in text or "\\" in text or "math" in text or "tex" in text:

            def tex(m: re.Match) -> str:
                if m["v"] is not None:
                    return hold("code", m["v"])
                body = next(x for x in (m[g] for g in "abcdeghi") if x is not None)
                return hold("formula", unescape(body) if m[0][0] == "<" else body)

            text = _LATEX.sub(tex, text)
    out: list[tuple[str, str, str, int]] = []
    section, run = 1, 0  # odd: sections, even: runs of items

    def add(kind: str, inner: str, raw: str, inside: int = 0) -> None:
        nonlocal section, run
        if kind == "heading":
            section += 2
        if kind == "list_item":
            run = run or len(out) * 2 + 2
        else:
            run = 0
        parent = inside or run or section
        value = _clean(inner, held, wiki)
        if value:
            out.append((kind, value, raw, parent))
        if "\x00" in inner:
            for m in _HELD.finditer(inner):
                if held[int(m[1])][0] == "formula" and held[int(m[1])][1]:
                    out.append(("formula", held[int(m[1])][1], "", parent))

    lines = text.split("\n")
    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        inside = 0
        if line[:1] == "\x02" and (m := _OF_LINE.match(line)):
            inside = -2 * int(m[2]) - (1 if m[1] == "T" else 2)
            line = line[m.end() :]
        bare = line.strip()
        if not bare:
            continue
        m = _HELD.fullmatch(bare.lstrip(": ") if wiki else bare)
        if m and held[int(m[1])][0] in ("code", "formula"):
            kind, value = held[int(m[1])]
            if value:
                out.append((kind, _unfenced(value) if kind == "formula" else value, "", inside or section))
            continue
        if wiki:
            if inside and inside % 2 and (m := _FIELD.match(bare)):
                add("list_item", f"{m[1]} = {m[2]}", bare, inside)
            elif inside and not inside % 2 and bare[0] in "|!{":
                if not bare.startswith(("|}", "|-", "{|")) and (row := _row(_clean(bare, held, wiki), wiki)):
                    out.append(("text", row, "", inside))
            elif (m := _WIKI_HEAD.match(line)) and m[1]:
                add("heading", m[2], bare, inside)
            elif m := _WIKI_ITEM.match(line):
                add("list_item", m[1], bare, inside)
            elif inside:
                out.append(("text", bare, bare, inside))
            elif bare.startswith("[[") and not _FILE.sub("", bare).strip() or bare[0] in "|!" or _MAGIC.fullmatch(bare):
                out.append(("text", bare, bare, section))
            elif "<li" in line:
                for m in _LI.finditer(line):
                    add("list_item", m[1], m[0])
            elif m := _HTML_HEAD.search(line):
                add("heading", m[2], bare)
            else:
                add("text", line.lstrip(":"), bare)
            continue
        if m := _ATX.match(line):
            add("heading", m[1], bare)
        elif m := _TEX_HEAD.match(line):
            add("heading", m[1], bare)
        elif "<h" in line and (m := _HTML_HEAD.search(line)):
            add("heading", m[2], bare)
        elif bare[0] == "=" and (m := _WIKI_HEAD.match(line)):
            add("heading", m[2], bare)
        elif k < len(lines) and _SETEXT.match(lines[k]) and not _MD_ITEM.match(line) and bare[0] not in "|>" and (k < 2 or not lines[k - 2].strip()):
            add("heading", line, bare)
            k += 1
        elif m := _MD_ITEM.match(line):
            add("list_item", m[1], bare)
        elif "<li" in line:
            for m in _LI.finditer(line):
                add("list_item", m[1], m[0])
        elif "\\item" in line:
            for m in _TEX_ITEM.finditer(line):
                add("list_item", m[1], m[0])
        elif bare[0] == "|":
            if row := _row(_clean(bare, held, wiki), wiki):
                out.append(("text", row, "", -2))
        elif _LIST_FRAME.match(line) or _SETEXT.match(line):
            out.append(("text", bare, bare, run or section))
        else:
            add("text", line.lstrip("> "), bare)
    return out


#: Characters that stand for held texts and constructs.
_NOTES = "\x00\x01\x02\x03"


def _indented(text: str, hold) -> str:
    """Indented code (after a blank line, outside of lists) taken out as code segments."""
    out, code, listed, blank = [], [], False, True
    for line in text.split("\n"):
        deep = line.startswith(("    ", "\t"))
        if deep and line.strip() and not listed and (blank or code):
            code.append(line)
            continue
        if code and not line.strip():
            code.append("")
            continue
        if code:
            out += [hold("code", _DEEP.sub("", "\n".join(code))), ""]
            code = []
        if not line.strip():
            blank = True
        else:
            listed = bool(_MD_ITEM.match(line)) or listed and (deep or not blank)
            blank = False
        out.append(line)
    if code:
        out.append(hold("code", _DEEP.sub("", "\n".join(code))))
    return "\n".join(out)


_DELIMITED = re.compile(r"^(?:\\\[(.*)\\\]|\\\((.*)\\\)|\$\$(.*)\$\$|\$(.*)\$|\\begin\{(equation|align|math|displaymath)\*?\}(.*)\\end\{\5\*?\})$", re.S)


def _unfenced(formula: str) -> str:
    m = _DELIMITED.match(formula.strip())
    return " ".join((m[1] or m[2] or m[3] or m[4] or m[6] or "").split()) if m else formula


#: What a segment is described by; the names are in the order of :func:`describe`.
FEATURES = ("constant", "heading", "list_item", "code", "formula", "in template", "marks", "marks left", "no word", "linked", "menu", "short", "ends a sentence", "leaning", "leaning of an element", "shouting", "page link", "repeated", "frame")
_MARKS = "{}|<>[]=\\"
_SEPARATORS = re.compile(r"\s[|·•»/>]\s|(?<=\w) - (?=\w)|  +")
_ENDS = ".!?。！？…:：;”\"“)"
_FRAME = re.compile(r"^\s*(?:\{\||\|\}|\|-|\{\{|\}\}|</?[a-zA-Z]+[^<>]*>\s*$|\\(?:begin|end)\{|(?:[-*_=|:] *){3,}$|__[A-Z]+__$)")
_LINKS = re.compile(r"\]\(|\[\[|\[https?:|<a\b")


def describe(kind: str, value: str, raw: str, parent: int, linked: float | None, repeated: bool, words: dict[str, float]) -> list[float]:
    """The features of a segment as numbers."""
    element, source = kind != "text", raw or value
    if kind in ("code", "formula"):
        return [1.0, 0.0, 0.0, kind == "code", kind == "formula", parent < 0 and parent % 2, *([0.0] * 13)]
    lean = leaning(value if raw else value.replace(" | ", " "), words)  # a table row has no source of its own
    n = value.count(" ") + 1 + (0 if value.isascii() else len(HAN.findall(value)) / 2)
    if linked is None:
        linked = min(1.0, len(_LINKS.findall(raw)) * 3 / n) if "[" in raw or "<" in raw else 0.0
    marks = sum(map(raw.count, _MARKS)) / len(source) if raw else 0.0
    left = sum(map(value.count, "{}|[]")) if raw else 0
    return [
        1.0, kind == "heading", kind == "list_item", 0.0, 0.0, parent < 0 and parent % 2 == 1, min(1.0, 4 * marks), min(1.0, 0.3 * left), not any(map(str.isalnum, value)), linked,
        min(1.0, len(_SEPARATORS.findall(value)) / 3) if raw and not element and n < 60 else 0.0, 0.0 if element else 1.0 / (1 + n / 4), not element and value[-1] in _ENDS, 0.0 if element else lean, lean if element else 0.0,
        value.isupper() and n > 1, bool(_FILE.match(source) or _MAGIC.fullmatch(source)) if source[0] in "[_" else 0.0, repeated, bool(raw) and bool(_FRAME.match(raw)),
    ]


#: Weights of the smoothness edges: between neighbours in the same construct, and what is taken off
#: for each step between two constructs; and between the next two segments of one construct.
NEAR, SAME_PARENT = 0.8, 0.5


def edges_of(parents: list[int], distance=None) -> list[tuple[int, int, float]]:
    """Edges between neighbouring segments, weaker the further apart they hang, and within a construct."""
    out, last = [], {}
    for i, p in enumerate(parents):
        if i:
            steps = (0 if p == parents[i - 1] else 1) if distance is None else distance(parents[i - 1], p)
            out.append((i - 1, i, NEAR / (1 + steps)))
        if p in last and last[p] != i - 1:
            out.append((last[p], i, SAME_PARENT))
        last[p] = i
    return out


def energies(parts: list[tuple[str, str, str, int]], model: dict, linked: list[float] | None = None) -> list[tuple[float, float]]:
    """(cost of keeping, cost of dropping) of each segment: the classifier's negative log probabilities."""
    coef, words, seen, out = model["coef"], model["words"], set(), []
    for i, (kind, value, raw, parent) in enumerate(parts):
        again = kind == "text" and value in seen
        seen.add(value)
        z = sum([a * b for a, b in zip(coef, describe(kind, value, raw, parent, None if linked is None else linked[i], again, words))])
        out.append((log1p(exp(z)), log1p(exp(-z))) if -30 < z < 30 else (max(z, 0.0), max(-z, 0.0)))
    return out


@lru_cache(maxsize=1)
def classifier() -> dict:
    """The linear classifier (weights for residue), a logistic regression on the labelled segments."""
    rows, labels = [], []
    for notation, text, half in labelled_segments.documents():
        words = weights("site", 1 - half)  # fitted on other lines than the document's
        parts, linked, _ = _read(text, notation, False)
        seen = set()
        for i, (kind, value, raw, parent) in enumerate(parts):
            labels.append(0.0 if labelled_segments.MARK in value or kind in ("code", "formula") else 1.0)
            value, raw = value.replace(labelled_segments.MARK, ""), raw.replace(labelled_segments.MARK, "")
            rows.append(list(map(float, describe(kind, value or "x", raw, parent, None if linked is None else linked[i], kind == "text" and value in seen, words))))
            seen.add(value)
    x, y = np.array(rows), np.array(labels)
    coef, ridge = np.zeros(x.shape[1]), 0.5 * np.eye(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ coef, -30, 30)))
        coef += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ coef)
    return {"coef": coef.tolist(), "words": weights("site")}


def kept(parts: list[tuple[str, str, str, int]], model: dict, linked: list[float] | None = None, distance=None) -> list[tuple[str, str]]:
    """The segments labelled content by the minimum cut."""
    if not parts:
        return []
    costs = energies(parts, model, linked)
    return [(k, t) for (k, t, _, _), keep in zip(parts, label(costs, edges_of([p for *_, p in parts], distance))) if keep]


_FROM_HTML = {"heading": "heading", "li": "list_item", "pre": "code", "formula": "formula", "p": "text", "quote": "text", "caption": "text", "cell": "text", "control": "text"}


def html_segments(html: str | None, whole: bool = False) -> tuple[list[tuple[str, str, str, int]], list[float], object]:
    """Segments of an HTML fragment, their link densities, and the distance of two containers in the DOM."""
    nodes, blocks = read(html, formulas=True)
    parts, linked = [], []
    row, at = -1, -1  # the row and the cell of the last block
    for b in blocks:
        kind = _FROM_HTML[b.kind]
        text = _unfenced(b.text) if kind == "formula" else b.whole() if whole else b.text
        if text:
            density = b.linked / max(1, len(b.text))
            last, cell = row, nodes[b.node]
            row = cell.parent if b.kind == "cell" and cell.tag in ("td", "th") else -1
            if row >= 0 and row == last:
                k, t, raw, p = parts[-1]
                parts[-1] = (k, t + (" " if b.node == at else " | ") + text, raw, p)
                linked[-1] = min(linked[-1], density)
            else:
                parts.append((kind, text, text if kind == "text" and row < 0 else "", b.node))
                linked.append(density)
            at = b.node

    def distance(a: int, b: int) -> int:
        steps = 0
        while a != b:
            if nodes[a].depth >= nodes[b].depth:
                a = nodes[a].parent
            else:
                b = nodes[b].parent
            steps += 1
        return steps

    return parts, linked, distance


def _read(text: str | None, notation: str, whole: bool) -> tuple[list[tuple[str, str, str, int]], list[float] | None, object]:
    if notation == "html":
        return html_segments(text, whole)
    return segments(text, notation == "wikitext", whole), None, None


def content_of(text: str | None, notation: str, whole: bool = False, model: dict | None = None) -> list[tuple[str, str]]:
    """(kind, text) of the content segments of a document in ``wikitext``, ``html`` or ``content``."""
    parts, linked, distance = _read(text, notation, whole)
    return kept(parts, model or classifier(), linked, distance)


def clean_text(parts: list[tuple[str, str]]) -> str:
    """Content segments as plain text in which the elements keep a mark of their kind."""
    form = {"heading": "# %s", "list_item": "- %s", "code": "```\n%s\n```", "formula": "$$%s$$"}
    return "\n".join(form[k] % t if k in form else t for k, t in parts)


def _mapped(df: DataFrame, record_id: str, text: str, notation: str, rows_of, fields: list[tuple[str, str]], whole: bool = False) -> DataFrame:
    names = ["rec_id", *(n for n, _ in fields)]
    shared = df.sparkSession.sparkContext.broadcast(classifier())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at, cols = [], [[] for _ in fields]
            for k, value in enumerate(batch.column(1)):
                for row in rows_of(content_of(value.as_py(), notation, whole, model)):
                    at.append(k)
                    for c, v in zip(cols, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, pa.string()) for c in cols)], names)

    return spread(df.where(F.col(text).isNotNull()).select(F.col(record_id).cast("long"), text)).mapInArrow(run, "rec_id long, " + ", ".join(f"{n} {t}" for n, t in fields))


def elements(df: DataFrame, record_id: str, text: str, notation: str) -> DataFrame:
    """(rec_id, kind, elem): each different heading, list item, code block and formula of each document."""
    return _mapped(df, record_id, text, notation, lambda parts: dict.fromkeys(p for p in parts if p[0] in ELEMENTS), [("kind", "string"), ("elem", "string")])


def cleaned(df: DataFrame, record_id: str, text: str, notation: str) -> DataFrame:
    """(rec_id, text): each document as clean text, with its code as it stands and its table rows."""
    return _mapped(df, record_id, text, notation, lambda parts: [(clean_text(parts),)], [("text", "string")], whole=True)
