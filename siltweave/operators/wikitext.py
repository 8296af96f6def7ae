"""Wikitext to Markdown (WT1 to WT7)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.session import spread

#: Stands where a page has a query whose result only the wiki itself can give.
QUERY_MARK = "<!-- query result -->"


def spans(text: str, opener: str = "{{", closer: str = "}}") -> list[tuple[int, int]]:
    """Outermost balanced stretches; an opener that never closes is text."""
    out, depth, begin, k = [], 0, 0, 0
    marks = re.compile(re.escape(opener) + "|" + re.escape(closer))
    for m in marks.finditer(text):
        k = m.start()
        if m[0] == opener:
            if depth == 0:
                begin = k
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append((begin, m.end()))
    if depth:  # something stayed open: look again behind it
        rest = begin + len(opener)
        out += [(a + rest, b + rest) for a, b in spans(text[rest:], opener, closer)] if len(text) > rest else []
    return out


def templates(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


def arguments(template: str) -> tuple[str, list[str], dict[str, str]]:
    """Name, positional and named arguments; pipes inside nested templates and links don't split."""
    parts, depth, here, inner = [], 0, 0, template[2:-2]
    for m in re.finditer(r"\{\{|\}\}|\[\[|\]\]|\|", inner):
        if m[0] in ("{{", "[["):
            depth += 1
        elif m[0] in ("}}", "]]"):
            depth -= 1
        elif depth == 0:
            parts.append(inner[here : m.start()])
            here = m.end()
    parts.append(inner[here:])
    positional, named = [], {}
    for p in parts[1:]:
        m = re.match(r"\s*([\w .-]+?)\s*=(.*)\Z", p, re.S)
        if m:
            named[m[1]] = m[2].strip()
        else:
            positional.append(p.strip())
    return parts[0].strip(), positional, named


def flat(value: str) -> str:
    """A field's value without markup."""
    for _ in range(3):
        value = re.sub(r"\{\{[^|{}]*\|([^{}]*)\}\}", r"\1", value)
        value = re.sub(r"\{\{([^{}]*)\}\}", r"\1", value)
    value = re.sub(r"\[\[(?:[^|\[\]]*\|)?([^\[\]]*)\]\]", r"\1", value)
    return " ".join(re.sub(r"<[^>]+>", " ", value).replace("'''", "").replace("''", "").split())


def front_fields(text: str, fields: list[str], positional: list[str] | None = None) -> dict[str, str]:
    """The fields of the first template that has any; unset ones may come from positional arguments (WT6)."""
    for t in templates(text):
        _, args, named = arguments(t)
        found = {f: v for f in fields if (v := flat(named.get(f, "")))}
        for f, v in zip(positional or [], args):
            if f not in found and flat(v):
                found[f] = flat(v)
        if found:
            return found
    return {}


def replaced(text: str, change: Callable[[str], str]) -> str:
    """Text with every outermost template changed."""
    out, here = [], 0
    for a, b in spans(text):
        out += [text[here:a], change(text[a:b])]
        here = b
    return "".join(out) + text[here:]


def expand(text: str, forms: dict[str, str]) -> tuple[str, list[str]]:
    """Known templates in their form (%s the first, %(k)s a named argument), and the names of unknown ones."""
    unknown: list[str] = []

    def change(t: str) -> str:
        name, args, named = arguments(t)
        if name not in forms:
            unknown.append(name)
            return t
        form = forms[name]
        try:
            return form % named if "%(" in form else form % args[0] if "%s" in form and args else form
        except (KeyError, TypeError, ValueError):
            return form

    return replaced(text, change), unknown


def without_infobox(text: str, fields: list[str]) -> str:
    """Text without the templates that carry any of the fields."""
    return replaced(text, lambda t: "" if set(fields) & set(arguments(t)[2]) else t) if fields else text


def remaining(text: str) -> str:
    """What stays of unknown templates: a hint for links to other pages, else the last argument."""

    def change(t: str) -> str:
        name, args, _ = arguments(t)
        if name.lower() in ("main", "see also"):
            return "See also: " + ", ".join(args)
        if name.lower().startswith("#dpl"):
            return f"\n{QUERY_MARK}\n"
        return "" if name.lower() == "for" or name.startswith("#") else (flat(args[-1]) if args else "")

    return replaced(text, change)


def table_markdown(block: str) -> str:
    """A {| |} table as a pipe table (WT5)."""
    rows: list[tuple[bool, list[str]]] = []
    current: list[str] = []
    head = False
    for line in block.strip().split("\n")[1:]:
        line = line.strip()
        if line.startswith("|}"):
            break
        if line.startswith("|-"):
            if current:
                rows.append((head, current))
            current, head = [], False
        elif line.startswith(("|+", "{|")):
            continue
        elif line.startswith(("|", "!")):
            head = head or line[0] == "!"
            for cell in re.split(r"\|\||!!", line[1:]) if line[0] == "!" else line[1:].split("||"):
                m = re.match(r"^[^\[\]{}|]*=[^\[\]{}|]*\|(?!\|)(.*)$", cell)
                current.append((m[1] if m else cell).strip().replace("|", "\\|"))
        elif current:
            current[-1] += " " + line
    if current:
        rows.append((head, current))
    if not rows:
        return ""
    wide = max(len(r) for _, r in rows)
    lines = [r + [""] * (wide - len(r)) for _, r in rows]
    if not rows[0][0]:
        lines.insert(0, [""] * wide)
    draw = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([draw(lines[0]), "| " + " | ".join(["---"] * wide) + " |", *map(draw, lines[1:])])


def convert(text: str | None, title: str, source_url: str = "", fields: tuple[str, ...] = (), forms: dict[str, str] | None = None, resolve: Callable[[str, str], str] | None = None) -> tuple[str, list[str], dict[str, str]]:
    """(Markdown without front matter, warnings, front matter) of a page (WT1)."""
    text = text or ""
    front = front_fields(text, list(fields)) | {"title": title, "source_url": source_url}
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"<dpl>.*?</dpl>", f"\n{QUERY_MARK}\n", text, flags=re.S)
    text, unknown = expand(without_infobox(text, list(fields)), forms or {})
    text = remaining(text)
    text = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]\n?", "", text)
    out, here = [], 0
    for a, b in spans(text, "{|", "|}"):
        out += [text[here:a].rstrip("\n"), "\n\n", table_markdown(text[a:b]), "\n\n"]
        here = b
    text = "".join(out) + text[here:]
    text = re.sub(r"^(\*+)\s*", lambda m: "  " * (len(m[1]) - 1) + "- ", text, flags=re.M)
    link = resolve or (lambda target, label: f"[{label}](/wiki/{target.strip().replace(' ', '_')})")
    text = re.sub(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]", lambda m: link(m[1], m[2] or m[1]), text)
    text = re.sub(r"'''(.+?)'''", r"**\1**", text)
    text = re.sub(r"''(.+?)''", r"*\1*", text)
    text = re.sub(r"^(={2,6})\s*(.+?)\s*\1\s*$", lambda m: f"{'#' * len(m[1])} {m[2]}", text, flags=re.M)
    text = re.sub(r"^=\s*([^=].*?)\s*=\s*$", r"# \1", text, flags=re.M)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text if text.startswith("#") else f"# {title}\n\n{text}".strip(), [f"unknown template {n}" for n in sorted(set(unknown))], front


def to_markdown(pages: DataFrame, page_id: str, wikitext: str, title: str, fields: tuple[str, ...] = (), forms: dict[str, str] | None = None) -> DataFrame:
    """(id, markdown, warnings, frontmatter) of each page with wikitext, in one Arrow pass."""
    types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [convert(t.as_py(), n or "", fields=fields, forms=forms) for t, n in zip(batch.column(1), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([list(r[k].items()) if k == 2 else r[k] for r in rows], types[k + 1]) for k in range(3))], ["id", "markdown", "warnings", "frontmatter"])

    return spread(pages.where(F.col(wikitext).isNotNull()).select(F.col(page_id).cast("long"), wikitext, title)).mapInArrow(run, "id long, markdown string, warnings array<string>, frontmatter map<string,string>")
