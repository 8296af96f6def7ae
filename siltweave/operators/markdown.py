"""HTML to Markdown (K0 to K15): one parse a page, everything else drawn from the tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.functions.dom import Element, compiled, matches, parse
from siltweave.session import spread

MAX_COLUMNS = 200
_BLOCKS = frozenset("p div section article main aside header footer nav ul ol dl dt dd table blockquote pre hr h1 h2 h3 h4 h5 h6 figure center form".split())
_SILENT = frozenset("script style noscript template head title meta link svg".split())
_NO_SPACE_BEFORE = tuple(",.;:!?)]}…。，；：！？）》")
_NO_SPACE_AFTER = tuple("([{（《\n")


@dataclass(frozen=True)
class Rules:
    """What a site's configuration says about its pages."""

    domain: str = ""
    content: str = ""  # selector of the content element
    #: What such pages mark as furniture.
    drop: tuple[str, ...] = (".mw-editsection", ".toc", "#toc", ".hatnote")
    cleanup: tuple[str, ...] = ("strip_edit_links", "strip_skip_links", "strip_category_links", "unwrap_image_wrappers")
    skip_images: tuple[str, ...] = ()
    infobox: str = ""  # selector of the infobox container
    infobox_field: str = ".pi-data"
    infobox_label: str = ".pi-data-label"
    infobox_value: str = ".pi-data-value"
    handlers: dict = field(default_factory=dict)
    transpose_over: int = 0  # tables wider than this are turned; 0 never
    lazy: tuple[str, ...] = ("data-src", "data-lazy-src")


def space(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def join_inline(parts: list[str]) -> str:
    """Pieces with one blank between them, none before punctuation or around line breaks (FN14)."""
    out = ""
    for p in parts:
        if not p.strip(" "):
            out += p if p == "\n" else ""
            continue
        p = p if p == "\n" else p.strip(" ")
        if out and not p.startswith((*_NO_SPACE_BEFORE, "\n")) and not out.endswith(_NO_SPACE_AFTER):
            out += " "
        out += p
    return out.strip()


def href(value: str | None, domain: str) -> str | None:
    v = (value or "").strip()
    if not v or v.lower().startswith("javascript:"):
        return None
    if v.startswith("//"):
        return "https:" + v
    if domain and v.startswith("about:/"):
        v = v[6:]
    return f"https://{domain}{v}" if domain and v.startswith("/") else v


def _holds_block(e: Element) -> bool:
    return any(c.tag in _BLOCKS or c.children and _holds_block(c) for c in e.children)


class Renderer:
    """Draws one page; collects its links, images, tables and warnings on the way."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.links: list[str] = []
        self.images: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.warnings: list[str] = []
        self._skip = [re.compile(p) for p in rules.skip_images]

    # inline -----------------------------------------------------------
    def inline(self, e: Element) -> str:
        if not e.tag:
            return space(e.text)
        if e.tag in _SILENT:
            return ""
        if e.tag == "br":
            return "\n"
        if e.tag == "img":
            return self.image(e)
        if e.tag == "code":
            t = e.all_text().strip()
            return f"`{t}`" if t else ""
        if e.tag in _BLOCKS:
            return self.block(e)
        text = self.inlines(e)
        if not text:
            return ""
        if e.tag in ("b", "strong"):
            return f"**{text}**"
        if e.tag in ("i", "em"):
            return f"*{text}*"
        if e.tag == "a":
            to = href(e.attrs.get("href"), self.rules.domain)
            if to:
                self.links.append(to)
                return f"[{text}]({to})"
        return text

    def inlines(self, e: Element) -> str:
        return join_inline([self.inline(c) for c in e.children])

    def image(self, e: Element) -> str:
        raw = next((e.attrs[a] for a in self.rules.lazy if e.attrs.get(a)), e.attrs.get("src"))
        to = href(raw, self.rules.domain)
        if not to or any(p.search(to) for p in self._skip):
            return ""
        self.images.append(to)
        return f"![{space(e.attrs.get('alt') or e.attrs.get('title') or 'image').strip()}]({to})"

    # blocks -----------------------------------------------------------
    def blocks(self, children: list[Element]) -> str:
        """Block children one below the other; runs of inline children are paragraphs."""
        out, run = [], []

        def flush() -> None:
            if run:
                out.append(join_inline([self.inline(c) for c in run]))
                run.clear()

        for c in children:
            if c.tag in _BLOCKS or c.children and _holds_block(c):
                flush()
                out.append(self.block(c))
            else:
                run.append(c)
        flush()
        return "\n\n".join(x.strip("\n") for x in out if x.strip())

    def block(self, e: Element, level: int = 0) -> str:
        tag = e.tag
        if tag in _SILENT:
            return ""
        if tag[0] == "h" and tag[1:].isdigit():
            text = self.inlines(e)
            return f"{'#' * max(2, int(tag[1:]))} {text}" if text else ""
        if tag in ("ul", "ol"):
            return "\n".join(self.items(e, level))
        if tag == "blockquote":
            body = self.blocks(e.children)
            return "\n".join(f"> {line}".rstrip() for line in body.split("\n")) if body else ""
        if tag == "pre":
            code = e.all_text().strip("\n")
            return f"```\n{code}\n```" if code.strip() else ""
        if tag == "hr":
            return "---"
        if tag == "table":
            return self.table(e)
        if tag in ("p", "dt", "dd") and not _holds_block(e):
            return self.inlines(e)
        return self.blocks(e.children)

    def items(self, e: Element, level: int) -> list[str]:
        lines, n = [], 0
        for li in e.children:
            if li.tag != "li":
                continue
            n += 1
            head = join_inline([self.inline(c) for c in li.children if c.tag not in ("ul", "ol")])
            lines.append(("  " * level + (f"{n}. " if e.tag == "ol" else "- ") + head).rstrip())
            for c in li.children:
                if c.tag in ("ul", "ol"):
                    lines += self.items(c, level + 1)
        return lines

    # tables -----------------------------------------------------------
    def grid(self, e: Element) -> tuple[list[list[str]], int]:
        """The rectangular grid of a table with spans filled in, and its number of header rows."""
        rows = [r for c in e.children for r in ([c] if c.tag == "tr" else c.children if c.tag in ("thead", "tbody", "tfoot") else []) if r.tag == "tr"]
        taken: dict[tuple[int, int], str] = {}
        heads, open_head, wide = 0, True, 0
        for y, tr in enumerate(rows):
            cells = [c for c in tr.children if c.tag in ("td", "th")]
            open_head = open_head and bool(cells) and all(c.tag == "th" for c in cells)
            heads += open_head
            x = 0
            for c in cells:
                while (y, x) in taken:
                    x += 1
                if x >= MAX_COLUMNS:
                    self.warnings.append("table_cut")
                    break
                if any(k.tag == "table" for k in c.walk()):
                    self.warnings.append("nested_table")
                    text = join_inline([self.inline(k) for k in c.children if k.tag != "table"])
                else:
                    text = self.inlines(c)
                w, h = (int(v) if (v := c.attrs.get(a, "1").strip()).isdigit() and v != "0" else 1 for a in ("colspan", "rowspan"))
                for dy in range(min(h, len(rows) - y)):
                    for dx in range(min(w, MAX_COLUMNS - x)):
                        taken.setdefault((y + dy, x + dx), text)
                x += w
            wide = max([wide, *(cx + 1 for cy, cx in taken if cy == y)])
        grid = [[taken.get((y, x), "") for x in range(wide)] for y in range(len(rows)) if any(cy == y for cy, _ in taken)]
        return grid, min(heads, len(grid))

    def table(self, e: Element) -> str:
        grid, heads = self.grid(e)
        if not grid:
            return ""
        self.tables.append(grid)
        if self.rules.transpose_over and len(grid[0]) > self.rules.transpose_over:
            grid, heads = transposed(grid, heads), 1 if heads else 0
        return table_markdown(grid, heads)

    # infobox ----------------------------------------------------------
    def infobox_rows(self, box: Element) -> list[tuple[str, str]]:
        rows = []
        for f in box.select(self.rules.infobox_field):
            label_node, value_node = f.first(self.rules.infobox_label), f.first(self.rules.infobox_value)
            label = self.inlines(label_node) if label_node else ""
            if not label:
                continue
            source = f.attrs.get("data-source", "")
            config = next((self.rules.handlers[k] for k in (label, f"{source}({label})", source) if k in self.rules.handlers), None)
            if value_node is None:
                value = ""
            elif config is None:
                value = self.inlines(value_node)
            else:
                value = HANDLERS.get(config, plain_text)(value_node, self.rules.domain)
            rows.append((label, value))
        return rows


def transposed(grid: list[list[str]], heads: int) -> list[list[str]]:
    """Columns as rows; several header rows merge into one label."""
    labels = [" → ".join(dict.fromkeys(v for row in grid[:heads] if (v := row[x].strip()))) for x in range(len(grid[0]))]
    return [([labels[x]] if heads else []) + [row[x] for row in grid[heads:]] for x in range(len(grid[0]))]


def table_markdown(grid: list[list[str]], heads: int) -> str:
    """A grid as a pipe table; further header rows stay body rows, without one the header is empty (K9)."""
    cell = lambda s: s.replace("|", "\\|").replace("\n", " ").strip()
    head, body = (grid[0], grid[1:]) if heads else ([""] * len(grid[0]), grid)
    line = lambda row: "| " + " | ".join(map(cell, row)) + " |"
    return "\n".join([line(head), "| " + " | ".join(["---"] * len(head)) + " |", *map(line, body)])


def plain_text(e: Element, domain: str) -> str:
    return space(e.all_text()).strip()


def _image(e: Element, domain: str) -> str:
    i = e.first("img[src]")
    return f"![{i.attrs.get('alt') or 'image'}]({href(i.attrs['src'], domain)})" if i else plain_text(e, domain)


def _counted_images(e: Element, domain: str) -> str:
    counts = Counter(i.attrs["alt"] for i in e.select("img[alt]"))
    return ", ".join(f"{n}× {alt}" for alt, n in counts.items()) or "0"


def _current_id(e: Element, domain: str) -> str:
    now = e.first(".infobox-nav-cur")
    return plain_text(now or e, domain)


def _named_links(e: Element, domain: str) -> list[tuple[str, str]]:
    return [(plain_text(a, domain), to) for a in e.select("a[href]") if (to := href(a.attrs["href"], domain))]


def _pools(e: Element, domain: str) -> str:
    once = {}
    for text, to in _named_links(e, domain):
        if text:
            once.setdefault(to, text)
    return ", ".join(f"[{t}]({to})" for to, t in once.items()) or plain_text(e, domain)


def _collection(e: Element, domain: str) -> str:
    named = [(t, to) for t, to in _named_links(e, domain) if t]
    return f"See [{named[0][0]}]({named[0][1]})" if named else plain_text(e, domain)


def _tags(e: Element, domain: str) -> str:
    found = [f"[{a.attrs['title']}]({href(a.attrs['href'], domain)})" for a in e.select("a[title]") if a.attrs["title"] and a.attrs.get("href")]
    return ", ".join(found) or plain_text(e, domain)


#: Infobox field handlers by the names that site configurations use.
HANDLERS: dict[str, Callable[[Element, str], str]] = {"text": plain_text, "image": _image, "count_images": _counted_images, "extract_cur_id": _current_id, "dedup_pools": _pools, "simplify_collection": _collection, "extract_tags": _tags}


def _unwrap_images(root: Element) -> None:
    for a in root.select("a.image, a.mw-file-description"):
        if a.parent is not None and (img := a.first("img")) is not None and not a.all_text().strip():
            k = a.parent.children.index(a)
            img.parent, a.parent.children[k] = a.parent, img


def _ambox(root: Element) -> None:
    for t in root.select("table.ambox"):
        text = space(t.all_text()).strip()
        t.tag, t.attrs = "p", {}
        t.children = [Element("", parent=t, text=f"Note: {text}")] if text else []


#: Cleanup operations that drop elements, by the names that site configurations use (K2).
DROPS = {
    "strip_edit_links": ".mw-editsection",
    "strip_skip_links": ".mw-jump-link, .skip-link",
    "strip_footer": ".printfooter, #footer, footer, .mw-footer",
    "strip_category_links": "#catlinks, .catlinks",
    "strip_fandom_infobox_tables": "table.infobox, table.infoboxtable",
}
#: The other cleanup operations; unknown names are ignored.
CLEANUP: dict[str, Callable[[Element], None]] = {"convert_ambox_to_text": _ambox, "unwrap_image_wrappers": _unwrap_images, "convert_nested_images": _unwrap_images}


def prepare(root: Element, rules: Rules) -> Element:
    """The content element with dropped parts, hidden elements and cleanup done (K1, K3)."""
    drop = [*rules.drop, *(DROPS[n] for n in rules.cleanup if n in DROPS)]
    for e in root.select(", ".join([*drop, "[style]"])):  # one walk for all of them
        style = e.attrs.get("style")
        if style is None or "display:none" in style.replace(" ", "").lower() or drop and any(matches(e, r) for r in compiled(", ".join(drop))):
            e.remove()
    for name in rules.cleanup:
        if name in CLEANUP:
            CLEANUP[name](root)
    return (root.first(rules.content) if rules.content else None) or root.first("body") or root


_TIP = re.compile(r'<span class="[^"]*tooltip[^"]*"[^>]*>(.*?)</span>', re.S)
_TWICE = re.compile(r'<a ([^>]*href="([^"]*)"[^>]*)>(\s*|<img[^>]*>)</a>\s*<a [^>]*href="\2"[^>]*>', re.S)
_PLAYER = re.compile(r'data-mw-iframeconfig="[^"]*?embed/([\w-]+)')


def convert(html: str | None, rules: Rules) -> dict:
    """Markdown of a page with its infobox, tables, links, images and warnings.

    Tooltips are unwrapped first and a link merged with the same link before it; players that attributes configure
    become a section of their own at the end.
    """
    if html and "tooltip" in html:
        html = _TWICE.sub(r"<a \1>\3", _TIP.sub(r"\1", html))
    videos = list(dict.fromkeys(_PLAYER.findall(html))) if html and "data-mw-iframeconfig" in html else []
    root = parse(html)
    r = Renderer(rules)
    box = root.first(rules.infobox) if rules.infobox else None
    rows = r.infobox_rows(box) if box else []
    if box:
        box.remove()
    body = r.blocks(prepare(root, rules).children)
    if rows:
        lines = "\n".join(f"| **{a}** | {b.replace('|', chr(92) + '|')} |" for a, b in rows)
        body = f"## Infobox\n\n| Field | Value |\n| --- | --- |\n{lines}\n\n{body}".strip()
    if videos:
        body = (body + "\n\n## Videos\n\n" + "\n".join(f"- https://www.youtube.com/watch?v={v}" for v in videos)).strip()
    return {"markdown": body, "infobox": rows, "n_tables": len(r.tables), "links": r.links, "images": r.images, "warnings": sorted(set(r.warnings))}


_SCHEMA = "id long, markdown string, infobox array<struct<label:string,value:string>>, n_tables int, links array<string>, images array<string>, warnings array<string>"


def to_markdown(pages: DataFrame, page_id: str, html: str, rules: Rules = Rules()) -> DataFrame:
    """(id, markdown, infobox, n_tables, links, images, warnings) of each page, null pages left out.

    One Arrow pass; small record batches keep a few huge pages from filling a worker.
    """
    types = [pa.int64(), pa.string(), pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())])), pa.int32(), *[pa.list_(pa.string())] * 3]
    names = ["id", "markdown", "infobox", "n_tables", "links", "images", "warnings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 200):
                batch = big.slice(at, 200)
                rows = [convert(h.as_py(), rules) for h in batch.column(1)]
                cols = [[[{"label": a, "value": b} for a, b in r["infobox"]] if n == "infobox" else r[n] for r in rows] for n in names[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names)

    return spread(pages.where(F.col(html).isNotNull()).select(F.col(page_id).cast("long"), html)).mapInArrow(run, _SCHEMA)


def cards(html: str | None) -> list[dict]:
    """Card boxes of a list page: name, type, color, rarity, href, image, description."""
    out = []
    for b in parse(html).select(".card-box"):
        a, img = b.first("a[href]"), b.first("img")
        attr = lambda n: b.attrs.get(f"data-{n}", "")  # noqa: E731, B023
        desc = b.first(".desc")
        out.append({"name": attr("name") or (plain_text(a, "") if a else ""), "type": attr("type"), "color": attr("color"), "rarity": attr("rarity"), "href": a.attrs["href"] if a else "", "img_src": img.attrs.get("src", "") if img else "", "description": plain_text(desc, "") if desc else ""})
    return out


#: Rows of a card page's fact box: label and selector (fixed values of such pages).
_CARD_ROWS = (("Name", ".druid-row-Name"), ("Cost", ".druid-row-EnergyCost"), ("Type", ".druid-row-Type"), ("Rarity", ".druid-row-RarityClass"))


def card_stats(html: str | None) -> str:
    """The base and upgraded values of a card page's fact box as a table; a row without tabs has one value for both."""
    box = parse(html).first(".druid-infobox")
    if not box:
        return ""
    lines = ["| | Base | Upgraded |", "| --- | --- | --- |"]
    for label, selector in _CARD_ROWS:
        row = box.first(selector)
        if not row:
            continue
        tabs = {"Upgraded" in t.attrs.get("data-druid-tab-key", ""): plain_text(t, "") for t in row.select(".druid-toggleable-data")}
        base = tabs.get(False, "") if tabs else plain_text(row, "").removesuffix(" Card")
        if base:
            lines.append(f"| **{label}** | {base} | {tabs.get(True) or base} |")
    return "\n".join(lines)


def largest_table(html: str | None, rules: Rules = Rules()) -> str:
    """The table with most rows as Markdown, the first of equals; '' without one (K15, AGG21)."""
    r = Renderer(rules)
    grids = [g for t in parse(html).select("table") if (g := r.grid(t))[0]]
    return table_markdown(*max(grids, key=lambda g: len(g[0]))) if grids else ""
