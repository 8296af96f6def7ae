"""Problem 5: the article of a web page, without menus, notices, side columns and footers.

A page becomes flat text blocks. Each block is described by its own word count and link density,
those of its neighbours, and the make-up of the container it stands in, measured against the
container that holds most running text; names of classes and ids play no part. A decision tree trained on the labelled table of
:mod:`siltweave.llm.labelled_pages` keeps or drops each block. The tree (a few hundred numbers) is
grown on the driver; pages never leave their partition, so there is no shuffle of page text.

Defined results: null, empty or textless pages have no block; unclosed tags end where a browser
would end them; equal blocks of a page are reported once; very long pages are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.llm.html_blocks import Block, Node, read
from siltweave.llm.labelled_pages import MARK, pages
from siltweave.llm.words import HAN
from siltweave.session import spread

BLOCK_CHARS = 40
_KINDS = {"heading": 0, "p": 1, "li": 2, "quote": 3, "pre": 4, "cell": 5, "caption": 6, "control": 7, "formula": 8}
#: Containers that only arrange others.
_LISTS = {"ul", "ol", "dl", "tbody", "thead", "tfoot", "tr"}
FEATURES = 23


def _count(text: str) -> float:
    n = len(text.split())
    return n if text.isascii() else n + len(HAN.findall(text)) / 2


def features(nodes: list[Node], blocks: list[Block]) -> list[list[float]]:
    """One row of FEATURES numbers a block."""
    n = len(blocks)
    if not n:
        return []
    home, words, density = [], [], []
    size = len(nodes)
    total, plain, count, heads, linked_blocks = [0.0] * size, [0.0] * size, [0] * size, [0] * size, [0] * size
    held, inner = [0] * size, [0] * size
    for x in nodes[1:]:
        inner[x.parent] += 1
    for b in blocks:
        held[b.node] += 1
    leaves: dict[str, int] = {}
    for b in blocks:
        h = b.node
        # a container that holds nothing but one text or one code block stands for that block
        if held[h] == 1 and not inner[h] and not nodes[h].controls and nodes[h].parent >= 0 and (b.kind == "pre" or b.kind == "p" and b.tag == nodes[h].tag):
            if b.kind == "p":
                leaves[nodes[h].names] = leaves.get(nodes[h].names, 0) + 1
            h = nodes[h].parent
        while nodes[h].tag in _LISTS and nodes[h].parent >= 0:
            h = nodes[h].parent
        home.append(h)
        w, d = _count(b.text), min(1.0, b.linked / max(1, len(b.text)))
        words.append(w)
        density.append(d)
        count[h] += 1
        total[h] += w
        heads[h] += b.kind == "heading"
        linked_blocks[h] += d > 0.7
        if b.kind in ("p", "li", "quote", "pre"):
            plain[h] += w * (1 - d)
    score = [0.0] * size
    for x in nodes:
        s = plain[x.at] + 4 * min(heads[x.at], 3)
        if count[x.at]:
            s *= 1 - 0.7 * linked_blocks[x.at] / count[x.at]
        score[x.at] = s * 0.1 if x.controls else s
    main = max(range(size), key=score.__getitem__)
    above = set()
    k = main
    while k >= 0:
        above.add(k)
        k = nodes[k].parent
    place = {}

    def where(h: int) -> tuple[int, int]:
        if h not in place:
            if h == main:
                place[h] = (0, 0)
            elif h in above:
                place[h] = (2, 0)
            else:
                k, steps = h, 0
                while k >= 0 and k not in above:
                    k, steps = nodes[k].parent, steps + 1
                place[h] = (1 if k == main else 3, steps)
        return place[h]

    page, most = sum(words) or 1.0, max(words) or 1.0
    paragraphs = sum(b.kind == "p" and b.tag == "p" and h == main for b, h in zip(blocks, home))
    rows = []
    for k, b in enumerate(blocks):
        h = home[k]
        x = nodes[h]
        relation, steps = where(h)
        c = count[h]
        rows.append([
            words[k], density[k], _KINDS[b.kind],
            words[k - 1] if k else 0.0, density[k - 1] if k else 0.0, _KINDS[blocks[k - 1].kind] if k else -1.0,
            words[k + 1] if k + 1 < n else 0.0, density[k + 1] if k + 1 < n else 0.0, _KINDS[blocks[k + 1].kind] if k + 1 < n else -1.0,
            relation, steps, x.controls, c, total[h], plain[h] / max(1.0, total[h]), linked_blocks[h] / c, heads[h],
            total[h] / page, words[k] / page, words[k] / most,
            leaves.get(nodes[b.node].names, 0) if b.node != h and b.kind == "p" else -1.0, paragraphs, k / n,
        ])
    return rows


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 12) -> tuple:
    """A binary decision tree (Gini) as nested tuples (feature, cut, below, above) with 0/1 leaves."""
    ones = y.sum()
    leaf = (int(2 * ones >= len(y)),)
    if depth == 0 or ones in (0, len(y)) or len(y) < 2 * least:
        return leaf
    best = (len(y) * 2.0 * (ones / len(y)) * (1 - ones / len(y)) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        at = at[(at >= least) & (at <= len(y) - least)]
        if not len(at):
            continue
        left, right = c[at - 1], ones - c[at - 1]
        m = len(y) - at
        gini = 2 * (left - left**2 / at) + 2 * (right - right**2 / m)
        k = int(np.argmin(gini))
        if gini[k] < best[0]:
            best = (gini[k], f, (v[at[k] - 1] + v[at[k]]) / 2)
    _, f, cut = best
    if f < 0:
        return leaf
    low = x[:, f] <= cut
    return (f, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the labelled table."""
    rows, labels = [], []
    for page in pages():
        nodes, blocks = read(page)
        for b in blocks:
            labels.append(float(b.text.startswith(MARK)))
            b.text = b.text.replace(MARK, "")
        rows += features(nodes, blocks)
    return np.array(rows, float), np.array(labels)


@lru_cache(maxsize=1)
def tree() -> tuple:
    return grow(*table())


def article(html: str | None, model: tuple) -> list[Block]:
    """The blocks of the article; table cells and controls never count."""
    return article_of(*read(html), model)


def article_of(nodes: list[Node], blocks: list[Block], model: tuple) -> list[Block]:
    """The blocks of the article of a page that has been read."""
    kept = []
    for b, row in zip(blocks, features(nodes, blocks)):
        at = model
        while len(at) > 1:
            at = at[2] if row[at[0]] <= at[1] else at[3]
        if at[0] and b.kind in ("heading", "p", "li", "quote", "pre"):
            kept.append(b)
    return kept


def article_blocks(pages: DataFrame, html: str, keys: list[str], chars: int | None = BLOCK_CHARS) -> DataFrame:
    """``keys`` and one distinct ``block`` a row: the article's blocks, cut to ``chars`` characters, or in full."""
    shared = pages.sparkSession.sparkContext.broadcast(tree())
    schema = pages.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, texts = [], []
            for k, page in enumerate(batch.column(len(keys))):
                found = dict.fromkeys((b.whole() if chars is None else b.text[:chars].rstrip()) for b in article(page.as_py(), model))
                texts += found
                rows += [k] * len(found)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(len(keys))), pa.array(texts, pa.string())], [*keys, "block"])

    return spread(pages.where(F.col(html).isNotNull()).select(*keys, html)).mapInArrow(run, schema.add("block", "string"))
