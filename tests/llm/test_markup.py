"""Markup to clean text and elements (p2), and the minimum cut below it."""

import itertools
import random

import pytest

from siltweave.llm import markup as K
from siltweave.llm.mincut import label


def elements(text, notation="content"):
    return [p for p in K.content_of(text, notation) if p[0] in K.ELEMENTS]


@pytest.mark.parametrize(
    "text,want",
    [
        ("## A `b` ##", [("heading", "A b")]),
        ("Head\n====\n\ntext", [("heading", "Head")]),
        ("<h2>A&nbsp;<b>b</b></h2>", [("heading", "A b")]),
        ("== [[x|y]] ==", [("heading", "y")]),
        ("\\subsection{How [a](b.md) \\emph{c} works}", [("heading", "How a c works")]),
        ("- a **b**\n    - *c*\n2. d", [("list_item", "a b"), ("list_item", "c"), ("list_item", "d")]),
        ("<ul>\n<li>a</li>\n<li>b <i>c</i></li>\n</ul>", [("list_item", "a"), ("list_item", "b c")]),
        ("\\begin{itemize}\\item a\n\\item b\n\\end{itemize}", [("list_item", "a"), ("list_item", "b")]),
        ("```py\na  = 1\nb\n```", [("code", "a = 1 b")]),
        ("~~~\n# no heading\n~~~", [("code", "# no heading")]),
        ("text\n\n    x = 1\n\n    y\n\ntext", [("code", "x = 1 y")]),
        ("<pre>a &lt; b</pre>", [("code", "a < b")]),
        ("$$x_{1}$$\n\n\\[y\\]\n\n\\(z\\)\n\n$w^2$", [("formula", "x_{1}"), ("formula", "y"), ("formula", "z"), ("formula", "w^2")]),
        ("\\begin{equation}\na\n\\end{equation}", [("formula", "a")]),
        ("It costs $5 and $6.", []),
        ("*whole line*", []),
        ("a<ref>no</ref><!-- - no -->", []),
        ("```\nnever closed", [("code", "never closed")]),
        ("", []),
    ],
)
def test_content(text, want):
    assert elements(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("=A=\n== ''B'' ==", [("heading", "A"), ("heading", "B")]),
        ("*a [http://x y]\n** '''b'''<ref name=r>q</ref>\n#c {{Icon|i}}", [("list_item", "a y"), ("list_item", "b"), ("list_item", "c")]),
        (':<math>x < y</math>\n<math display="block">\nz\n</math>', [("formula", "x < y"), ("formula", "z")]),
        ('<syntaxhighlight lang="js">\n* no\n</syntaxhighlight><pre>p</pre>', [("code", "* no"), ("code", "p")]),
        ("{{Infobox\n| name = x\n}}\n[[Category:C]]\n{|\n! a\n|-\n| b\n|}\n[[File:a.png|thumb|c]]", []),
    ],
)
def test_wikitext(text, want):
    assert elements(text, "wikitext") == want


def test_html():
    html = '<h2><span class="mw-headline">A <code>b</code></span></h2><ul><li>x<ul><li>y</li></ul></li></ul><div class="mw-highlight"><pre><span></span>c</pre></div><span class="math">\\(m\\)</span><img class="tex" alt="n &lt; 1">'
    assert elements(html, "html") == [("heading", "A b"), ("list_item", "x"), ("list_item", "y"), ("code", "c"), ("formula", "m"), ("formula", "n < 1")]


def test_clean_text():
    assert K.clean_text(K.content_of("# A\n\ntext *b*\n\n- c", "content")) == "# A\ntext b\n- c"


@pytest.mark.parametrize(
    "notation,text,want",
    [
        ("content", "a b\n\n```py\nif x:\n    y  = 1\n```\n\nc d", "a b\n```\nif x:\n    y  = 1\n```\nc d"),
        ("content", "a b\n\n    if x:\n        y\n\nc d", "a b\n```\nif x:\n    y\n```\nc d"),
        ("content", "a b\n\n| N | [l](x) |\n|---|:-:|\n| **u** | 3 |\n\nc d", "a b\nN | l\nu | 3\nc d"),
        ("wikitext", "a b\n<pre>\nif x:\n  y &lt; 1\n</pre>\nc d", "a b\n```\nif x:\n  y < 1\n```\nc d"),
        ("wikitext", "{{Box\n| n = x\n}}\na b\n{| class=\"w\"\n|+ Cap\n! A !! B\n|-\n| style=\"x\" | [[p|q]] || 2\n|}\nc d", "a b\nCap\nA | B\nq | 2\nc d"),
        ("html", "<p>a b</p><pre>if x:\n    y</pre><table><tr><th>A<th>B</tr><tr><td>u<td>2</td></tr></table><p>c d</p>", "a b\n```\nif x:\n    y\n```\nA | B\nu | 2\nc d"),
    ],
)
def test_clean_whole(spark, notation, text, want):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    assert K.cleaned(df, "id", "t", notation).collect()[0].text == want


def energy(costs, edges, x):
    return sum(c[0] if k else c[1] for c, k in zip(costs, x)) + sum(w for i, j, w in edges if x[i] != x[j])


def test_cut_is_minimal():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 8)
        costs = [(r.random(), r.random()) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.random()) for _ in range(r.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]
        best = min(energy(costs, edges, x) for x in itertools.product((True, False), repeat=n))
        assert abs(energy(costs, edges, label(costs, edges)) - best) < 1e-9


def test_frame(spark):
    rows = [(1, "# A\n# A"), (2, None), (3, ""), (1, "# A"), (4, "- x\n" * 20000 + "- y"), (None, "# N")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(map(tuple, K.elements(df, "id", "t", "content").collect()), key=str)
    assert got == sorted([(1, "heading", "A"), (1, "heading", "A"), (4, "list_item", "x"), (4, "list_item", "y"), (None, "heading", "N")], key=str)
    assert K.cleaned(df, "id", "t", "content").count() == 5
    assert K.elements(df.where("false"), "id", "t", "content").count() == 0


def test_menu_and_notices_leave_the_text():
    text = "Home | About | Contact\n\n# Mill\n\nThe miller carries a heavy shield along the road.\n\n- [Home](/)\n- [Login](/l)\n- [Search](/s)\n\nCookie notice: accept\n\nShare this page on social media"
    assert K.clean_text(K.content_of(text, "content")) == "# Mill\nThe miller carries a heavy shield along the road."


def test_the_cut_decides():
    """Without the cut the fields of a template are items; with unary costs alone lines in doubt fall otherwise."""
    text = "{{Box\n| name = x\n| hp = 3\n* The guard opens the gate.\n}}\n* The king finds three coins."
    parts = K.segments(text, True)
    assert [t for k, t, _, _ in parts if k == "list_item"] == ["name = x", "hp = 3", "The guard opens the gate.", "The king finds three coins."]
    assert K.content_of(text, "wikitext") == [("list_item", "The king finds three coins.")]


def test_neighbours_settle_doubtful_lines():
    model = K.classifier() | {"coef": [0.0] * len(K.FEATURES)}
    lean = {"a": -3.0, "b": 0.2, "c": -3.0}
    parts = [("text", t, "", 1) for t in "abc"]
    costs = [(max(z, 0.0), max(-z, 0.0)) for z in lean.values()]
    assert label(costs, []) == [True, False, True]
    assert label(costs, K.edges_of([p for *_, p in parts])) == [True, True, True]
    assert len(K.energies(parts, model)) == 3


def test_held_out_segments():
    from siltweave.llm.labelled_segments import MARK, documents

    right = total = 0
    for notation, text, half in documents(150, seed=91):
        parts, linked, distance = K._read(text, notation, False)
        marks = [MARK in t or k in ("code", "formula") for k, t, _, _ in parts]
        parts = [(k, t.replace(MARK, "") or "x", raw.replace(MARK, ""), p) for k, t, raw, p in parts]
        model = K.classifier() | {"words": K.weights("site", 1 - half)}
        got = label(K.energies(parts, model, linked), K.edges_of([p for *_, p in parts], distance))
        right += sum(a == b for a, b in zip(got, marks))
        total += len(parts)
    assert right / total > 0.95


def test_long_document_is_cut():
    import time

    r = random.Random(5)
    n = 10_000
    costs = [(max(z, 0.0), max(-z, 0.0)) for z in (r.gauss(0, 0.5) for _ in range(n))]
    began = time.time()
    assert len(label(costs, K.edges_of([k // 50 for k in range(n)]))) == n
    assert time.time() - began < 30


def test_no_length_bounds():
    long = "x_{1} + " * 100 + "y"
    assert elements(f"It is ${long}$ here.") == [("formula", long)]
    assert elements("{{Box\n| " + "k" * 300 + " = v\n}}\n* The king finds three coins.", "wikitext") == [("list_item", "The king finds three coins.")]
