"""The document kernels on small fixtures (K*, WT*, FN14, J19)."""

import pytest

from siltweave.functions.dom import parse
from siltweave.operators import markdown as M
from siltweave.operators import media
from siltweave.operators import wikitext as W


def md(html, **rules):
    return M.convert(html, M.Rules(**rules))["markdown"]


@pytest.mark.parametrize(
    "selector,n", [("p", 2), (".a", 1), ("#x", 1), ("div p", 1), ("div > p", 0), ("[data-k]", 2), ("[data-k=v1]", 1), ("[data-k^=v]", 2), ("[data-k*=2]", 1), ("p, .a", 3), ("section > p.q", 1)]
)
def test_selectors(selector, n):
    root = parse('<div class="a b" data-k="v1"><section data-k="v2"><p class=q>1</p></section></div><p id=x>2')
    assert len(root.select(selector)) == n


def test_selector_error():
    with pytest.raises(ValueError):
        parse("<p>").select("p:hover")


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        (None, ""),
        ("<h1>A</h1><h3>B</h3>", "## A\n\n### B"),
        ("<p>a <b>b</b>, <i>c</i><p>d", "a **b**, *c*\n\nd"),
        ("<ul><li>1<ol><li>2<li>3</ol><li>4</ul>", "- 1\n  1. 2\n  2. 3\n- 4"),
        ("<pre>a\n  b</pre>", "```\na\n  b\n```"),
        ("<blockquote><p>x</p><p>y</p></blockquote>", "> x\n>\n> y"),
        ("<p>a<br>b</p><hr>", "a\nb\n\n---"),
        ('<a href="javascript:x()">t</a>', "t"),
        ("<script>var s = '<p>no</p>';</script><p>yes", "yes"),
        ("<p>&amp;amp; caf&eacute;", "&amp; café"),
        ('<div style="display: none"><p>no</div><p>yes', "yes"),
    ],
)
def test_blocks(html, want):
    assert md(html) == want


def test_links():
    assert md('<a href="/wiki/B">b</a>', domain="w.example") == "[b](https://w.example/wiki/B)"
    assert md('<a href="/wiki/B">b</a>') == "[b](/wiki/B)"
    assert md('<a href="//x/y">b</a> <a href="#s">c</a>', domain="w.example") == "[b](https://x/y) [c](#s)"


def test_images_and_skip():
    r = M.convert('<img data-src="/a.png" src="/lazy.gif" alt="A"><img src="/icons/i.png">', M.Rules(domain="w.example", skip_images=("/icons/",)))
    assert r["images"] == ["https://w.example/a.png"]


def test_grid_spans():
    html = "<table><tr><th rowspan=2>a<th colspan=2>b<tr><th>c<th>d<tr><td>1<td>2<td>3</table>"
    grid, heads = M.Renderer(M.Rules()).grid(parse(html).first("table"))
    assert grid == [["a", "b", "b"], ["a", "c", "d"], ["1", "2", "3"]] and heads == 2
    assert M.transposed(grid, heads) == [["a", "1"], ["b → c", "2"], ["b → d", "3"]]


def test_grid_limits():
    assert len(M.Renderer(M.Rules()).grid(parse("<table><tr><td colspan=999>x</table>").first("table"))[0][0]) == M.MAX_COLUMNS
    assert M.largest_table("<table></table>") == ""
    r = M.convert("<table><tr><td>a<table><tr><td>b</table></td></tr></table>", M.Rules())
    assert "nested_table" in r["warnings"]


def test_infobox():
    html = (
        '<aside class="box"><div class="pi-data" data-source="id"><h3 class="pi-data-label">ID</h3><div class="pi-data-value"><span class="infobox-nav-cur">7</span> 8</div></div>'
        '<div class="pi-data" data-source="n"><h3 class="pi-data-label">N</h3><div class="pi-data-value"><img alt="h"><img alt="h"></div></div>'
        '<div class="pi-data"><h3 class="pi-data-label"></h3><div class="pi-data-value">x</div></div><div class="pi-data"><h3 class="pi-data-label">E</h3></div></aside><p>t'
    )
    r = M.convert(html, M.Rules(infobox=".box", handlers={"ID": "extract_cur_id", "n": "count_images"}))
    assert r["infobox"] == [("ID", "7"), ("N", "2× h"), ("E", "")]
    assert r["markdown"].startswith("## Infobox") and r["markdown"].endswith("t")


@pytest.mark.parametrize("parts,want", [(["a", "b"], "a b"), (["a", ",", "b"], "a, b"), (["(", "a", ")"], "(a)"), (["a", "\n", "b"], "a\nb"), ([], "")])
def test_join_inline(parts, want):
    assert M.join_inline(parts) == want


def test_templates():
    assert W.templates("a {{b|{{c}}}} d {{e") == ["{{b|{{c}}}}"]
    assert W.arguments("{{n|x|k = {{a|b}}|[[p|q]]}}") == ("n", ["x", "[[p|q]]"], {"k": "{{a|b}}"})
    assert W.expand("{{I|7}} {{J|k=2}} {{Z}}", {"I": "<%s>", "J": "%(k)s!"}) == ("<7> 2! {{Z}}", ["Z"])
    assert W.front_fields("{{x}}{{Box|A|name = [[N|n]]}}", ["name", "hp"], ["hp"]) == {"name": "n", "hp": "A"}
    assert W.remaining("{{Main|A}} {{#dpl:x}} {{for|y}}") .strip().startswith("See also: A")


def test_wikitable():
    assert W.table_markdown('{| class="w"\n! a !! b\n|-\n| style="x" | 1 || 2\n|-\n| 3\n|}') == "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"


def test_wikitext():
    text, warnings, front = W.convert("{{Info\n| hp = 3\n}}\n== H ==\n'''b''' ''i'' [[A|x]]<!-- c -->\n* l\n** m\n[[Category:Z]]", "T", fields=("hp",))
    assert text == "# T\n\n## H\n**b** *i* [x](/wiki/A)\n- l\n  - m" or text.startswith("## H")
    assert front["hp"] == "3" and warnings == []
    assert W.convert(None, "T")[0] == "# T"


def test_media_matching():
    posts = [(1, "My First Film"), (2, "Long Enough Title"), (3, "none")]
    files = [("/a", "my first film.mp4"), ("/b", "Long Enough Title_1080p.mp4"), ("/c", "long enough title.mp4")]
    assert media.pairs(posts, files) == [(1, "/a", 1), (2, "/c", 1)]
    assert media.pairs([(1, "Ｌong－Enough Title")], [("/b", "Long Enough Title_1080p.mp4")]) == [(1, "/b", 2)]
