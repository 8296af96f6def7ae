"""The article of a page (p5)."""

import pytest

from siltweave.llm import main_content as M
from siltweave.llm.html_blocks import read
from siltweave.llm.labelled_pages import MARK, pages

TEXT = "The miller takes the long road to the mill every day, and in winter he walks it twice with the dog. "
NAV = "<ul>" + "".join(f'<li><a href="/{k}">Entry {k}</a></li>' for k in range(6)) + "</ul>"


def texts(html):
    return [b.text for b in M.article(html, M.tree())]


@pytest.mark.parametrize("frame", ['<header><nav>%s</nav></header><main><article>%s</article></main><footer><p>© 2020 Mill. All rights reserved.</p>%s</footer>', '<div class="q1">%s</div><div class="q2"><div class="q3">%s</div></div><div class="q4"><p>Run by volunteers of the mill.</p>%s</div>'])
def test_layouts(frame):
    body = f'<h1>Mill</h1><p>{TEXT}</p><div class="z7"><p>Join our letter today.</p><input type="email"></div><h2>Road</h2><p>{TEXT}<p>{TEXT}<ul><li>one<ul><li>two</ul><li>three</ul><pre>code 1</pre><blockquote><p>quoted words</p></blockquote><table><tr><td>c</td></tr></table>'
    got = texts("<html><body>" + frame % (NAV, body, NAV) + '<div class="k9"><p>We use cookies to count visits of this site.</p><button>OK</button></div>')
    assert got[0] == "Mill" and {"Road", "one", "two", "three", "code 1", "quoted words"} <= set(got)
    assert not {"Join our letter today.", "c", "Entry 1", "OK"} & set(got) and not any("cookies" in t or "volunteers" in t or "©" in t for t in got)


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<p", "</div></p>", "<!-- x", "<script>alert('<p>')", "plain text", "<td>x<td>y", "<li>a<li>b"])
def test_broken(html):
    nodes, blocks = read(html)
    assert len(M.features(nodes, blocks)) == len(blocks)
    M.article(html, M.tree())


def test_reader():
    _, b = read("<p>a<b>b</b>&amp;&nbsp;c<!-- no --><script>x='<p>no</p>'</script><p>d<div>e<br>f</div><noscript>no</noscript>")
    assert [x.text for x in b] == ["ab& c", "d", "e f"]


def test_held_out_accuracy():
    right = total = 0
    for page in pages(120, seed=77):
        nodes, blocks = read(page)
        labels = [b.text.startswith(MARK) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MARK, "")
        for b, row, y in zip(blocks, M.features(nodes, blocks), labels):
            at = M.tree()
            while len(at) > 1:
                at = at[2] if row[at[0]] <= at[1] else at[3]
            right += bool(at[0]) == y
            total += 1
    assert right / total > 0.97


def test_frame(spark):
    page = f"<body><main><h1>A</h1><p>{TEXT}</p><p>{TEXT}</p></main></body>"
    df = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (4, f"<body><main>{f'<p>{TEXT}' * 3000}", "x")], "id long, h string, block string")
    got = sorted(map(tuple, M.article_blocks(df, "h", ["id"]).collect()))
    assert got == sorted([(1, "A"), (1, TEXT[:40].rstrip())] * 2 + [(4, TEXT[:40].rstrip())])


def test_code_in_full(spark):
    text = "The miller takes the long road to the mill every day. In winter he walks it twice, and the dog comes along. "
    page = f"<body><main><h1>T</h1><p>{text * 3}</p><pre>if x:\n    y = 1\n</pre><p>{text * 3}</p></main></body>"
    df = spark.createDataFrame([(1, page)], "id long, html string")
    assert "if x:\n    y = 1" in [r.block for r in M.article_blocks(df, "html", ["id"], None).collect()]
