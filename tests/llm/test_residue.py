"""Template residue, filler and error pages (p1)."""

import pytest

from siltweave.llm import residue as R
from siltweave.llm.main_content import tree

ARTICLE = "The miller takes the long road to the mill every day. In winter he walks it twice, and the dog comes along. Nobody in the village knows a better way, though many have looked for one. "


@pytest.mark.parametrize(
    "text",
    ["{{ user.name }}", "{{{title|}}}", '{{$t("a.b")}}', "${order.id}", "#{name}", "{% block x %}", "<%= a.b %>", "%%DATE%%", "__PRICE__", "@@name@@", "<<title>>", "[INSERT NAME HERE]", "[title goes here]", "[Your Author]", "[TBD: price]", "[hier preis eintragen]", "【此处填写name】", "$[NAME]", "{0}", "{author}", "undefined undefined", "[object Object]"],
)
def test_fields(text):
    assert R.of_content(f"# T\n\n{ARTICLE}{text} more words") == ["field"]
    assert R.of_html(f"<p>{ARTICLE}{text.replace('&', '&amp;').replace('<', '&lt;')} more", tree(), True) == ["field"]


@pytest.mark.parametrize(
    "text",
    ["```\nx = {{ a.b }}\n```", "    y = ${z}\n", "Use `{{ name }}` there.", "$x_{12} = \\frac{a}{b}$", "\\section{name}", "\\textbf{author}", "<pre>{{ a.b }}</pre>", "[text](http://a/{0}b)", "He wrote “{{name}}” on it.", "<!-- {{ x.y }} -->", "$$E(x) = p_{m}$$", "snake__CASE__x"],
)
def test_no_fields(text):
    assert R.of_content(f"{ARTICLE}\n\n{text}\n\n{ARTICLE}") == []


@pytest.mark.parametrize("text", ["Lorem ipsum dolor sit amet elit.", "TODO TODO TODO 12", "■■■■ ■■ ■■■ 3", "Text goes here. Text goes here.", "Dies ist ein Blindtext. Inhalt folgt in Kürze.", "这里是示例文字。内容待补充。", "asdf qwer foo asdf foo"])
def test_filler(text):
    assert R.of_content(f"{ARTICLE}\n\n{text}\n\n{ARTICLE}") == ["filler"]


@pytest.mark.parametrize("text", ["The lorem ipsum posters in the tavern are a joke.", "The word placeholder in the script stands for him.", "Weiter unten folgt der vollständige Vergleich."])
def test_no_filler(text):
    assert R.of_content(f"{ARTICLE}\n\n{text}") == []


@pytest.mark.parametrize(
    "text",
    ["# 404\n\nThe page you asked for could not be found.", "Please enable JavaScript to view this page.", "请先完成安全验证再继续浏览。\n\nMok/1.2", "## Zugriff verweigert\n\nIhnen fehlt die Berechtigung.", "Something went wrong on our end. Reference 12.", "© 2021 A. All rights reserved.\n\nBad Gateway"],
)
def test_errors(text):
    assert R.of_content(text) == ["error"]


@pytest.mark.parametrize("text", ["", "   \n ", "# Short\n\nThe cat sleeps.", "A sign reading “access denied” marks the vault.", ARTICLE * 2 + "\n\nPlease enable JavaScript to view this page.", "Mods need JavaScript to be enabled in the editor before it can load."])
def test_no_errors(text):
    assert R.of_content(text) == []


def test_page_with_noscript():
    page = f"<body><noscript>Please enable JavaScript.</noscript><nav><ul><li><a href=/a>Home</a></ul></nav><main><h1>T</h1><p>{ARTICLE}</p><p>{ARTICLE}</p></main></body>"
    assert R.of_html(page, tree(), False) == []
    assert R.of_html("<body><main><h1>Not Found</h1><p>Nothing lives at this address any more.</p></main><footer><p>© 2020 A. All rights.</p></footer></body>", tree(), False) == ["error"]


@pytest.mark.parametrize("notice", ["You need to enable JavaScript to run this app.", "<p>This site requires <b>scripts</b>.</p><p>Turn them on in your browser settings and reload.</p>", "需要允许运行脚本才能继续浏览。"])
def test_script_shell(notice):
    notice, nav = f"<noscript>{notice}</noscript>", "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    assert R.of_html(f"<html><head><title>T</title></head><body>{notice}<div id=app></div></body></html>", tree(), False) == ["error"]
    assert R.of_html(f"<body>{notice}{nav}<div id=app></div></body>", tree(), False) == ["error"]
    assert R.of_html(f"<body>{notice}<main><h1>T</h1></main></body>", tree(), False) == ["error"]
    assert R.of_html(f"<p>{notice}</p>", tree(), True) == ["error"]
    assert R.of_html(f"<body>{notice}<main><h1>T</h1><p>The cat sleeps on the mat.</p></main></body>", tree(), False) == []
    assert R.of_html(f"<body>{notice}<main><table><tr><td>HP<td>12</table></main></body>", tree(), False) == []
    assert R.of_html("<body><noscript><img src=x.gif></noscript><div id=app></div></body>", tree(), False) == []


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "{{ a.b }} " + ARTICLE, "x"), (3, "{{ a.b }} " + ARTICLE, "x"), (4, ARTICLE * 3000 + "%%END%%", "x"), (None, "Bad Gateway", "y")]
    df = spark.createDataFrame(rows, "id long, t string, rec_id string")
    assert sorted(map(tuple, R.residues(df, "id", "t").collect()), key=str) == sorted([(3, "field"), (3, "field"), (4, "field"), (None, "error")], key=str)
    assert R.residues(df.where("false"), "id", "t").count() == 0
