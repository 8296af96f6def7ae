"""p1 on messages, fields and filler that are worded otherwise than the labelled lines."""

from siltweave.llm import residue as R

ARTICLE = "The miller takes the long road to the mill every day. In winter he walks it twice, and the dog comes along. Nobody in the village knows a better way, though many have looked for one. "

MESSAGES = (
    "Uh oh! That page can't be found.", "JavaScript is not available.", "Account suspended. Contact your hosting provider for more information.", "您要找的页面走丢了。", "# 418\n\nWe're having trouble showing this right now.", "This video is private.", "Whoops, looks like something broke.",
    "The requested URL was not found on this server.", "# Hold tight\n\nWe are verifying your connection before you can proceed.", "You don't have authorization to view this page.", "Application error: a client-side exception has occurred (see the browser console for more information).",
    "The site owner may have set restrictions that prevent you from accessing the site.", "# 503\n\nBackend unavailable, guru meditation.", "Site temporarily unavailable due to planned works.", "We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue.",
    "This domain has expired. Is this your domain? Renew now.", "Leider ist diese Seite nicht mehr verfügbar.", "Für diese Anwendung muss JavaScript aktiviert sein.", "Ein unbekannter Fehler ist aufgetreten. Bitte versuchen Sie es noch einmal.", "Sie wurden blockiert.", "网络连接失败，请检查后重试。", "很抱歉，您没有权限查看此内容。",
    "请开启浏览器的JavaScript功能。", "内部服务器错误", "# Page missing\n\nMaybe it was moved or deleted.", "Database error: could not connect.", "Your IP has been temporarily banned.", "Security check: complete the puzzle to continue.", "The connection to the server was lost.", "Request could not be satisfied.",
)
SHORT_ARTICLES = ("# Short\n\nThe cat sleeps.", "The blacksmith repairs swords for two coins.", "# Riverside\n\nA quiet place with an inn and a well.", "The page boy serves the king at the table.", "Der Wirt schenkt Bier aus.", "村长给你三把钥匙。", "Error bars show the spread of the damage.", "# Patch 1.2\n\nFixed the sound of the door.", "The gate is closed at night.", "Nobody found the treasure.")


def test_held_out_messages():
    found = sum(R.of_content(m) == ["error"] for m in MESSAGES)
    assert found >= 0.8 * len(MESSAGES)  # 25 of 30 when this was written


def test_short_articles_are_no_messages():
    assert [a for a in SHORT_ARTICLES if R.of_content(a)] == []


def test_explained_fields_in_prose():
    for t in ("In this tutorial the placeholder {{name}} is replaced by the name of the player.", "On Windows you add the tool to %PATH% and open a new terminal.", "The shell expands ${HOME} to the directory of the user.", "A variable such as {user} stands for whoever is logged in."):
        assert R.of_content(f"{ARTICLE}\n\n{t}\n\n{ARTICLE}") == []


def test_density_tells_a_template():
    """A page that is little but fields is a case though it speaks of templates; long bodies count like short ones."""
    assert R.of_content("Template: {{a.b}} {{c.d}} {{e.f}}") == ["field"]
    assert R.of_content(f"{ARTICLE} {{% include {'x' * 500} %}}") == ["field"]
    assert R.of_content(f"{ARTICLE}\n\n| HP | {{{{hp}}}} |\n| --- | --- |") == ["field"]


def test_held_out_filler():
    for t in ("Vivamus lacinia tempus augue nunc pretium felis nibh sodales.", "Hier steht bald der richtige Text.", "Description coming soon.", "blah blah blah blah", "Your headline goes here", "请在此输入内容。"):
        assert R.of_content(f"{ARTICLE}\n\n{t}\n\n{ARTICLE}") == ["filler"]
    late = "The first words are honest and say what the house is made of before " + "dolor sit amet consectetur adipiscing elit tempor " * 12
    assert R.of_content(f"{ARTICLE}\n\n{late}\n\n{ARTICLE}") == ["filler"]


def test_long_messages():
    long = "We could not process your request because the server did not respond. " * 12
    assert R.of_content(long) == ["error"]


def test_article_that_was_only_missed():
    """Sentences of an article on a page whose article the classifier doesn't find are no reason to report its notices."""
    from siltweave.llm.main_content import tree

    notice = "<noscript>Please enable JavaScript.</noscript>"
    shell = f"<body>{notice}<div class=b><p>We use cookies to count visits.</p><button>OK</button></div><div id=app></div></body>"
    assert R.of_html(shell, tree(), False) == ["error"]
    short = f"<body>{notice}<div class=x><div class=y>The cat sleeps on the old mat. The dog finds three coins behind the mill.</div></div><div class=b><p>We use cookies to count visits.</p><button>OK</button></div></body>"
    assert R.of_html(short, tree(), False) == []


def test_field_beside_a_far_word():
    """A word that could explain a field does not do so from the other end of a sentence, nor one field all others."""
    assert R.of_content(f"{ARTICLE} The syntax of the old song is known to all who live in the long valley of {{{{name}}}} today. {ARTICLE}") == ["field"]
    assert R.of_content(f"{ARTICLE} The template {{{{a.b}}}} is replaced. {ARTICLE} The king {{{{c.d}}}} sleeps. {ARTICLE}") == ["field"]


def test_parts_of_other_words_explain_nothing():
    assert R.of_content(f"{ARTICLE}\n\n{{summary}} 相对独立的不变量听到旧钟，参数化的门打开。\n\n{ARTICLE}") == ["field"]
    assert R.of_content(f"{ARTICLE}\n\n变量 {{summary}} 在这里说明。\n\n{ARTICLE}") == []
