"""Problem 1: records that hold template residue, filler, or an error page in place of an article.

Three findings, each on the article text only (of a web page: the blocks that
:mod:`siltweave.llm.main_content` keeps; of a converted text: its lines, table rows included for fields):

* ``field``: a template field that was never replaced. Every delimiter pair has its own small
  grammar for what may stand between the delimiters. Code blocks, inline code, formulas and
  LaTeX arguments are taken out first, and a field in quotation marks is a mention. Of the rest a
  field is explained where its sentence speaks of templates, variables or settings beside it. The record is a case when
  bare fields are at least as many as explained ones, or when fields stand as densely as in a template
  that was never filled at all (DENSE characters of text a field or less), however it is worded.
* ``filler``: a paragraph that only fills space: running text without the function words that every
  language needs, one word or a few over and over, masked letters, or sentences most of whose words
  speak of text that is still to come.
* ``error``: a record with an error, refusal, waiting or missing-page message or a demand to allow
  scripts, and without an article: what paragraphs of several sentences, or long ones, it has are
  messages themselves or come to less than ARTICLE characters. Messages are told by a status code or by
  word weights fitted on the labelled lines of :mod:`siltweave.llm.labelled_lines`, against both article sentences
  and the lines that sites put around articles. Quoted messages and notices beside an article do not count; a noscript
  notice counts only where the page shows no article text and no table.

All of it is one Arrow pass a table without a shuffle.

Defined results: null, empty and blank texts are no case; a record with several findings has a row
for each; repeated rows repeat in :func:`residues`; very long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.llm.html_blocks import read
from siltweave.llm.labelled_lines import leaning, weights
from siltweave.llm.main_content import article_of, tree
from siltweave.llm.words import HAN
from siltweave.session import spread

_NAME = r"[A-Za-z_][\w-]*(?:\.[\w-]+)*"
#: One grammar a delimiter pair.
FIELDS = re.compile(
    "|".join((
        r"\{\{\{\s*" + _NAME + r"\s*(?:\|[^{}\n]*)?\}\}\}",
        r"\{\{[-~#/]?\s*(?:" + _NAME + r"(?:\s*\|\s*[a-z_]+(?:\([^()\n]*\))?)*|\$?\w+\(\s*[\"'][^\"'\n]+[\"']\s*\))\s*[-~]?\}\}",
        r"\{%[-+]?\s*[a-z]\w*(?:\s[^%{}\n]*)?[-+]?%\}",
        r"<%[-=#]?\s*[^%<>\n]+%>",
        r"<\?(?:php|=)\s[^?<>\n]+\?>",
        r"\$\{\s*" + _NAME + r"\s*\}",
        r"#\{\s*" + _NAME + r"\s*\}",
        r"\$\[[A-Za-z_]{2,}\]",
        r"%%[A-Za-z_][\w.-]*%%",
        r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])",
        r"%\([A-Za-z_]\w*\)[sdf]\b",
        r"(?<![\w_])__[A-Z][A-Z_]+__(?![\w_])",
        r"(?<![\w@])@@\w{2,}@@(?![\w@])",
        r"<<\s*[A-Za-z_][\w .-]+>>",
        r"\[(?:INSERT|ENTER|ADD|FILL IN|YOUR|PUT|TBD|TODO|TBA|FIXME|PLACEHOLDER)\b[^\]\[\n]*\](?!\()",
        r"\[(?:Your|Insert|Enter|Add|Put|Ihr|Ihre|Dein|Deine)\s[\w ,'-]+\](?!\()",
        r"\[[\w ,'-]+ (?:goes|comes|to go) here\](?!\()",
        r"\[(?:hier|bitte)\b[^\]\[\n]+(?:eintragen|einfügen|einsetzen|ergänzen|ausfüllen)\](?!\()",
        r"[【\[](?:此处|此處|请在此|请|在此)[^】\]\n]*?(?:填写|输入|插入|添加)[^】\]\n]*[】\]]",
        r"\b(?:undefined(?: undefined)+|null(?: null)+|NaN(?: NaN)+)\b",
        r"\[object Object\]",
        r"(?<![\w\\})\]>^_{$#%@])\{(?:[A-Za-z][A-Za-z_]+(?:\.[A-Za-z_]+)*|\d{1,2})\}(?![\w}(])",
    ))
)
_OPENER = re.compile(r"[{%$#@\[【]|__|<[<%?]|\b(?:undefined undefined|null null|NaN NaN)\b")
_QUOTED = ("“”", "„“", "‘’", "「」", "『』", "«»", '""', "''", "‚‘", "„”", "``")
#: Words that, NEARBY characters or less from a field in its sentence, explain it instead of forgetting it.
_EXPLAINS = re.compile(
    r"\b(?:templates?|placeholders?|variables?|syntax|snippets?|parameters?|arguments?|macros?|tokens?|markup|brackets|braces|replaced|substituted|expands?|stands? for|tutorial|environment|shell|terminal|command|director(?:y|ies)|folder|"
    r"Vorlagen?|Platzhalter\w*|Variablen?|Parameter|Klammern|ersetzt|steht für|Umgebungs\w+|Ordner|Verzeichnis|Befehl)\b|模板|占位符|(?<!不)变量|语法|参数(?!化)|替换为|表示|环境|命令|目录",
    re.I,
)
NEARBY = 45
#: Characters of text a field in a template that was never filled.
DENSE = 60

_FUNCTION_WORDS = frozenset(
    "the a an of and or to in on at by for with from as is are was were be been it its this that these those he she they we you i his her their our your not no but if when while than then so who which what there into over under after before has have had do does can will would against near behind during between beyond beside through although because always never often again now soon still also only very more most any some each every both such than about up down out off yet how why where just whose whom until since without within under over "
    "der die das den dem des ein eine einen einem einer und oder nicht ist sind war im in am an auf aus bei mit nach von vor zu zum zur für es er sie wir ihr sich als wie wenn dass doch aber hat haben wird werden kann noch nur auch "
    "le la les un une des et est dans que qui pour pas sur avec el los las una y es en que por con del se no il lo gli di che per non de het een van op te met voor och att det som en på er til af og o os as um uma do da em não com".split()
)
_HOLDERS = frozenset("placeholder filler dummy sample example lorem ipsum blindtext platzhalter platzhaltertext mustertext beispieltext beispielabsatz beispielsatz beispielinhalt fülltext blind".split())
_ABOUT_TEXT = frozenset("text texts content copy paragraph paragraphs sentence sentences description title caption summary headline words body absatz satz inhalt inhalte beschreibung überschrift titel zusammenfassung blindtext platzhaltertext beispieltext beispielabsatz mustertext".split())
_TO_COME = frozenset("here goes follow follows coming soon later replace insert add added enter ignore tba tbd todo launch fill filling space box another more some please just hier folgt folgen steht stehen kommt bald später kürze ersetzen einfügen ergänzen ignorieren bitte weitere dies kurz".split())
_FILLING = _HOLDERS | _ABOUT_TEXT
_HAN_HOLDER = re.compile(r"占位|示例|样例|测试|填充")
_HAN_TO_COME = re.compile(r"(?:内容|正文|描述|文字|标题|段落).{0,2}(?:待|稍后|即将)|请(?:在此)?(?:替换|填写|输入)|在此(?:填写|输入)")
_HAN_LEXICON = re.compile(r"占位|示例|样例|测试|填充|这里|此处|此段|这段|本段|在此|文字|文本|内容|段落|正文|描述|标题|替换|补充|添加|填写|输入|稍后|即将|推出|待|请|您的|你的|这|此|是|为|的|符|用|于|一|个|段")
_SENTENCE = re.compile(r"[^.!?。！？…]*[.!?。！？…]+[”\"“»]*|[^.!?。！？…]+$")
_ONE_LETTER = re.compile(r"^(?:(.)\1+|[■█▇▆□▒░●*_\-.…]+|\d+)$", re.I | re.S)
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_STATUS = re.compile(r"^(?:http|error|status|fehler|错误)?[\s:#/.\d-]{0,8}\b[45]\d\d\b(?:\W|$)", re.I)
_QUOTE_PAIR = re.compile(r"“[^”“]*[”“]|„[^“”]*[“”]|「[^」]*」|\"[^\"\n]*\"")
#: An article paragraph has several sentences or PARAGRAPH characters; a record whose such paragraphs
#: come to ARTICLE characters shows an article. Chinese characters count threefold.
PARAGRAPH, ARTICLE = 130, 250
#: The least mean log odds of a message.
MESSAGE = 0.55
_STOPS = re.compile(r"[.!?。！？…](?:\s|$|(?=[^\x00-\u2fff]))")

_CODE = re.compile(
    r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)"
    r"|<(pre|code|syntaxhighlight|source|nowiki|math|kbd|samp|tt)\b[^>]*>.*?</\2\s*>"
    r"|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\\begin\{(equation|align|verbatim|lstlisting|math|displaymath)\*?\}.*?\\end\{\3\*?\}"
    r"|(?<![\w$\\])\$(?![{\[\s$])[^$\n]+?(?<!\s)\$(?![\w$])"
    r"|(`+)(?!`)[^\n]*?(?<!`)\4(?!`)"
    r"|<!--.*?-->|<ref\b[^>]*?/>|<ref\b.*?</ref>",
    re.S | re.M | re.I,
)
_CODE_HTML = re.compile(r"<(pre|code|kbd|samp|tt|math)\b[^>]*>.*?</\1\s*>|<(span|div)\s+class=\"math[^>]*>.*?</\2\s*>", re.S | re.I)
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s")
_LEAD = re.compile(r"^\s*(?:#{1,6}\s+|={1,6}\s*|>\s*|[-*+•#:;]+\s+|\d+[.)]\s+|\\(?:sub)*section\{|\\item\s+)+")
_TAIL = re.compile(r"(?:\s*(?:#{1,6}|={1,6})|\})\s*$")
_HEAD = re.compile(r"^\s*(?:#{1,6}\s|={1,6}[^=]|\\(?:sub)*section\{|<h[1-6])")
_TAGS = re.compile(r"(?<!<)</?[a-zA-Z][^<>]*>(?!>)")


def lines_of(content: str) -> list[tuple[str, bool]]:
    """(text, heading?) of the lines of a converted text without code and formulas."""
    text = _CODE.sub(" ", content)
    if "\n    " in text or text.startswith("    ") or "\t" in text:
        kept, code, listed, blank = [], False, False, True
        for line in text.split("\n"):
            deep = line.startswith(("    ", "\t"))
            if not line.strip():
                blank = True
            elif deep and not listed and (blank or code):
                code, blank = True, False
                continue
            else:
                listed = bool(_ITEM.match(line)) or listed and (deep or not blank)
                code, blank = False, False
            kept.append(line)
        text = "\n".join(kept)
    out = []
    for line in text.split("\n"):
        heading = bool(_HEAD.match(line))
        if "<" in line:
            line = _TAGS.sub(" ", line)
        if "&" in line:
            line = unescape(line)
        line = _TAIL.sub("", _LEAD.sub("", line)) if heading else _LEAD.sub("", line)
        line = " ".join(line.split())
        if line:
            out.append((line, heading))
    return out


def has_field(texts: list[str]) -> str | None:
    """The first unfilled field of a record's texts, from which code is taken out, if the record is a case."""
    bare: list[str] = []
    found = explained = 0
    for text in texts:
        end = 0
        for start in _OPENER.finditer(text):
            if start.start() < end:
                continue
            m = FIELDS.match(text, start.start())
            if not m:
                continue
            end = m.end()
            if text[max(0, m.start() - 1) : m.start()] + text[end : end + 1] in _QUOTED:
                continue
            found += 1
            low = max(text.rfind(c, 0, m.start()) for c in ".!?。！？")
            high = min((k for k in (text.find(c, end) for c in ".!?。！？") if k >= 0), default=len(text))
            if _EXPLAINS.search(text, max(low + 1, m.start() - NEARBY), m.start()) or _EXPLAINS.search(text, end, min(high, end + NEARBY)):
                explained += 1
            else:
                bare.append(m[0])
    if bare and (len(bare) >= explained or sum(map(len, texts)) <= DENSE * found):
        return bare[0]
    return None


def _speaks_of_text_to_come(sentence: str) -> bool:
    """Whether a sentence says little but that text is to come or fills space."""
    han = len(HAN.findall(sentence))
    if 2 * han > len(sentence.strip(" .。!！…")):
        if not (_HAN_HOLDER.search(sentence) or _HAN_TO_COME.search(sentence)):
            return False
        return len(HAN.findall(_HAN_LEXICON.sub("", sentence))) <= 0.25 * han
    words = [w.lower() for w in _PLAIN_WORD.findall(sentence)]
    holds, text, come = (sum(w in x for w in words) for x in (_HOLDERS, _ABOUT_TEXT, _TO_COME))
    if not words or not (holds and (text or come or len(words) <= 3) or text and come):
        return False
    return sum(w not in _HOLDERS and w not in _ABOUT_TEXT and w not in _TO_COME and w not in _FUNCTION_WORDS for w in words) <= 0.2 * len(words)


def is_filler(paragraph: str) -> bool:
    """Whether most of a paragraph only fills space."""
    tokens = paragraph.split()
    low = paragraph.lower().split()
    plainly = len(low) >= 5 and sum([t in _FUNCTION_WORDS for t in low]) >= 0.15 * len(low)  # running text of a language
    if not plainly and _only_fills(paragraph, tokens):
        return True
    if not _FILLING.isdisjoint(low) or not _FILLING.isdisjoint([t.strip(".,;:!?()") for t in low]) or not paragraph.isascii() and (_HAN_HOLDER.search(paragraph) or _HAN_TO_COME.search(paragraph)):
        whole = filled = 0
        for s in _SENTENCE.findall(paragraph):
            s = s.strip()
            if s:
                whole += len(s)
                if _speaks_of_text_to_come(s):
                    filled += len(s)
        return filled > 0.6 * whole
    return False


def _only_fills(paragraph: str, tokens: list[str]) -> bool:
    """One word or letter over and over, or running text without function words."""
    names = [t for t in (t.strip(".,;:!?。").lower() for t in tokens) if t and not t.isdigit()]
    if len(names) < 2 or len(tokens) > 3 * len(names):
        return False
    kinds = set(names)
    if len(kinds) == 1 and (len(names) >= 3 or names[0] in ("undefined", "null", "nan", "none", "todo", "tbd")) and names[0].isalnum():
        return True
    if all(map(_ONE_LETTER.match, kinds)):
        return True
    if len(names) < 5:
        return False
    low = [t for t in names if t.isascii() and t.isalpha()]
    plain = sum(t.strip(".,;:!?").islower() for t in tokens[1:] if t.isascii())
    # names begin with capitals; what is left of running text needs function words
    if plain < 4 or len(low) < 0.8 * len(names) or plain < 0.7 * len(low) or 3 * paragraph.count(",") >= len(names):
        return False
    share = sum(t in _FUNCTION_WORDS for t in low) / len(low)
    return share < 0.15 and len(names) >= 16 or share == 0 and (len(names) >= 6 and paragraph.rstrip()[-1] in ".!?…" or len(kinds) <= 0.75 * len(names) or len(names) >= 12)


def _says(sentence: str) -> bool:
    """Whether a sentence is a message by its status code or its words."""
    if _STATUS.match(sentence):
        return True
    lean = leaning(sentence, weights("message"))
    return lean > MESSAGE and lean > leaning(sentence, weights("site"))


def is_message(text: str) -> bool:
    """Whether a paragraph is for the most part an error message or a demand, not a quotation of one."""
    if _QUOTE_PAIR.search(text):
        return False
    sentences = [s for s in (s.strip(" *_'\"") for s in _SENTENCE.findall(text)) if s]
    if len(sentences) > 1 and _says(text) and len(text) < PARAGRAPH:
        return True
    return 2 * sum(len(s) for s in sentences if _says(s)) >= sum(map(len, sentences)) > 0


def article_weight(text: str) -> int:
    """The weight of a line as an article paragraph, 0 if it is none."""
    weight = len(text) if text.isascii() else len(text) + 2 * len(HAN.findall(text))
    if weight < 45 or weight < PARAGRAPH and (len(_STOPS.findall(text)) < 2 or leaning(text, weights("site")) > 0.3):
        return 0
    return weight


def is_plain(text: str) -> bool:
    """Whether a text reads like a sentence of an article."""
    return len(text) >= 20 and leaning(text, weights("site")) < -0.2 and leaning(text, weights("message")) < -0.2


def is_error(texts: list[tuple[str, bool]]) -> bool:
    """Whether texts (text, heading?) are a message without an article."""
    whole = 0
    for text, heading in texts:
        if heading or text.startswith("|"):
            continue
        w = article_weight(text)
        if w and not is_message(text):
            whole += w
            if whole >= ARTICLE:
                return False
    # a heading alone speaks for a message only where nothing but site lines stands below it
    return any(is_message(text) for text, heading in texts if not text.startswith("|") and (not heading or not whole))


def findings(texts: list[tuple[str, bool]]) -> list[str]:
    kinds = []
    if has_field([t for t, _ in texts]):
        kinds.append("field")
    if any(is_filler(t) for t, heading in texts if not heading and t[0] != "|"):
        kinds.append("filler")
    if is_error(texts):
        kinds.append("error")
    return kinds


def of_content(content: str | None) -> list[str]:
    """The findings of a converted text."""
    if not content or content.isspace():
        return []
    return findings(lines_of(content))


def of_html(html: str | None, model: tuple, fragment: bool) -> list[str]:
    """The findings of a page, or of a fragment that is all article."""
    if not html:
        return []
    cut = _CODE_HTML.sub(" ", html) if "<code" in html or "<pre" in html or "math" in html else html
    nodes, blocks = read(cut, notices=True)
    asked = any(b.kind == "notice" and is_message(b.text) for b in blocks)
    cells = [b.text for b in blocks if b.kind == "cell"]
    shown = [b for b in blocks if b.kind != "notice"]
    taken = [b for b in (shown if fragment else article_of(nodes, shown, model)) if b.kind not in ("cell", "control")]
    texts = [(b.text, b.kind == "heading") for b in taken]
    if not fragment and taken:
        # what only fills space looks little like an article, so it counts wherever it stands beside one
        homes = {b.node for b in taken} | {nodes[b.node].parent for b in taken if nodes[b.node].parent > 0}
        kept = set(map(id, taken))
        texts += [(b.text, False) for b in shown if b.kind == "p" and not b.linked and id(b) not in kept and (b.node in homes or nodes[b.node].parent in homes) and is_filler(b.text)]
    if not fragment and not any(b.kind in ("p", "quote", "pre") for b in taken):
        # no text was taken for the article: what stands in its place is what speaks, unlinked and without buttons, and isn't
        # the site's; sentences of an article before it show that the article was only missed
        for b in shown:
            if b.kind in ("p", "quote") and not nodes[b.node].controls:
                if not b.linked and is_filler(b.text):
                    texts.append((b.text, False))
                elif 3 * b.linked < len(b.text) and len(_STOPS.findall(b.text)) > 1 and is_plain(b.text):
                    asked = False
                    break
                elif not b.linked and leaning(b.text, weights("site")) <= max(0.0, leaning(b.text, weights("message"))):
                    texts.append((b.text, False))
    found = findings(texts + [("|" + t, False) for t in cells])
    # a heading of the article counts as one where any paragraph of the page could stand below it
    if asked and "error" not in found and not cells and not any(article_weight(t) or is_plain(t) for t, heading in texts if not heading):
        prose = any(article_weight(b.text) for b in blocks if b.kind in ("p", "li", "quote", "pre"))
        if not (prose and any(heading for _, heading in texts)):
            found.append("error")
    return found


def residues(df: DataFrame, record_id: str, text: str, html: bool = False, fragment: str | None = None) -> DataFrame:
    """(rec_id, finding) of each record with a finding. ``fragment`` names a boolean column that
    tells which pages are body fragments without site furniture."""
    shared = df.sparkSession.sparkContext.broadcast(tree() if html else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows, kinds = [], []
            for k, (value, part) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                found = of_html(value.as_py(), model, bool(part)) if html else of_content(value.as_py())
                rows += [k] * len(found)
                kinds += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(kinds, pa.string())], ["rec_id", "finding"])

    part = F.lit(False) if fragment is None else F.coalesce(F.col(fragment), F.lit(False))
    return spread(df.where(F.col(text).isNotNull()).select(F.col(record_id).cast("long"), text, part)).mapInArrow(run, "rec_id long, finding string")
