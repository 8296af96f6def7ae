"""Text functions of the conversion steps as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(text) -> Column:
    """Runs of white space, no-break space included, to one blank; ends trimmed."""
    return F.trim(F.regexp_replace(_c(text), r"[\s\u00a0\u3000]+", " "))


def strip_tags(html) -> Column:
    """Tags dropped and the six usual entities decoded, the ampersand last."""
    s = F.regexp_replace(_c(html), "<[^>]+>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def first_heading(markdown) -> Column:
    """The first heading's text, else the first line that isn't blank, else ''."""
    lines = F.filter(F.transform(F.split(_c(markdown), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heads = F.filter(lines, lambda x: x.rlike("^#{1,6} "))
    return F.coalesce(F.regexp_replace(F.get(heads, F.lit(0)), "^#{1,6} +", ""), F.get(lines, F.lit(0)), F.lit(""))


def anchor(text) -> Column:
    """A heading's anchor: lower case, everything but latin letters, digits and Chinese to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9一-鿿]+", "-"), "^-|-$", "")


def frontmatter(fields, escape: bool = True) -> Column:
    """A map as a YAML block, keys in order; values are quoted where they must be, quotes in them escaped unless told not to."""
    quotes = (lambda v: F.replace(v, F.lit('"'), F.lit('\\"'))) if escape else (lambda v: v)
    entries = F.transform(
        F.array_sort(F.map_keys(_c(fields))),
        lambda k: F.concat(
            k,
            F.lit(": "),
            F.when(_c(fields)[k].rlike('[\n:"]'), F.concat(F.lit('"'), F.replace(quotes(_c(fields)[k]), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise(_c(fields)[k]),
        ),
    )
    return F.concat(F.lit("---\n"), F.array_join(entries, "\n"), F.lit("\n---\n"))


def strip_frontmatter(markdown) -> Column:
    return F.regexp_replace(_c(markdown), r"(?s)\A---\n.*?\n---\n", "")


def insert_after_heading(markdown, block) -> Column:
    """``block`` as a paragraph of its own after the first heading line, or at the start without one."""
    m, b = _c(markdown), _c(block)
    at = F.regexp_instr(m, F.lit(r"(?m)^#{1,6} [^\n]*$"))
    line_end = F.call_function("locate", F.lit("\n"), m, F.greatest(at, F.lit(1)))
    whole = F.when(line_end == 0, F.concat(m, F.lit("\n\n"), b)).otherwise(F.concat(F.substr(m, F.lit(1), line_end), F.lit("\n"), b, F.lit("\n"), F.substr(m, line_end + 1)))
    return F.when(b.isNull() | (b == ""), m).when(at == 0, F.concat(b, F.lit("\n\n"), m)).otherwise(whole)


def fix_spaces(text) -> Column:
    """No blank before punctuation, single blanks, at most one blank line."""
    s = F.regexp_replace(_c(text), " +([,.;:!?])", "$1")
    s = F.regexp_replace(s, "[ \t]{2,}", " ")
    return F.regexp_replace(s, "\n{3,}", "\n\n")


def deduplicate_words(text) -> Column:
    """Words that follow themselves, once."""
    return F.regexp_replace(_c(text), r"\b(\p{L}{2,})(?: \1\b)+", "$1")


def absolute_links(markdown, base) -> Column:
    """Relative wiki and image targets of Markdown links under ``base``."""
    return F.regexp_replace(_c(markdown), r"\]\((/(?:wiki|images)/[^)]*)\)", F.concat(F.lit("]("), _c(base), F.lit("$1)")))


def clean_escapes(text) -> Column:
    """Escape artefacts, empty parentheses and doubled separators removed."""
    s = F.regexp_replace(_c(text), r"\\([_*\[\]()#+.!-])", "$1")
    s = F.regexp_replace(s, r" ?\(\s*\)", "")
    return F.regexp_replace(s, r"(?:\s*[|•·]\s*){2,}", " | ")


def strip_video(markdown) -> Column:
    """Residue of embedded players removed."""
    return F.regexp_replace(_c(markdown), r"(?is)<iframe[^>]*(?:youtube|youtu\.be|vimeo)[^>]*>.*?</iframe>|\[?Play video\]?", "")


def chinese_paragraph(text, share: float = 0.3, least: int = 30) -> Column:
    """The first paragraph of ``least`` characters of which more than ``share`` are Chinese, else ''."""
    parts = F.transform(F.split(_c(text), "\n\n+"), lambda x: F.trim(x))
    good = F.filter(parts, lambda x: (F.char_length(x) >= least) & (F.regexp_count(x, F.lit("[一-鿿]")) > share * F.char_length(x)))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def keywords(text, names: list[str], default: str) -> Column:
    """The names that occur in a text, in their order; the default where none does."""
    hit = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.upper(_c(text)), F.upper(n)))
    return F.when(F.size(hit) > 0, F.array_join(hit, ", ")).otherwise(F.lit(default))


def xml_escape(text) -> Column:
    s = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def video_urls(html) -> Column:
    """Watch URLs of the players that a page's frame attributes configure as JSON."""
    configs = F.regexp_extract_all(_c(html), F.lit('data-mw-iframeconfig="([^"]*)"'), F.lit(1))
    sources = F.transform(configs, lambda x: F.get_json_object(F.replace(x, F.lit("&quot;"), F.lit('"')), "$.src"))
    ids = F.filter(F.transform(sources, lambda x: F.regexp_extract(F.coalesce(x, F.lit("")), r"embed/([\w-]+)", 1)), lambda x: x != "")
    return F.transform(F.array_distinct(ids), lambda x: F.concat(F.lit("https://www.youtube.com/watch?v="), x))


def merge_tooltips(html) -> Column:
    """Tooltip spans unwrapped and a link directly followed by the same link merged."""
    s = F.regexp_replace(_c(html), r'<span class="[^"]*tooltip[^"]*"[^>]*>|</span>', "")
    return F.regexp_replace(s, r'<a ([^>]*href="([^"]*)"[^>]*)>(\s*|<img[^>]*>)</a>\s*<a [^>]*href="\2"[^>]*>', "<a $1>$3")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form, lower case, separators to single blanks."""
    return text.map(lambda x: None if x is None else " ".join("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", x).lower()).split()))
