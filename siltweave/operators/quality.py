"""Conversion-quality checks S1 to S12 as columns over Markdown and the HTML it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that menus are made of (fixed values).
NAVIGATION = ("home", "contents", "navigation", "menu", "search", "main page", "random page", "recent changes", "log in", "sign in", "register", "community", "help")


def count(text, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def checks(df: DataFrame, doc: str, md: str, html: str) -> DataFrame:
    """(doc, check, failed): one row a document and check; null Markdown counts as empty.

    All checks are expressions over one row, so the scan is read once and nothing is shuffled.
    """
    m, h = F.coalesce(F.col(md), F.lit("")), F.coalesce(F.col(html), F.lit(""))
    body = F.regexp_replace(m, r"(?s)\A---\n.*?\n---\n", "")
    sections = F.transform(F.regexp_extract_all(h, F.lit(r'class="mw-headline"[^>]*>([^<]+)<'), F.lit(1)), lambda x: F.trim(x))
    rows_html, rows_md = count(h, "(?i)<tr[ >]"), count(m, r"(?m)^\|.*\|$") - count(m, r"(?m)^\|[ :|-]+\|$")
    found = {
        "S1": (count(h, "(?i)<img[ >]") != count(m, r"!\[")) | m.contains("](/images/"),
        "S2": m.contains("](/wiki/"),
        "S3": F.when(h.rlike('class="[^"]*infobox'), count(F.regexp_extract(m, r"(?s)## Infobox\n(.*?)(?:\n## |\z)", 1), r"(?m)^(?:\||- )") < 3).otherwise(False),
        "S4": F.length(F.trim(body)) == 0,
        "S5": m.rlike(r"data:[a-z]+/[a-z]+;base64|</(?:div|span|td|p)>|&(?:nbsp|amp|lt|gt|quot);"),
        "S6": (rows_html > 0) & (F.abs(rows_html - rows_md) > 0.1 * rows_html),
        "S7": count(m, r"\[!\[[^\]]*\]\([^)]*\)\]\(") > 0,
        "S8": F.exists(sections, lambda s: ~F.contains(m, s)),
        "S10": count(m, r"\[(?:Video|YouTube video|Watch)\]\(") > 0,
        "S11": m.rlike(r"\]\(/(?:wiki|images)/"),
        "S12": m.rlike(r"(?m)^\| ?(?:Name|ID) ?\| ?[^|]*(?:[a-z][A-Z][a-z]+[A-Z]|\.(?:png|jpg)|menu)"),
    }
    return df.select(F.col(doc).alias("doc"), F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("failed")) for k, v in found.items()))).alias("c")).select("doc", "c.check", "c.failed")


def page_checks(conv: DataFrame) -> DataFrame:
    """(result_id, domain, check_id, status): pass, fail or skip of each text (md) against its page (html, wiki) and the
    known pages it should link to (unlinked). All checks are expressions over one row.

    Fixed values: what each check looks for (its marks of markup, residue and furniture) and the tolerance of a tenth of the rows.
    """
    m, h = F.col("md"), F.col("html")
    images = count(h, "(?i)<img[ >]") - count(h, '(?i)<img[^>]*src="data:image/gif;base64[^>]*>')
    sections = F.filter(F.transform(F.regexp_extract_all(h, F.lit(r'(?is)class="mw-headline"[^>]*>(.*?)</span>'), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: ~x.isin("", "Contents"))
    lines = F.split(m, "\n")
    heads = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.rlike(r"^#{1,6}\s+.+$"))
    tables = F.filter(F.regexp_extract_all(h, F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0)), lambda t: (count(t, "(?i)<tr[ >]") > 2) & ~t.rlike('(?i)^<table[^>]*class="[^"]*(?:navbox|nav-box|mw-collapsible|nav-main|nav-header|nav-footer)'))
    data_rows = lambda t: F.size(F.filter(F.slice(F.split(t, "(?i)<tr[ >]"), 2, 1 << 30), lambda x: ~(F.contains(x, F.lit("<th")) & ~F.contains(x, F.lit("<td")))))
    rows_html = F.aggregate(tables, F.lit(0), lambda n, t: n + data_rows(t))
    rows_md = F.size(F.filter(lines, lambda x: F.trim(x).startswith("|") & ~F.contains(x, F.lit("---")) & ~F.trim(x).rlike(r"^\|[\s\-:|]+\|$")))
    infobox = F.regexp_extract(m, r"(?s)## Infobox\n(.*?)(?:\n## |\z)", 1)
    fields = F.size(F.filter(F.split(infobox, "\n"), lambda x: x.rlike(r"^(?:\||- )")))
    unlinked = F.exists(F.coalesce("unlinked", F.array().cast("array<string>")), lambda n: ~F.contains(m, F.concat(F.lit("["), n, F.lit("]("), F.translate(n, " ", "_"), F.lit(".md)"))))
    failed = lambda c: F.when(c, "fail").otherwise("pass")
    found = {
        "S1": F.when(h == "", "skip").otherwise(failed(m.rlike(r"!\[[^\]]*\]\(/images/") | (images != count(m, r"!\[[^\]]*\]\([^)]*\)")))),
        "S2": F.when(h == "", "skip").when(m.rlike(r"\[[^\]]*\]\(/wiki/"), "fail").when(m.rlike(r"\[[^\]]+\]\(https?://[^/]+/wiki/"), "pass").otherwise(failed(unlinked)),
        "S3": F.when(~F.col("wiki").rlike(r"(?i)\{\{Infobox"), "skip").otherwise(failed((fields < 3) | infobox.rlike("<[a-z/]"))),
        "S4": failed(F.btrim(F.regexp_replace(m, r"(?s)\A---.*?---", ""), F.lit("\n\t\r ")) == ""),
        "S5": failed(F.regexp_replace(m, r"!\[.*?\]\([^)]+?\)", "").rlike(r"(?:^|[^`])[a-z]\d+(?:\.\d+)?[a-z](?:[^`]|$)") | m.contains("data:image/gif;base64") | m.rlike(r"\\\*") | m.rlike("</a>|</span>|</div>") | m.rlike("&amp;|&lt;|&gt;")),
        "S6": F.when(rows_html == 0, "skip").otherwise(failed(F.abs(rows_md - rows_html) > 0.1 * rows_html)),
        "S7": failed(m.rlike(r"\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)")),
        "S8": F.when(F.size(sections) == 0, "skip").otherwise(failed(F.exists(sections, lambda s: ~F.exists(heads, lambda x: F.contains(x, s))))),
        "S10": failed(m.rlike(r"\[(?:Video|YouTube video|Watch)\]\(")),
        "S11": failed(m.rlike(r"\]\(/(?:wiki|images)/")),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("check_id"), v.alias("status")) for k, v in found.items()))
    return conv.select("result_id", "domain", F.explode(rows).alias("c")).select("result_id", "domain", "c.check_id", "c.status")


def navigation_runs(df: DataFrame, doc: str, md: str) -> DataFrame:
    """S9, AGG17: the longest run of consecutive menu lines of each document.

    A fold over the document's own lines; no shuffle and no window.
    """
    nav = F.transform(F.split(md, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^[-*+#>\s]+|[\[\]]|\([^)]*\)", ""))).isin(*NAVIGATION))
    longest = F.aggregate(
        nav,
        F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, x: F.struct(F.when(x, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["most"], F.when(x, a["run"] + 1).otherwise(0)).alias("most")),
    )["most"]
    return df.where(F.col(md).isNotNull()).select(F.col(doc).alias("doc"), longest.alias("longest"))
