"""Queries that run the document kernels, and their inline fixtures."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import text
from siltweave.io import table
from siltweave.operators import markdown, media, wikitext
from siltweave.operators.ranks import numbered
from siltweave.plans.registry import query
from siltweave.sources import readers

_RULES = markdown.Rules(drop=(".mw-editsection", "nav", "header", "footer", "aside", "[role=navigation]", ".breadcrumbs", ".share", ".newsletter"), skip_images=(r"/icons?/",))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every stored page as Markdown."""
    return markdown.to_markdown(table(spark, d, "raw_pages"), "cache_id", "html", _RULES).select("id", "markdown", "n_tables", F.size("links").alias("n_links"), F.size("images").alias("n_images"), F.array_join("warnings", ",").alias("warnings"))


@query()
def wikitext_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    """WT1 to WT7: every page with wikitext as Markdown with its front matter fields."""
    out = wikitext.to_markdown(table(spark, d, "raw_pages"), "cache_id", "wikitext", "title", fields=("name", "hp", "image"), forms={"Icon": "(%s)", "cite": "%s"})
    return out.select("id", "markdown", F.col("frontmatter")["hp"].alias("hp"), F.array_join("warnings", "; ").alias("warnings"))


#: The rewrites of the fallback converter in order; \1 is what the pattern holds.
_REWRITES = (
    *((rf"(?is)<{t}[ >].*?</{t}>", "") for t in ("script", "style", "nav", "header", "footer")),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<pre[^>]*>(.*?)</pre>", "\n```\n\\1\n```\n\n"),
    *((rf"(?is)<{t}(?: [^>]*)?>(.*?)</{t}>", r"**\1**") for t in ("strong", "b")),
    *((rf"(?is)<{t}(?: [^>]*)?>(.*?)</{t}>", r"*\1*") for t in ("em", "i")),
    (r"(?is)<code[^>]*>(.*?)</code>", r"`\1`"),
    (r'(?is)<a [^>]*href="([^"]*)"[^>]*>\s*</a>', ""),
    (r'(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"),
    (r'(?is)<img [^>]*src="([^"]*)"[^>]*alt="([^"]*)"[^>]*>', r"![\2](\1)"),
    (r'(?is)<img [^>]*src="([^"]*)"[^>]*>', r"![image](\1)"),
    *((rf"(?is)<h{k}[^>]*>(.*?)</h{k}>", "\n" + "#" * k + " \\1\n\n") for k in range(1, 7)),
    (r"(?is)<blockquote[^>]*>\s*(.*?)\s*</blockquote>", "\n> \\1\n\n"),
    (r"(?i)<li[^>]*>\s*", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<hr\s*/?>", "\n---\n\n"),
    (r"(?i)</t[hd]>\s*<t[hd][^>]*>", " | "),
    (r"(?i)<tr[^>]*>\s*<t[hd][^>]*>", "\n| "),
    (r"(?i)</t[hd]>\s*</tr>", " |"),
    (r"(?i)</(?:p|div|article|section|ul|ol|table)>", "\n\n"),
    (r"<[^>]+>", ""),
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)


def _rewritten_sql(column: str) -> str:
    for pattern, to in _REWRITES:
        column = "regexp_replace({}, '{}', '{}', 'g')".format(column, pattern.replace("'", "''"), to.replace("'", "''"))
    return f"trim({column}, chr(10) || chr(9) || chr(13) || ' ')"


@query(f"select cache_id, {_rewritten_sql('html')} as body from raw_pages where html is not null")
def regex_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The fallback converter, an ordered chain of rewrites inside the JVM: hidden parts, blocks, inline marks, lists, tables, tags, entities, blanks."""
    h = F.col("html")
    for pattern, to in _REWRITES:
        h = F.regexp_replace(h, pattern, re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$")))
    return table(spark, d, "raw_pages").where("html is not null").select("cache_id", F.btrim(h, F.lit("\n\t\r ")).alias("body"))


def _mapped(convert, kind):
    """A function of one text as a function of a column, batch by batch."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(convert)

    return run


@query("""
with k as (select n_regionkey as region, n_nationkey as n, n_name, row_number() over (partition by n_regionkey order by n_nationkey) as rn from nation)
select r_regionkey as region, '| ' || r_name || ' | ' || r_name || ' |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| all | ' || n_name || '\\|' || n || ' |', chr(10) order by n) as md from region join k on k.region = r_regionkey group by r_regionkey, r_name""")
def table_grids(spark: SparkSession, d: str) -> DataFrame:
    """Tables with spans over columns and rows and pipes in cells, one a region, as pipe tables."""
    n = table(spark, d, "nation").withColumn("cell", F.concat("n_name", F.lit("|"), F.col("n_nationkey").cast("string")))
    rows = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "cell"))).alias("rows"))  # a fixed table of 25 rows
    first = F.concat(F.lit("<tr><td rowspan="), F.size("rows").cast("string"), F.lit(">all</td><td>"), F.get("rows", F.lit(0))["cell"], F.lit("</td></tr>"))
    rest = F.array_join(F.transform(F.slice("rows", 2, 1000), lambda x: F.concat(F.lit("<tr><td>"), x["cell"], F.lit("</td></tr>"))), "")
    html = F.concat(F.lit("<table><tr><td>x</td></tr></table><table><tr><th colspan=2>"), "r_name", F.lit("</th></tr>"), first, rest, F.lit("</table>"))
    r = table(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_regionkey").alias("region"), _mapped(markdown.largest_table, "string")(html).alias("md"))


@query("""
with k as (select n_regionkey as region, n_nationkey as n, n_name from nation)
select r_regionkey as region, string_agg('| ' || r_name || ' → ' || n_name || ' | ' || n || ' |', chr(10) order by n) as body from region join k on k.region = r_regionkey group by r_regionkey""")
def turned_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables wider than the rules allow are turned, their header rows merged into one label a line."""
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))  # a fixed table of 25 rows
    cells = lambda c, tag: F.array_join(F.transform("rows", lambda x: F.concat(F.lit(f"<{tag}>"), x[c].cast("string"), F.lit(f"</{tag}>"))), "")
    html = F.concat(F.lit("<table><tr><th colspan="), F.size("rows").cast("string"), F.lit(">"), "r_name", F.lit("</th></tr><tr>"), cells("n_name", "th"), F.lit("</tr><tr>"), cells("n_nationkey", "td"), F.lit("</tr></table>"))
    r = table(spark, d, "region").join(rows, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").cast("long").alias("id"), html.alias("html"))
    md = markdown.to_markdown(r, "id", "html", markdown.Rules(transpose_over=3))
    lines = F.filter(F.split("markdown", "\n"), lambda x: x.startswith("|") & F.contains(x, F.lit("→")))
    return md.select(F.col("id").cast("int").alias("region"), F.array_join(lines, "\n").alias("body"))


_BOX = markdown.Rules(infobox=".portable-infobox", domain="w.example", handlers={"Icons": "count_images", "Picture": "image", "No": "extract_cur_id", "Pools": "dedup_pools", "Set": "simplify_collection", "Tags": "extract_tags", "Kind": "text"})


@query("""
select cast(p_partkey as bigint) as part, concat_ws(chr(10), '| **Name** | ' || p_name || ' |', '| **Kind** | ' || p_type || ' |', '| **Icons** | ' || '2× ' || p_brand || ', 1× x' || ' |', '| **Picture** | ![' || p_brand || '](https://w.example/i/' || p_partkey || '.png) |', '| **No** | ' || p_partkey || ' |',
 '| **Pools** | [' || p_type || '](https://w.example/p/1), [b](https://w.example/p/2) |', '| **Set** | See [' || p_type || '](https://w.example/s) |', '| **Tags** | [' || p_brand || '](https://w.example/t) |') as box,
 concat_ws(chr(10), '- **Name**: ' || p_name, '- **Kind**: ' || p_type) as listed from part""")
def infobox_fields(spark: SparkSession, d: str) -> DataFrame:
    """An infobox a part, in both styles (table and list), each field by its configured handler."""
    field = lambda label, value: F.concat(F.lit(f'<div class="pi-data"><h3 class="pi-data-label">{label}</h3><div class="pi-data-value">'), value, F.lit("</div></div>"))
    text_ = lambda c: F.col(c).cast("string")
    img = F.concat(F.lit('<img alt="'), "p_brand", F.lit('" src="a.png">'))
    html = F.concat(
        F.lit('<aside class="portable-infobox">'), field("Name", text_("p_name")), field("Kind", F.concat(F.lit("<i>"), "p_type", F.lit("</i>"))), field("Icons", F.concat(img, F.lit('<img alt="x">'), img)),
        field("Picture", F.concat(F.lit('<img alt="'), "p_brand", F.lit('" src="/i/'), text_("p_partkey"), F.lit('.png">'))), field("No", F.concat(F.lit('<a>1</a><b class="infobox-nav-cur">'), text_("p_partkey"), F.lit("</b><a>3</a>"))),
        field("Pools", F.concat(F.lit('<a href="/p/1">'), "p_type", F.lit('</a><a href="/p/2">b</a><a href="/p/1">again</a>'))), field("Set", F.concat(F.lit('<a href="/s">'), "p_type", F.lit('</a><a href="/z">z</a>'))),
        field("Tags", F.concat(F.lit('<a href="/t" title="'), "p_brand", F.lit('">?</a>'))), F.lit("</aside><p>x</p>"),
    )
    md = markdown.to_markdown(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), html.alias("html")), "id", "html", _BOX)
    rows = F.filter(F.split("markdown", "\n"), lambda x: x.startswith("| **"))
    listed = F.transform(F.filter("infobox", lambda x: x["label"].isin("Name", "Kind")), lambda x: F.concat(F.lit("- **"), x["label"], F.lit("**: "), x["value"]))
    return md.select(F.col("id").alias("part"), F.array_join(rows, "\n").alias("box"), F.array_join(listed, "\n").alias("listed"))


@query("""
select cast(p_partkey as bigint) as part, p_name as name, p_type as color, p_brand as rarity, '/wiki/' || replace(p_name, ' ', '_') as href, p_type as description,
 concat_ws(chr(10), '| | Base | Upgraded |', '| --- | --- | --- |', '| **Name** | ' || p_name || ' | ' || p_name || '+ |', '| **Cost** | ' || p_size || ' | ' || (p_size + 1) || ' |', '| **Type** | ' || p_type || ' | ' || p_type || ' |', '| **Rarity** | ' || p_brand || ' | ' || p_brand || ' |') as stats from part""")
def card_boxes(spark: SparkSession, d: str) -> DataFrame:
    """K13, K14, ASM4: cards of a list page, and the base and upgraded values of each card's own page, one a part."""
    t = lambda c: F.col(c).cast("string")
    box = F.concat(F.lit('<div class="card-box" data-color="'), "p_type", F.lit('" data-rarity="'), "p_brand", F.lit('"><a href="/wiki/'), F.translate("p_name", " ", "_"), F.lit('">'), "p_name", F.lit('</a><div class="desc">'), "p_type", F.lit("</div></div>"))
    tab = lambda key, v: F.concat(F.lit(f'<div class="druid-toggleable-data" data-druid-tab-key="{key}">'), v, F.lit("</div>"))
    row = lambda name, *v: F.concat(F.lit(f'<div class="druid-row-{name}">'), *v, F.lit("</div>"))
    page = F.concat(
        F.lit('<div class="druid-infobox">'), row("Name", tab("Base", t("p_name")), tab("Upgraded", F.concat("p_name", F.lit("+")))), row("EnergyCost", tab("Base", t("p_size")), tab("Upgraded", (F.col("p_size") + 1).cast("string"))),
        row("Type", t("p_type")), row("RarityClass", t("p_brand"), F.lit(" Card")), F.lit("</div>"),
    )

    @F.pandas_udf("struct<name:string,color:string,rarity:string,href:string,description:string>")
    def first_card(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{k: c[k] for k in ("name", "color", "rarity", "href", "description")} for c in (markdown.cards(h)[0] for h in html)])

    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("part"), first_card(box).alias("c"), _mapped(markdown.card_stats, "string")(page).alias("stats")).select("part", "c.*", "stats")


@query(r"""
with h as (select cache_id, regexp_replace(html, '(?is)<pre.*?</pre>|<table.*?</table>|<blockquote.*?</blockquote>', '', 'g') as bare, html from raw_pages where platform = 'mediawiki' and html is not null)
select cache_id as id, cast(len(regexp_extract_all(bare, '(?i)<h[1-6][ >]')) as bigint) as n_headings, cast(len(regexp_extract_all(bare, '(?i)<li[ >]')) as bigint) as n_items, cast(len(regexp_extract_all(html, '(?i)<pre[ >]')) as bigint) as n_code, cast(len(regexp_extract_all(html, '(?i)<table[ >]')) as bigint) as n_tables from h""")
def markdown_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the converter made of each stored fragment: headings, list items, code blocks and tables, none lost and none added."""
    pages = table(spark, d, "raw_pages").where("platform = 'mediawiki' and html is not null")
    md = markdown.to_markdown(pages, "cache_id", "html", _RULES)
    bare = F.regexp_replace(F.regexp_replace("markdown", r"(?s)```.*?```", ""), r"(?m)^>.*$", "")
    n = lambda t, p: F.regexp_count(t, F.lit(p)).cast("bigint")
    return md.select("id", n(bare, r"(?m)^#{1,6} ").alias("n_headings"), n(bare, r"(?m)^ *(?:-|\d+\.) ").alias("n_items"), (n("markdown", "(?m)^```") / 2).cast("bigint").alias("n_code"), F.col("n_tables").cast("bigint").alias("n_tables"))


@query(r"""
with w as (select cache_id, regexp_replace(regexp_replace(wikitext, '(?s)<!--.*?-->', '', 'g'), '(?s)<(syntaxhighlight|pre|source)[^>]*>.*?</(syntaxhighlight|pre|source)>', '', 'g') as t, regexp_extract(wikitext, '(?s)\{\{Infobox[^\n]*\n(.*?)\n\}\}', 1) as box from raw_pages where wikitext is not null)
select cache_id as id, cast(len(regexp_extract_all(t, '(?m)^={2,6}[^=].*=\s*$')) as bigint) as n_headings, cast(len(regexp_extract_all(t, '(?m)^\{\|')) as bigint) as n_tables, trim(regexp_extract(box, '(?m)^\|\s*name\s*=\s*(.*)$', 1)) as name, trim(regexp_extract(box, '(?m)^\|\s*hp\s*=\s*(.*)$', 1)) as hp, trim(regexp_extract(box, '(?m)^\|\s*image\s*=\s*(.*)$', 1)) as image from w""")
def wikitext_counts(spark: SparkSession, d: str) -> DataFrame:
    """WT1 to WT5: headings, tables and infobox fields of each page's wikitext as the converter has them."""
    pages = table(spark, d, "raw_pages").where("wikitext is not null")
    md = wikitext.to_markdown(pages, "cache_id", "wikitext", "title", fields=("name", "hp", "image"), forms={"Icon": "(%s)", "cite": "%s"})
    bare = F.regexp_replace("markdown", r"(?s)<(syntaxhighlight|pre|source)[^>]*>.*?</(syntaxhighlight|pre|source)>", "")
    n = lambda p: F.regexp_count(bare, F.lit(p)).cast("bigint")
    field = lambda k: F.coalesce(F.col("frontmatter")[k], F.lit("")).alias(k)
    return md.select("id", n(r"(?m)^#{2,6} ").alias("n_headings"), n(r"(?m)^\|(?: ?-{3,} ?\|)+$").alias("n_tables"), field("name"), field("hp"), field("image"))


@query("""
select cast(p_partkey as bigint) as part, 'https://www.youtube.com/watch?v=v' || p_partkey || '|https://www.youtube.com/watch?v=w-' || p_size as urls,
 '[' || p_name || '](/wiki/' || p_partkey || ')' || chr(10) || chr(10) || '## Videos' || chr(10) || chr(10) || '- https://www.youtube.com/watch?v=v' || p_partkey || chr(10) || '- https://www.youtube.com/watch?v=w-' || p_size as body from part""")
def video_links(spark: SparkSession, d: str) -> DataFrame:
    """FN32, FN35, K4: pages made from parts, with players configured in attributes and a tooltip that repeats a link, as URLs and as Markdown."""
    t = lambda c: F.col(c).cast("string")
    link = F.concat(F.lit('<a href="/wiki/'), t("p_partkey"), F.lit('">'))
    tip = F.concat(F.lit('<p><span class="tooltip">'), link, F.lit("</a>"), link, "p_name", F.lit("</a></span></p>"))
    players = F.concat(F.lit('<div data-mw-iframeconfig="{&quot;src&quot;:&quot;https://www.youtube.com/embed/v'), t("p_partkey"), F.lit('?x=1&quot;}"></div><div data-mw-iframeconfig="{&quot;src&quot;:&quot;//y/embed/w-'), t("p_size"), F.lit('&quot;}"></div>'))
    pages = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat(tip, players).alias("html"))
    md = markdown.to_markdown(pages, "id", "html", _RULES).select("id", F.col("markdown").alias("body"))
    return pages.select("id", F.array_join(text.video_urls("html"), "|").alias("urls")).join(md, "id").select(F.col("id").alias("part"), "urls", "body")


@query("""
select domain, count(distinct url) as n_urls from manifest where url is not null group by domain""")
def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """SRC8, SRC9, SET1: sitemaps of all sites written from the manifest and read back, URLs once.

    Each sitemap holds at most 1,000 URLs, as real ones are split too.
    """
    m = table(spark, d, "manifest").where("url is not null").select("domain", "url", "page_seq")
    m = numbered(m, ["domain"], "page_seq", F.floor(F.col("page_seq") / 4096))
    xml = m.withColumn("chunk", F.floor((F.col("rn") - 1) / 1000)).groupBy("domain", "chunk").agg(F.concat(F.lit("<urlset >"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc><![CDATA["), "url", F.lit("]]></loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return xml.where(readers.sitemap_kind("xml") == "urlset").select("domain", F.explode(readers.sitemap_locations("xml")).alias("url")).groupBy("domain").agg(F.count_distinct("url").alias("n_urls"))


def _media(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    posts = table(spark, d, "raw_pages").where("title is not null and domain is not null").groupBy(F.col("domain").alias("collection"), "title").agg(F.min("cache_id").alias("post"))
    files = table(spark, d, "manifest").where("target_filename is not null and domain is not null").groupBy(F.col("domain").alias("collection"), F.col("target_filename").alias("name")).agg(F.concat(F.lit("/m/"), F.min("page_seq").cast("string")).alias("at"))
    return posts.select("collection", "post", "title"), files.select("collection", F.concat("at", F.lit("-"), "name").alias("path"), "name")


@query()
def media_matching(spark: SparkSession, d: str) -> DataFrame:
    """Titles of each site's stored pages matched to the file names of its manifest, each file at most once."""
    return media.matched(*_media(spark, d)).select("post", "path", "tier")


@query(r"""
with p as (select domain, min(cache_id) as post, regexp_replace(lower(title), '[^\p{L}\p{N}]', '', 'g') as f from raw_pages where title is not null and domain is not null group by domain, title),
m as (select domain, '/m/' || min(page_seq) || '-' || target_filename as path, regexp_replace(lower(regexp_replace(target_filename, '\.\w{2,4}$', '')), '[^\p{L}\p{N}]', '', 'g') as f from manifest where target_filename is not null and domain is not null group by domain, target_filename),
a as (select *, row_number() over (partition by domain, f order by post) as r from p where f <> ''), b as (select *, row_number() over (partition by domain, f order by path) as r from m)
select a.post, b.path from a join b on b.domain = a.domain and b.f = a.f and b.r = a.r""")
def equal_media_names(spark: SparkSession, d: str) -> DataFrame:
    """The first tier of :func:`media_matching`, equal folded names paired in order."""
    return media.matched(*_media(spark, d)).where("tier = 1").select("post", "path")
