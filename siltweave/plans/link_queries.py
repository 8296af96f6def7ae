"""Links of an output tree: resolution by name, rewriting, broken targets, category indexes and bounded crawls.

The tree is made of the manifest pages that have a written result. Links meet pages by equality joins on what
they name. The page side has one row a key, so where one page is linked from everywhere AQE splits the link side of the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import urls
from siltweave.io import table
from siltweave.operators import crawl
from siltweave.operators.ranks import numbered
from siltweave.plans.registry import query

#: Namespaces whose links are no pages (fixed values).
SKIPPED = ("File", "Category", "Template", "Talk", "Special", "Help", "MediaWiki")
_SKIP = "^(?:" + "|".join(SKIPPED) + "):"

_TREE = """idx as (select domain, title, arg_min({'dir': coalesce(target_directory, ''), 'file': target_filename}, page_seq) as p from manifest where domain is not null and title is not null group by all),
written as (select distinct domain, title from results where status = 'ok' and length(content) > 0),
files as (select idx.domain, idx.title, idx.p.dir as dir, idx.p.file as file, case when idx.p.dir = '' then '' else idx.p.dir || '/' end || idx.p.file as path from idx join written using (domain, title))"""
_RELATIVE = "case when {t} = {s} then {f} else case when {s} = '' then '' else repeat('../', len(string_split({s}, '/'))) end || case when {t} = '' then '' else {t} || '/' end || {f} end"


def files(spark: SparkSession, d: str) -> DataFrame:
    """(domain, title, dir, file, path) of the pages that are written."""
    m = table(spark, d, "manifest").where("domain is not null and title is not null")
    idx = m.groupBy("domain", "title").agg(F.min_by(F.struct(F.coalesce("target_directory", F.lit("")).alias("dir"), F.col("target_filename").alias("file")), "page_seq").alias("p"))
    written = table(spark, d, "results").where("status = 'ok' and length(content) > 0").select("domain", "title").distinct()
    return idx.join(written, ["domain", "title"]).select("domain", "title", "p.dir", "p.file", urls.joined("p.dir", "p.file").alias("path"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """(result_id, domain, source_dir, content) of the written texts; a text without a manifest page lies at the top."""
    r = table(spark, d, "results").where("status = 'ok' and length(content) > 0").select("result_id", "domain", "title", "content")
    dirs = files(spark, d).select("domain", "title", F.col("dir").alias("source_dir"))
    return r.join(dirs, ["domain", "title"], "left").select("result_id", "domain", F.coalesce("source_dir", F.lit("")).alias("source_dir"), "content")


_LINK = r"(?:^|[^!])\[[^\[\]]+\]\(([^()\s]+(?:\([^()\s]*\)[^()\s]*)*)\)"
_SOURCES = """src as (select r.result_id, r.domain, coalesce(f.dir, '') as source_dir, r.content from results r left join files f on f.domain = r.domain and f.title = r.title where r.status = 'ok' and length(r.content) > 0)"""
_HREFS = """hrefs as (select result_id, domain, source_dir, unnest(list_distinct(regexp_extract_all(content, '(?:^|[^!])\\[[^\\[\\]]+\\]\\(([^()\\s]+(?:\\([^()\\s]*\\)[^()\\s]*)*)\\)', 1))) as href from src)"""


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(_LINK), F.lit(1)))
    return _sources(spark, d).select("result_id", "domain", "source_dir", F.explode(found).alias("href"))


def fixed(hrefs: DataFrame, tree: DataFrame) -> DataFrame:
    """``hrefs`` (domain, source_dir, href, ...) with ``fixed``, the link as the output tree needs it.

    In this order: a doubled suffix becomes one; parentheses of Markdown files are encoded; a wiki link
    (of the site or of its own host, query dropped, fragment kept) to a written page becomes relative;
    a relative Markdown link whose target isn't written goes to the page its file name stands for. Others stay.
    """
    h = F.regexp_replace("href", r"\.md\.md\b", ".md")
    h = F.when(h.rlike(r"\.md(?:#.*)?$") & ~F.contains(h, F.lit("%28")), urls.encode_parens(h)).otherwise(h)
    hrefs = hrefs.withColumn("h", h)
    wiki = F.regexp_extract(F.col("h"), r"^(?:https?://[^/]+)?/wiki/([^?#]+)", 1)
    own = F.col("h").startswith("/wiki/") | F.startswith(F.col("h"), F.concat(F.lit("https://"), "domain", F.lit("/wiki/")))
    name = F.when(own, F.translate(F.coalesce(urls.percent_decode(wiki), wiki), "_", " "))
    name = F.when(~name.rlike(_SKIP), name)
    relative = F.col("h").rlike(r"\.md$") & ~F.col("h").rlike("^(?:http|#|/)")
    at = urls.normalized(urls.joined("source_dir", F.coalesce(urls.percent_decode(F.col("h")), F.col("h"))))
    base = F.translate(F.coalesce(urls.percent_decode(F.regexp_extract("h", r"([^/]+)\.md$", 1)), F.lit("")), "_", " ")
    hrefs = hrefs.withColumn("wiki_name", name).withColumn("at", F.when(relative, at)).withColumn("base", F.when(relative, base)).withColumn("fragment", F.regexp_extract("h", r"(#.*)$", 1))
    there = tree.select("domain", F.col("path").alias("at"), F.lit(True).alias("there")).distinct()
    out = hrefs.join(there, ["domain", "at"], "left")
    out = out.withColumn("name", F.coalesce("wiki_name", F.when(F.col("there").isNull(), F.col("base"))))
    out = out.join(tree.select("domain", F.col("title").alias("name"), "dir", "file"), ["domain", "name"], "left")
    to = F.concat(urls.relative_path("source_dir", "dir", F.col("file")), F.when(F.col("wiki_name").isNotNull(), F.col("fragment")).otherwise(F.lit("")))
    return out.withColumn("fixed", F.when(F.col("file").isNotNull(), to).otherwise(F.col("h"))).drop("h", "wiki_name", "at", "base", "fragment", "there", "name", "dir", "file")


_FIXED = rf"""{_TREE}, {_SOURCES}, {_HREFS},
h1 as (select *, regexp_replace(href, '\.md\.md\b', '.md', 'g') as h0 from hrefs),
h2 as (select result_id, domain, source_dir, href, case when regexp_matches(h0, '\.md(?:#.*)?$') and not contains(h0, '%28') then replace(replace(h0, '(', '%28'), ')', '%29') else h0 end as h from h1),
h3 as (select *, case when (starts_with(h, '/wiki/') or starts_with(h, 'https://' || domain || '/wiki/')) then replace(url_decode(regexp_extract(h, '^(?:https?://[^/]+)?/wiki/([^?#]+)', 1)), '_', ' ') end as wn,
  regexp_matches(h, '\.md$') and not regexp_matches(h, '^(?:http|#|/)') as rel from h2),
h4 as (select *, case when not regexp_matches(wn, '{_SKIP}') then wn end as wiki_name, case when rel then regexp_replace(regexp_replace(case when source_dir = '' then '' else source_dir || '/' end || url_decode(h), '^[^/.]+/\.\./', ''), '^\./', '') end as at,
  case when rel then replace(url_decode(regexp_extract(h, '([^/]+)\.md$', 1)), '_', ' ') end as base from h3),
h5 as (select h4.*, coalesce(wiki_name, case when not exists (select 1 from files f where f.domain = h4.domain and f.path = h4.at) then base end) as name from h4),
fixed as (select h5.result_id, h5.domain, h5.source_dir, h5.href, case when f.file is not null then {_RELATIVE.format(s='h5.source_dir', t='f.dir', f='f.file')} || case when wiki_name is not null then regexp_extract(h, '(#.*)$', 1) else '' end else h end as fixed
  from h5 left join files f on f.domain = h5.domain and f.title = h5.name)"""


@query(f"with {_FIXED} select result_id, href, fixed from fixed")
def fixed_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link of the written texts as the output tree needs it."""
    return fixed(_hrefs(spark, d), files(spark, d)).select("result_id", "href", "fixed")


@query(f"""
with {_FIXED}, changes as (select result_id, list('](' || href || ')' || chr(1) || '](' || fixed || ')' order by href) as ch from fixed where href <> fixed group by result_id)
select src.result_id, case when ch is null then src.content else list_reduce(list_prepend(src.content, ch), lambda t, x: replace(t, split_part(x, chr(1), 1), split_part(x, chr(1), 2))) end as content from src left join changes using (result_id)""")
def rewritten_texts(spark: SparkSession, d: str) -> DataFrame:
    """The written texts with their links put right, whole; texts are joined with their few changed links once."""
    changed = fixed(_hrefs(spark, d), files(spark, d)).where("href <> fixed")
    changes = changed.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("href", "fixed"))).alias("ch"))
    put = F.aggregate("ch", F.col("content"), lambda t, x: F.replace(t, F.concat(F.lit("]("), x["href"], F.lit(")")), F.concat(F.lit("]("), x["fixed"], F.lit(")"))))
    return _sources(spark, d).join(changes, "result_id", "left").select("result_id", F.coalesce(put, "content").alias("content"))


def _missing(spark: SparkSession, d: str, href: str) -> DataFrame:
    h = fixed(_hrefs(spark, d), files(spark, d)).where(~F.col(href).rlike("^(?:http|#)"))
    at = urls.normalized(urls.joined("source_dir", F.regexp_replace(F.coalesce(urls.percent_decode(F.col(href)), F.col(href)), "#.*$", "")))
    raw = urls.normalized(urls.joined("source_dir", F.col(href)))
    there = files(spark, d).select("domain", "path").distinct()
    h = h.select("result_id", "domain", F.col(href).alias("target"), at.alias("resolved"), raw.alias("raw"))
    lost = h.join(there.withColumnRenamed("path", "resolved"), ["domain", "resolved"], "left_anti")
    return lost.join(there.withColumnRenamed("path", "raw"), ["domain", "raw"], "left_anti").select("result_id", "target", "resolved")


@query(rf"""
with {_FIXED}, r as (select *, regexp_replace(regexp_replace(case when source_dir = '' then '' else source_dir || '/' end || regexp_replace(url_decode(fixed), '#.*$', ''), '^[^/.]+/\.\./', ''), '^\./', '') as resolved,
  regexp_replace(regexp_replace(case when source_dir = '' then '' else source_dir || '/' end || fixed, '^[^/.]+/\.\./', ''), '^\./', '') as raw from fixed where not regexp_matches(fixed, '^(?:http|#)'))
select result_id, fixed as target, resolved from r where not exists (select 1 from files f where f.domain = r.domain and (f.path = r.resolved or f.path = r.raw))""")
def broken_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative links that are broken after the rewriting: neither the decoded nor the raw normalised target is written."""
    return _missing(spark, d, "fixed")


@query(f"""
with {_FIXED}, t as (select distinct fixed.domain, fixed.source_dir, f.dir as target_dir from fixed join files f on f.domain = fixed.domain and f.path = regexp_replace(regexp_replace(case when source_dir = '' then '' else source_dir || '/' end || url_decode(fixed.fixed), '^[^/.]+/\\.\\./', ''), '^\\./', ''))
select domain, source_dir, target_dir, {_RELATIVE.format(s='source_dir', t='target_dir', f="'x.md'")} as link from t""")
def relative_links(spark: SparkSession, d: str) -> DataFrame:
    """FN8: how pages of one directory link to those of another, for the pairs that links need."""
    h = fixed(_hrefs(spark, d), files(spark, d))
    at = urls.normalized(urls.joined("source_dir", F.coalesce(urls.percent_decode(F.col("fixed")), F.col("fixed"))))
    pairs = h.withColumn("path", at).join(files(spark, d).select("domain", "path", F.col("dir").alias("target_dir")), ["domain", "path"]).select("domain", "source_dir", "target_dir").distinct()
    return pairs.withColumn("link", urls.relative_path("source_dir", "target_dir", F.lit("x.md")))


_WIKI = """named as (select domain, title, any_value(dir) as dir from (select domain, title, coalesce(arg_min(target_directory, page_seq), '') as dir from manifest group by all) group by all),
targets as (select distinct r.domain, coalesce(n.dir, '') as source_dir, unnest(regexp_extract_all(r.wikitext, '\\[\\[([^\\[\\]|]+)', 1)) as target from raw_pages r left join named n on n.domain = r.domain and n.title = r.title where r.wikitext is not null)"""


@query(f"""
with {_WIKI}, red as (select domain, title, min(redirect_target) as to_ from results where status = 'redirect' and redirect_target is not null group by all),
t as (select targets.*, coalesce(red.to_, target) as final from targets left join red on red.domain = targets.domain and red.title = targets.target),
m as (select domain, title, coalesce(target_directory, '') as dir, target_filename as file, page_seq, split_part(title, ':', -1) as short from manifest where domain is not null),
e as (select domain, title, arg_min({{'dir': dir, 'file': file}}, page_seq) as p from m group by all),
s1 as (select domain, short, dir, arg_min({{'dir': dir, 'file': file}}, page_seq) as p from m group by all),
s2 as (select domain, short, arg_min({{'dir': dir, 'file': file}}, page_seq) as p from m group by all)
select t.domain, t.source_dir, t.target, case when regexp_matches(final, '{_SKIP}') then 0 when e.p is not null then 1 when s1.p is not null then 2 when s2.p is not null then 3 else 4 end as tier,
 case when starts_with(final, 'File:') then 'https://' || t.domain || '/Special:Redirect/file/' || replace(substr(final, 6), ' ', '%20') when regexp_matches(final, '{_SKIP}') then ''
  when coalesce(e.p, s1.p, s2.p) is not null then {_RELATIVE.format(s='t.source_dir', t='coalesce(e.p, s1.p, s2.p).dir', f='coalesce(e.p, s1.p, s2.p).file')}
  else 'https://' || t.domain || '/wiki/' || replace(final, ' ', '_') end as resolved
from t left join e on e.domain = t.domain and e.title = t.final left join s1 on s1.domain = t.domain and s1.short = split_part(t.final, ':', -1) and s1.dir = t.source_dir left join s2 on s2.domain = t.domain and s2.short = split_part(t.final, ':', -1)""")
def short_name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J3, J4, W3, FN19: wiki links by redirect, namespace, exact title, then by the name after the colon: pages of the
    linking page's directory first, else the first of the manifest; what is left goes to the site.

    A title that ends in a colon and the link is among those with the same short name, so a scan of suffixes adds nothing.
    """
    m = table(spark, d, "manifest").where("domain is not null").select("domain", "title", F.coalesce("target_directory", F.lit("")).alias("dir"), F.col("target_filename").alias("file"), "page_seq")
    place, short = F.struct("dir", "file"), lambda c: F.element_at(F.split(c, ":"), -1)
    dirs = table(spark, d, "manifest").groupBy("domain", "title").agg(F.coalesce(F.min_by("target_directory", F.when(F.col("target_directory").isNotNull(), F.col("page_seq"))), F.lit("")).alias("source_dir"))
    t = table(spark, d, "raw_pages").where("wikitext is not null").select("domain", "title", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[([^\[\]|]+)"), F.lit(1))).alias("target"))
    t = t.join(dirs, ["domain", "title"], "left").select("domain", F.coalesce("source_dir", F.lit("")).alias("source_dir"), "target").distinct()
    red = table(spark, d, "results").where("status = 'redirect' and redirect_target is not null").groupBy("domain", F.col("title").alias("target")).agg(F.min("redirect_target").alias("to"))
    t = t.join(red, ["domain", "target"], "left").withColumn("final", F.coalesce("to", "target")).withColumn("short", short(F.coalesce("to", "target")))
    exact = m.groupBy("domain", F.col("title").alias("final")).agg(F.min_by(place, "page_seq").alias("e"))
    near = m.groupBy("domain", short(F.col("title")).alias("short"), F.col("dir").alias("source_dir")).agg(F.min_by(place, "page_seq").alias("s1"))
    far = m.groupBy("domain", short(F.col("title")).alias("short")).agg(F.min_by(place, "page_seq").alias("s2"))
    t = t.join(exact, ["domain", "final"], "left").join(near, ["domain", "short", "source_dir"], "left").join(far, ["domain", "short"], "left")
    page, skipped = F.coalesce("e", "s1", "s2"), F.col("final").rlike(_SKIP)
    tier = F.when(skipped, 0).when(F.col("e").isNotNull(), 1).when(F.col("s1").isNotNull(), 2).when(F.col("s2").isNotNull(), 3).otherwise(4)
    site = F.concat(F.lit("https://"), "domain")
    resolved = (
        F.when(F.col("final").startswith("File:"), F.concat(site, F.lit("/Special:Redirect/file/"), F.replace(F.substr("final", F.lit(6)), F.lit(" "), F.lit("%20"))))
        .when(skipped, "").when(page.isNotNull(), urls.relative_path("source_dir", page["dir"], page["file"])).otherwise(F.concat(site, F.lit("/wiki/"), F.translate("final", " ", "_")))
    )
    return t.select("domain", "source_dir", "target", tier.alias("tier"), resolved.alias("resolved"))


@query(r"""
with h as (select distinct domain, href from (select domain, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as href from raw_pages where html is not null)),
m as (select domain, regexp_extract(url, '/([^/?#]+)$', 1) as base, min(target_filename) as file from manifest where url is not null group by all),
k as (select h.*, case when regexp_matches(href, '^(?:https?://|//|#|javascript:)') then 1 when regexp_matches(href, '^\.\./Pages/Page_\d+\.html') then 2 when href = '../title.html' then 3 when starts_with(href, '../') then 4 when regexp_matches(href, '^Pages/Page_\d+\.html') then 5 else 6 end as rule,
  regexp_extract(href, 'Pages/Page_\d+\.html', 0) as page, regexp_extract(regexp_replace(href, '/+$', ''), '([^/]*)$', 1) as base from h)
select k.domain, k.href, k.rule, case rule when 1 then k.href when 3 then 'https://' || k.domain || '/docs/contents/title.html' else coalesce(m.file, 'https://' || k.domain || '/docs/contents/' || case when rule in (2, 5) then k.page else regexp_replace(k.href, '^\.\./', '') end) end as resolved
from k left join m on m.domain = k.domain and m.base = k.base and k.rule not in (1, 3)""")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of stored pages by the six ordered rules of document sets: passed through, by page id, title page, by base name, else to the full URL."""
    h = table(spark, d, "raw_pages").where("html is not null").select("domain", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).distinct()
    pages = table(spark, d, "manifest").where("url is not null").groupBy("domain", F.regexp_extract("url", "/([^/?#]+)$", 1).alias("base")).agg(F.min("target_filename").alias("file"))
    return document_resolved(h, pages, F.concat(F.lit("https://"), "domain", F.lit("/docs/contents/"))).select("domain", "href", "rule", "resolved")


def document_resolved(hrefs: DataFrame, pages: DataFrame, root: Column) -> DataFrame:
    """``hrefs`` (domain, href) with ``rule`` and ``resolved``; ``pages``: (domain, base, file)."""
    h = F.col("href")
    rule = (
        F.when(h.rlike("^(?:https?://|//|#|javascript:)"), 1).when(h.rlike(r"^\.\./Pages/Page_\d+\.html"), 2).when(h == "../title.html", 3)
        .when(h.startswith("../"), 4).when(h.rlike(r"^Pages/Page_\d+\.html"), 5).otherwise(6)
    )
    k = hrefs.withColumn("rule", rule).withColumn("base", F.when(~rule.isin(1, 3), F.regexp_extract(F.regexp_replace(h, "/+$", ""), "([^/]*)$", 1))).join(pages, ["domain", "base"], "left")
    rest = F.when(F.col("rule").isin(2, 5), F.regexp_extract(h, r"(Pages/Page_\d+\.html)", 1)).otherwise(F.regexp_replace(h, r"^\.\./", ""))
    return k.withColumn("resolved", F.when(F.col("rule") == 1, h).when(F.col("rule") == 3, F.concat(root, F.lit("title.html"))).otherwise(F.coalesce("file", F.concat(root, rest))))


@query("""
with c as (select domain, unnest(regexp_extract_all(wikitext, '\\[\\[Category:([^\\[\\]|]+)', 1)) as category, title from raw_pages where wikitext is not null
  union select domain, unnest(categories), title from manifest),
f as (select domain, title, min(coalesce(nullif(target_directory, ''), 'misc') || '/' || target_filename) as path from manifest group by all),
l as (select c.domain, c.category, c.title, '- [' || c.title || '](' || coalesce('../' || replace(replace(f.path, '(', '%28'), ')', '%29'), 'https://' || c.domain || '/wiki/' || replace(c.title, ' ', '_')) || ')' as line from c left join f on f.domain = c.domain and f.title = c.title where c.title is not null)
select domain, category, cast(floor(rn / 200) as integer) as part, list_aggregate(list(line order by title), 'string_agg', chr(10)) as body from (select *, row_number() over (partition by domain, category order by title) - 1 as rn from l) group by all""")
def category_index(spark: SparkSession, d: str) -> DataFrame:
    """ASM2, J12, FN9, SRC2: index pages of the categories, 200 members a part, titles in code point order; members come from
    the manifest and from the pages' wikitext, and one that the manifest doesn't list links to the site."""
    m = table(spark, d, "manifest")
    said = table(spark, d, "raw_pages").where("wikitext is not null").select("domain", F.explode(F.regexp_extract_all("wikitext", F.lit(r"\[\[Category:([^\[\]|]+)"), F.lit(1))).alias("category"), "title")
    c = said.unionByName(m.select("domain", F.explode("categories").alias("category"), "title")).where("title is not null").distinct()
    f = m.groupBy("domain", "title").agg(F.min(F.concat(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc")), F.lit("/"), F.col("target_filename"))).alias("path"))
    to = F.coalesce(F.concat(F.lit("../"), urls.encode_parens("path")), F.concat(F.lit("https://"), "domain", F.lit("/wiki/"), F.translate("title", " ", "_")))
    lines = c.join(f, ["domain", "title"], "left").withColumn("line", F.concat(F.lit("- ["), "title", F.lit("]("), to, F.lit(")")))
    lines = numbered(lines, ["domain", "category"], "title")
    part = F.floor((F.col("rn") - 1) / 200).cast("int")
    return lines.withColumn("part", part).groupBy("domain", "category", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "line"))), lambda x: x["line"]), "\n").alias("body"))


@query("""
with k as (select distinct domain, unnest(categories) as title from manifest),
lists as (select domain, title, coalesce(target_directory, '') as dir from manifest where is_list_page),
p as (select domain, coalesce(target_directory, '') as dir, count(distinct title) as n, min(title) as first_title, max(title) as last_title from manifest where ns is distinct from 14 group by all)
select distinct l.domain, l.title, l.dir, coalesce(p.n, 0) as n_members, p.first_title, p.last_title from lists l left join p on p.domain = l.domain and p.dir = l.dir where not exists (select 1 from k where k.domain = l.domain and k.title = l.title)""")
def category_fallback(spark: SparkSession, d: str) -> DataFrame:
    """List pages that no page names as its category get the pages of their directory as members; each directory is summed once."""
    m = table(spark, d, "manifest").withColumn("dir", F.coalesce("target_directory", F.lit("")))
    named = m.select("domain", F.explode("categories").alias("title")).distinct()
    lists = m.where("is_list_page").select("domain", "title", "dir").distinct().join(named, ["domain", "title"], "left_anti")
    members = m.where("ns is null or ns <> 14").groupBy("domain", "dir").agg(F.count_distinct("title").alias("n"), F.min("title").alias("first_title"), F.max("title").alias("last_title"))
    return lists.join(members, ["domain", "dir"], "left").select("domain", "title", "dir", F.coalesce("n", F.lit(0).cast("long")).alias("n_members"), "first_title", "last_title")


_EDGES = r"""edges as (select distinct r.domain || '|' || r.title as source, r.domain || '|' || replace(h, '_', ' ') as target, h from (select domain, title, unnest(regexp_extract_all(html, 'href="/wiki/([^"?#]+)', 1)) as h from raw_pages where html is not null) r)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """(source, target, h): wiki links of stored pages; pages are named by domain and title."""
    h = table(spark, d, "raw_pages").where("html is not null").select("domain", "title", F.explode(F.regexp_extract_all("html", F.lit('href="/wiki/([^"?#]+)'), F.lit(1))).alias("h"))
    return h.select(F.concat("domain", F.lit("|"), "title").alias("source"), F.concat("domain", F.lit("|"), F.translate("h", "_", " ")).alias("target"), "h").distinct()


#: Which page types a page's links may lead to, and the pattern that targets must fit, as a site configuration writes them.
_RULES = (("static_article", "static_article"), ("static_article", "article"), ("article", "static_article"), ("article", "article"), ("", "static_article"), ("", "article"))
_BUDGET = 500


@query(rf"""
with recursive {_EDGES}, types as (select domain || '|' || title as page, lower(coalesce(arg_min(page_type, page_seq), '')) as kind from manifest where domain is not null and title is not null group by all),
rules(a, b) as (values ('static_article', 'static_article'), ('static_article', 'article'), ('article', 'static_article'), ('article', 'article'), ('', 'static_article'), ('', 'article')),
ok as (select e.source, e.target from edges e left join types s on s.page = e.source left join types t on t.page = e.target
  where exists (select 1 from rules where a = coalesce(s.kind, '') and b = coalesce(t.kind, 'article')) and not regexp_matches(e.h, '^(?:File|Category|Template|Talk|Special|Help|MediaWiki):')),
seeds as (select distinct page from types where kind in ('static_article', 'article')), r(page, depth) as (select page, 0 from seeds union select ok.target, r.depth + 1 from r join ok on ok.source = r.page where r.depth < 3)
select page, cast(min(depth) as integer) as depth from r group by page order by depth, page limit {_BUDGET}""")
def crawl_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """ITR1, J16, SRT0: a crawl over stored links: each link must be allowed by the types of its two pages and by the target
    pattern; pages in order of depth and name up to the page budget (a budget by design)."""
    m = table(spark, d, "manifest").where("domain is not null and title is not null")
    types = m.groupBy(F.concat("domain", F.lit("|"), "title").alias("page")).agg(F.lower(F.coalesce(F.min_by("page_type", F.when(F.col("page_type").isNotNull(), F.col("page_seq"))), F.lit(""))).alias("kind"))
    rules = spark.createDataFrame(list(_RULES), "a string, b string")
    e = _edges(spark, d).where(~F.col("h").rlike(_SKIP))
    e = e.join(types.select(F.col("page").alias("source"), F.col("kind").alias("ka")), "source", "left").join(types.select(F.col("page").alias("target"), F.col("kind").alias("kb")), "target", "left")
    ok = e.withColumn("a", F.coalesce("ka", F.lit(""))).withColumn("b", F.coalesce("kb", F.lit("article"))).join(F.broadcast(rules), ["a", "b"], "left_semi")  # six rows of configuration
    return crawl.reach(ok.select("source", "target"), types.where(F.col("kind").isin("static_article", "article")).select("page"), max_depth=3, max_pages=_BUDGET)


@query(rf"""
with recursive {_EDGES}, ok as (select source, target from edges where regexp_full_match('/wiki/' || h, '/wiki/[^/]*')),
seeds as (select min(domain || '|' || title) as page from raw_pages where html is not null group by domain), r(page, depth) as (select page, 0 from seeds union select ok.target, r.depth + 1 from r join ok on ok.source = r.page where r.depth < 6)
select page, cast(min(depth) as integer) as depth from r group by page""")
def crawl_site(spark: SparkSession, d: str) -> DataFrame:
    """ITR2, FLT8: a free crawl of every site from its first stored page: links of the same domain whose path fits a glob."""
    e = _edges(spark, d).where(F.concat(F.lit("/wiki/"), "h").rlike(urls.glob_regex("/wiki/*")))
    seeds = table(spark, d, "raw_pages").where("html is not null").groupBy("domain").agg(F.min(F.concat("domain", F.lit("|"), "title")).alias("page")).select("page")
    return crawl.reach(e.select("source", "target"), seeds, max_depth=6)


@query(rf"""
with l as (select distinct r.cache_id, r.domain, r.title, case when starts_with(h, '/') then 'https://' || r.domain || h else h end as u, h from (select cache_id, domain, title, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as h from raw_pages where html is not null) r),
p as (select url, arg_min({{'dir': coalesce(target_directory, ''), 'file': target_filename}}, page_seq) as p from manifest where url is not null group by url),
s as (select domain, title, coalesce(arg_min(coalesce(target_directory, ''), page_seq), '') as dir from manifest group by all)
select l.cache_id, l.h as href, {_RELATIVE.format(s="coalesce(s.dir, '')", t='p.p.dir', f='p.p.file')} as relative from l join p on p.url = regexp_replace(l.u, '[?].*$', '') left join s on s.domain = l.domain and s.title = l.title""")
def relativized_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of stored pages to crawled pages, made absolute, joined by URL and turned into paths relative to the page's own file."""
    l = table(spark, d, "raw_pages").where("html is not null").select("cache_id", "domain", "title", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))).alias("href")).distinct()  # noqa: E741
    u = F.when(F.col("href").startswith("/"), F.concat(F.lit("https://"), "domain", "href")).otherwise(F.col("href"))
    m = table(spark, d, "manifest")
    p = m.where("url is not null").groupBy(F.col("url").alias("u")).agg(F.min_by(F.struct(F.coalesce("target_directory", F.lit("")).alias("dir"), F.col("target_filename").alias("file")), "page_seq").alias("p"))
    s = m.groupBy("domain", "title").agg(F.min_by(F.coalesce("target_directory", F.lit("")), "page_seq").alias("dir"))
    j = l.withColumn("u", F.regexp_replace(u, "[?].*$", "")).join(p, "u").join(s, ["domain", "title"], "left")
    return j.select("cache_id", "href", urls.relative_path(F.coalesce("dir", F.lit("")), F.col("p.dir"), F.col("p.file")).alias("relative"))
