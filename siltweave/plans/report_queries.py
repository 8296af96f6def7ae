"""Smaller reports and lookups over the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import tables, text, urls
from siltweave.io import table
from siltweave.operators.ranks import numbered
from siltweave.plans.registry import query
from siltweave.plans.url_queries import links
from siltweave.sources import sinks


@query("""
with c as (select domain, title, min(coalesce(list_aggregate(categories, 'string_agg', '|'), '')) as cats from manifest where categories is not null group by all)
select r.cache_id, coalesce(c.cats, '') as categories from raw_pages r left join c on c.domain = r.domain and c.title = r.title""")
def category_lookup(spark: SparkSession, d: str) -> DataFrame:
    """SRC6, SRC7: categories of stored pages; a page without an entry gets none."""
    c = table(spark, d, "manifest").where("categories is not null").groupBy("domain", "title").agg(F.min(F.array_join("categories", "|")).alias("cats"))
    return table(spark, d, "raw_pages").select("cache_id", "domain", "title").join(c, ["domain", "title"], "left").select("cache_id", F.coalesce("cats", F.lit("")).alias("categories"))


@query("""
select cache_id, regexp_matches(wikitext, '(?i)\\{\\{\\s*#\\s*(invoke|dpl|lst|if|ifeq)\\s*[:|]') as dynamic, cast(len(regexp_extract_all(wikitext, '\\{\\{')) as bigint) as n_templates from raw_pages where wikitext is not null""")
def dynamic_templates(spark: SparkSession, d: str) -> DataFrame:
    """SRC14: pages whose templates compute, which need the rendered body."""
    w = F.col("wikitext")
    return table(spark, d, "raw_pages").where("wikitext is not null").select("cache_id", w.rlike(r"(?i)\{\{\s*#\s*(invoke|dpl|lst|if|ifeq)\s*[:|]").alias("dynamic"), F.regexp_count(w, F.lit(r"\{\{")).cast("bigint").alias("n_templates"))


@query("""
with b as (select platform, coalesce(html, rendered_html, wikitext, '') as body from raw_pages)
select platform, case when contains(body, '<urlset') then 'sitemap' when regexp_matches(body, '(?i)<!doctype html') then 'page' when contains(body, 'mw-parser-output') then 'mediawiki' when regexp_matches(body, '(?m)^==?[^=]') then 'wikitext' when body = '' then 'empty' else 'fragment' end as kind, count(*) as n from b group by all""")
def stored_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """SRC15: what kind of body was stored."""
    b = F.coalesce("html", "rendered_html", "wikitext", F.lit(""))
    kind = F.when(F.contains(b, F.lit("<urlset")), "sitemap").when(b.rlike("(?i)<!doctype html"), "page").when(F.contains(b, F.lit("mw-parser-output")), "mediawiki").when(b.rlike("(?m)^==?[^=]"), "wikitext").when(b == "", "empty").otherwise("fragment")
    return table(spark, d, "raw_pages").groupBy("platform", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
select page_seq, lpad(cast(row_number() over (partition by domain order by page_seq) as varchar), 6, '0') || '-' || target_filename as file from manifest""")
def page_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """W10, SRC21, ITR3: file names numbered in a site's visit order.

    No task holds a whole site: rows are numbered in id ranges, which counts shift.
    """
    m = table(spark, d, "manifest").select("page_seq", "domain", "target_filename")
    out = numbered(m, ["domain"], "page_seq", F.floor(F.col("page_seq") / 4096))
    return out.select("page_seq", F.concat(F.lpad(F.col("rn").cast("string"), 6, "0"), F.lit("-"), "target_filename").alias("file"))


@query("""
with l as (select domain, unnest(list_concat(regexp_extract_all(html, '<a [^>]*href="([^"#]+)"[^>]*class="[^"]*mw-redirect', 1), regexp_extract_all(html, '<a [^>]*class="[^"]*mw-redirect[^"]*"[^>]*href="([^"#]+)"', 1))) as href from raw_pages where html is not null)
select domain, href, count(*) as n from l group by all""")
def classed_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC3, FLT9: links that carry a given class, whichever attribute comes first."""
    found = F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in ('<a [^>]*href="([^"#]+)"[^>]*class="[^"]*mw-redirect', '<a [^>]*class="[^"]*mw-redirect[^"]*"[^>]*href="([^"#]+)"')))
    return table(spark, d, "raw_pages").where("html is not null").select("domain", F.explode(found).alias("href")).groupBy("domain", "href").agg(F.count("*").alias("n"))


@query("""
with l as (select domain, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as href from raw_pages where html is not null)
select domain, count(*) filter (where contains(href, '/wiki/')) as articles, count(*) filter (where href = '/') as home, count(*) filter (where regexp_matches(href, '^https?://')) as external from l group by domain""")
def href_predicates(spark: SparkSession, d: str) -> DataFrame:
    """FLT8, FLT9: hrefs by contains, equality and scheme."""
    h = F.col("href")
    return links(spark, d).groupBy("domain").agg(F.count_if(F.contains(h, F.lit("/wiki/"))).alias("articles"), F.count_if(h == "/").alias("home"), F.count_if(h.rlike("^https?://")).alias("external"))


@query("""
select page_seq, case when ns = 14 or starts_with(title, 'Category:') then 'category' when is_list_page then 'list' when lower(coalesce(page_type, '')) in ('static_article', 'article') then 'article' else 'page' end as kind from manifest""")
def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """FLT13, FLT15, FLT30: category pages by namespace or prefix, then list pages, then declared types."""
    kind = F.when((F.col("ns") == 14) | F.col("title").startswith("Category:"), "category").when(F.col("is_list_page"), "list").when(F.lower(F.coalesce("page_type", F.lit(""))).isin("static_article", "article"), "article").otherwise("page")
    return table(spark, d, "manifest").select("page_seq", kind.alias("kind"))


@query("""
with l as (select distinct * from fetch_log), a as (select domain, bool_or(http_status = 429 or error_type = 'rate_limited') as limited, bool_or(http_status = 403 or error_type = 'blocked') as blocked, bool_or(http_status = 401) as login, count(*) filter (where status = 'failure') as failures, count(*) as n from l group by domain)
select domain, case when coalesce(login, false) then 'login' when coalesce(blocked, false) and failures > 0.1 * n then 'blocked' when coalesce(limited, false) then 'rate_limit' when failures > 0 then 'unstable' else 'none' end as protection, round(failures / cast(n as double), 2) as failure_rate from a""")
def protection_class(spark: SparkSession, d: str) -> DataFrame:
    """FLT19, AGG19: a site's protection as its attempts show it, and the share of failures."""
    log = table(spark, d, "fetch_log").select("fetch_id", "domain", "status", "http_status", "error_type").distinct()
    ever = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    a = log.groupBy("domain").agg(ever((F.col("http_status") == 429) | (F.col("error_type") == "rate_limited")).alias("limited"), ever((F.col("http_status") == 403) | (F.col("error_type") == "blocked")).alias("blocked"), ever(F.col("http_status") == 401).alias("login"), F.count_if(F.col("status") == "failure").alias("failures"), F.count("*").alias("n"))
    kind = F.when(F.col("login"), "login").when(F.col("blocked") & (F.col("failures") > 0.1 * F.col("n")), "blocked").when(F.col("limited"), "rate_limit").when(F.col("failures") > 0, "unstable").otherwise("none")
    return a.select("domain", kind.alias("protection"), F.round(F.col("failures") / F.col("n"), 2).alias("failure_rate"))


@query("""
select domain, case when starts_with(coalesce(backend, ''), 'mediawiki') then 'api' when list_contains(entry_points, 'sitemap') then 'sitemap' when list_contains(pagination, 'page_param') then 'first_level' else 'crawl' end as backend from registry""")
def crawl_backends(spark: SparkSession, d: str) -> DataFrame:
    """FLT29: how a site is crawled, by its registry entry."""
    kind = F.when(F.coalesce("backend", F.lit("")).startswith("mediawiki"), "api").when(F.array_contains("entry_points", "sitemap"), "sitemap").when(F.array_contains("pagination", "page_param"), "first_level").otherwise("crawl")
    return table(spark, d, "registry").select("domain", kind.alias("backend"))


@query("""
with l as (select result_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from results where content is not null),
g as (select *, lag(line) over (partition by result_id order by n) as prev, lead(line) over (partition by result_id order by n) as next from l)
select result_id, count(*) as n_heads, count(*) filter (where not coalesce(regexp_matches(next, '^\\|[ :|-]+\\|\\s*$'), false)) as n_missing from g where starts_with(line, '|') and not coalesce(starts_with(prev, '|'), false) group by result_id""")
def table_separators(spark: SparkSession, d: str) -> DataFrame:
    """Tables whose first row has no separator below, found among a text's own lines."""
    lines = F.split("content", "\n")
    pairs = F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.arrays_zip(F.concat(F.array(F.lit("")), lines).alias("p"), pairs.alias("q"))
    heads = F.filter(first, lambda x: F.coalesce(F.startswith(x["q"]["a"], F.lit("|")), F.lit(False)) & ~F.startswith(x["p"], F.lit("|")))
    missing = F.filter(heads, lambda x: ~F.coalesce(x["q"]["b"].rlike(r"^\|[ :|-]+\|\s*$"), F.lit(False)))
    return table(spark, d, "results").where("content is not null").select("result_id", F.size(heads).cast("bigint").alias("n_heads"), F.size(missing).cast("bigint").alias("n_missing")).where("n_heads > 0")


def _first_number() -> Column:
    return F.coalesce(F.expr(r"try_cast(regexp_extract(content, '(\\d+) (?:turns|Züge)', 1) as int)"), F.lit(999))


@query("select result_id, title, row_number() over (order by result_id desc nulls last) as position from results")
def numbered_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT5: every result with its place in descending numeric order of ids."""
    rows = table(spark, d, "results").select("result_id", "title", (-F.col("result_id")).alias("place"))
    return numbered(rows, [], "place", name="position").drop("place")


@query("""
select page_seq, row_number() over (order by case when coalesce(is_list_page, false) then 0 else 1 end, case when coalesce(is_list_page, false) then '' else coalesce(target_directory, '') end, title, page_seq) as position from manifest""")
def entity_order(spark: SparkSession, d: str) -> DataFrame:
    """SRT6: list pages by title, then all other pages by directory and title."""
    listed = F.coalesce("is_list_page", F.lit(False))
    place = F.struct(F.when(listed, 0).otherwise(1).alias("a"), F.when(listed, "").otherwise(F.coalesce("target_directory", F.lit(""))).alias("b"), F.col("title").alias("c"), F.col("page_seq").alias("d"))
    return numbered(table(spark, d, "manifest").select("page_seq", place.alias("place")), [], "place", name="position").drop("place")


@query("""
with n as (select result_id, title, coalesce(try_cast(regexp_extract(content, '(\\d+) (?:turns|Züge)', 1) as integer), 999) as number from results where content is not null)
select *, row_number() over (order by number, result_id nulls first, title nulls first) as position from n""")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """SRT3: every text with its place in the order of first numbers, those without one last.

    No task holds all rows: they are numbered by number, those of 999 by id ranges, and shifted by counts.
    """
    rows = table(spark, d, "results").where("content is not null").select("result_id", "title", _first_number().alias("number"))
    ranges = F.when(F.col("number") == 999, F.floor(F.col("result_id") / 4096)).otherwise(F.lit(0))
    rows = rows.withColumn("place", F.struct("number", "result_id", "title"))
    return numbered(rows, [], "place", F.struct("number", ranges.alias("range")), "position").drop("place")


@query(r"""
with n as (select domain, regexp_extract_all(regexp_extract(html, '(?is)<(?:nav|div role="navigation"|div class="top-menu"|div id="mw-navigation")[^>]*>(.*?)</ul>', 1), '<a [^>]*>([^<]+)</a>', 1) as nav, regexp_extract_all(html, '(?is)<h2[^>]*>(?:<span[^>]*>)?([^<]+)<', 1) as h2 from raw_pages where html is not null),
l as (select domain, case when len(nav) > 0 then nav else h2 end as l from n)
select domain, label, count(*) as n from (select domain, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10]) as label from l) group by all""")
def navigation_labels(spark: SparkSession, d: str) -> DataFrame:
    """K19, SRT7: at most ten menu labels of each whole page, else its h2 headings, counted by site."""
    nav = F.regexp_extract_all(F.regexp_extract("html", r'(?is)<(?:nav|div role="navigation"|div class="top-menu"|div id="mw-navigation")[^>]*>(.*?)</ul>', 1), F.lit(r"<a [^>]*>([^<]+)</a>"), F.lit(1))
    h2 = F.regexp_extract_all("html", F.lit(r"(?is)<h2[^>]*>(?:<span[^>]*>)?([^<]+)<"), F.lit(1))
    labels = F.slice(F.array_distinct(F.when(F.size(nav) > 0, nav).otherwise(h2)), 1, 10)
    return table(spark, d, "raw_pages").where("html is not null").select("domain", F.explode(labels).alias("label")).groupBy("domain", "label").agg(F.count("*").alias("n"))


@query("""
with i as (select result_id, unnest(list_distinct(regexp_extract_all(content, '!\\[[^\\]]*\\]\\(([^)\\s]+)', 1))) as image from results where content is not null) select image, count(*) as n from i where regexp_matches(image, '\\.(png|jpg)$') group by image""")
def markdown_images(spark: SparkSession, d: str) -> DataFrame:
    """K22, SNK10: images that converted texts refer to."""
    return sinks.image_references(table(spark, d, "results").select("result_id", "content"), "content", r"\.(png|jpg)$").groupBy("image").agg(F.count("*").alias("n"))


@query("""
with m as (select coalesce(nullif(lower(target_directory), ''), 'misc') as dir, assigned_category, source_categories from manifest)
select count(*) as total_pages, count(distinct dir) as n_directories, count(*) filter (where dir = 'misc') as n_unclassified, count(*) filter (where coalesce(list_contains(source_categories, 'Misc B'), false)) as n_excluded,
  cast(greatest(ceil(count(*) * 0.5 / 60.0), 1) as bigint) as minutes from m""")
def discovery_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG25, SNK6, D12: the totals of a discovery run in one pass."""
    m = table(spark, d, "manifest").select(F.coalesce(F.expr("nullif(lower(target_directory), '')"), F.lit("misc")).alias("dir"), "source_categories")
    return m.agg(
        F.count("*").alias("total_pages"), F.count_distinct("dir").alias("n_directories"), F.count_if(F.col("dir") == "misc").alias("n_unclassified"),
        F.count_if(F.coalesce(F.array_contains("source_categories", "Misc B"), F.lit(False))).alias("n_excluded"), F.greatest(F.ceil(F.count("*") * 0.5 / 60.0), F.lit(1)).cast("bigint").alias("minutes"),
    )


_KEYS = ("turns", "dungeon", "never_used_key", "Züge", "zzunused")


@query("""
with k(key) as (values ('turns'), ('dungeon'), ('never_used_key'), ('Züge'), ('zzunused')), w as (select distinct unnest(regexp_extract_all(content, '[\\p{L}_]+')) as word from results where content is not null)
select key from k where key not in (select word from w)""")
def dead_keys(spark: SparkSession, d: str) -> DataFrame:
    """Configured keys that no text mentions; an anti-join on distinct words instead of a pattern for each key."""
    words = table(spark, d, "results").where("content is not null").select(F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\p{L}_]+"), F.lit(0)))).alias("key"))
    keys = spark.createDataFrame([(k,) for k in _KEYS], "key string")
    return keys.join(words.join(F.broadcast(keys), "key", "left_semi").distinct(), "key", "left_anti")


@query("""
with p as (select url, min(coalesce(nullif(target_directory, ''), 'misc') || '/' || target_filename) as path from manifest where url is not null group by url)
select r.cache_id, coalesce(p.path, case when d = '' then 'index' else d end || '.md') as path, 'https://' || r.domain as site, p.path is not null as listed
from (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g'), '\\.html?$', ''), '[^A-Za-z0-9/_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as d from raw_pages where url is not null) r left join p on p.url = regexp_replace(r.url, '[?#].*$', '')""")
def crawled_paths(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages joined to the files their URLs, fragments and queries dropped, are written to; a page the manifest lacks gets the path its URL would have."""
    p = table(spark, d, "manifest").where("url is not null").groupBy("url").agg(F.min(F.concat(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc")), F.lit("/"), F.col("target_filename"))).alias("path"))
    r = table(spark, d, "raw_pages").where("url is not null").select("cache_id", "domain", F.regexp_replace("url", "[?#].*$", "").alias("url"), urls.markdown_path("url").alias("own"))
    return r.join(p, "url", "left").select("cache_id", F.coalesce("path", "own").alias("path"), F.concat(F.lit("https://"), "domain").alias("site"), F.col("path").isNotNull().alias("listed"))


@query("""
select result_id, '# ' || title || chr(10) || chr(10) || '> Source: ' || 'https://' || domain || chr(10) || chr(10) || content || chr(10) as page from results where content is not null""")
def sourced_pages(spark: SparkSession, d: str) -> DataFrame:
    """SNK8: texts with title and source line."""
    r = table(spark, d, "results").where("content is not null").withColumn("site", F.concat(F.lit("https://"), "domain"))
    return r.select("result_id", sinks.with_source("title", "site", "content").alias("page"))


@query(r"""
with c as (select cache_id, len(regexp_extract_all(html, '(?i)<th[ >]')) as h, len(regexp_extract_all(html, '(?i)<td[ >]')) as d, len(regexp_extract_all(html, '(?i)<table[ >]')) as t from raw_pages where platform = 'mediawiki' and html is not null)
select cache_id, t as n_tables, h + d as n_cells, h as n_heads from c where t > 0""")
def table_functions(spark: SparkSession, d: str) -> DataFrame:
    """§2.16: the table cells of stored fragments by the table function in a lateral join."""
    tables.register(spark)
    table(spark, d, "raw_pages").where("platform = 'mediawiki' and html is not null").createOrReplaceTempView("_fragments")
    return spark.sql("select p.cache_id, count(distinct c.tbl) as n_tables, count(*) as n_cells, count_if(c.is_header) as n_heads from _fragments p, lateral table_cells(p.html) c group by p.cache_id")


@query("""
with a as (select unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as href, generate_subscripts(regexp_extract_all(html, 'href="([^"#]+)"', 1), 1) as pos from raw_pages where html is not null),
l as (select unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as pos from results where content is not null)
select 'links' as kind, count(*) as n, cast(sum(pos - 1) as bigint) as places, count(distinct href) as n_distinct from a union all select 'lines', count(*), cast(sum(pos) as bigint), count(distinct line) from l""")
def lateral_generators(spark: SparkSession, d: str) -> DataFrame:
    """§2.16: links and lines by table functions that are SQL over built-in generators, so no row leaves the JVM."""
    tables.register(spark)
    table(spark, d, "raw_pages").where("html is not null").createOrReplaceTempView("_pages")
    table(spark, d, "results").where("content is not null").createOrReplaceTempView("_texts")
    return spark.sql("""select 'links' as kind, count(*) as n, sum(l.at) as places, count(distinct l.href) as n_distinct from _pages p, lateral extract_links(p.html) l
      union all select 'lines', count(*), sum(l.line_no), count(distinct l.line) from _texts t, lateral text_lines(t.content) l""")


@query("""
select event_type, time_bucket(interval 1 hour, ts) as began, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over events (an extension)."""
    w = table(spark, d, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("w.start").alias("began"), "n", "total")


@query("""
select doc_id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g') as anchor, case when lower(coalesce(lang, 'und')) in ('en', 'de', 'zh') then lower(lang) else 'und' end as lang from documents""")
def document_labels(spark: SparkSession, d: str) -> DataFrame:
    """FN16: anchors and languages of documents, odd language codes folded."""
    lang = F.lower(F.coalesce("lang", F.lit("und")))
    return table(spark, d, "documents").select("doc_id", text.anchor(F.coalesce("title", F.lit(""))).alias("anchor"), F.when(lang.isin("en", "de", "zh"), lang).otherwise("und").alias("lang"))


@query("""
with u as (select cache_id, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as p, domain from raw_pages where url is not null)
select cache_id, replace(replace(p, '(', '%28'), ')', '%29') as path, try_cast(url_decode(replace(p, '+', '%2B')) as varchar) as decoded from u""")
def encoded_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN9, FN10: parentheses encoded, percent escapes decoded."""
    p = urls.path("url")
    return table(spark, d, "raw_pages").where("url is not null").select("cache_id", urls.encode_parens(p).alias("path"), urls.percent_decode(p).alias("decoded"))
