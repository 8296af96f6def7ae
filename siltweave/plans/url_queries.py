"""Queries over titles, URLs and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import urls
from siltweave.io import table
from siltweave.plans.registry import query

SPECIAL = {3000: "Portal"}


@query("""
select page_seq,
  case when ns = 14 then translate(regexp_replace(title, '^Category:', ''), ' :/', '___') when ns = 3000 then 'Portal' else '' end as directory,
  case when ns = 14 then 'index.md' when ns = 3000 then regexp_replace(translate(title, ' :/', '___'), '^Portal_', '') || '.md' else translate(title, ' :/', '___') || '.md' end as file,
  regexp_replace(regexp_replace(translate(title, ' ', '_'), '_+', '_', 'g'), '^_|_$', '', 'g') as cache_key
from manifest""")
def title_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN1, FN2: where a title is filed and cached."""
    return table(spark, d, "manifest").select("page_seq", urls.title_directory("title", "ns", SPECIAL).alias("directory"), urls.title_file("title", "ns", SPECIAL).alias("file"), urls.cache_key("title").alias("cache_key"))


@query("""
with u as (select cache_id, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as p from raw_pages),
s as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^/+', ''), '[^A-Za-z0-9/_-]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') as a,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^/+|/+$', '', 'g'), '\\.html?$', ''), '[^A-Za-z0-9/_-]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as b,
  translate(regexp_replace(p, '^/+|/+$', '', 'g'), '/', '_') as c,
  left(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) as e from u)
select cache_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, case when a = '' then 'index' else a end as slug,
  case when b = '' then 'index' else b end || '.md' as markdown_path, case when c = '' then 'index' else c end as flat_path, case when e = '' then 'target' else e end as name from s""")
def url_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN3 to FN6: the file names derived from a URL."""
    u = F.col("url")
    return table(spark, d, "raw_pages").select("cache_id", urls.host(u).alias("host"), urls.cache_slug(u).alias("slug"), urls.markdown_path(u).alias("markdown_path"), urls.flat_path(u).alias("flat_path"), urls.slugify(u).alias("name"))


_LINKS = """links as (select cache_id, domain, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) as href from raw_pages where html is not null)"""


def links(spark: SparkSession, d: str) -> DataFrame:
    """K21, SRC3: every link of every stored page with its place on the page; hrefs with a fragment are left out."""
    found = F.regexp_extract_all("html", F.lit('href="([^"#]+)"'), F.lit(1))
    return table(spark, d, "raw_pages").where("html is not null").select("cache_id", "domain", F.posexplode(found).alias("at", "href"))


@query(f"with {_LINKS} select domain, count(*) as n_links, count(distinct href) as n_targets, count(distinct cache_id) as n_pages from links group by domain")
def link_index(spark: SparkSession, d: str) -> DataFrame:
    """Links, distinct targets and linking pages of each domain."""
    return links(spark, d).groupBy("domain").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_targets"), F.count_distinct("cache_id").alias("n_pages"))


@query(f"""
with {_LINKS}, n as (select domain, case when trim(href) = '' or lower(trim(href)) like 'javascript:%' then null when trim(href) like '//%' then 'https:' || trim(href)
  when trim(href) like '/%' then 'https://' || domain || trim(href) else trim(href) end as target from links)
select domain, target, count(*) as n from n where target is not null group by all""")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    """FN7: links made absolute, counted by target."""
    target = urls.normalize_href(F.col("href"), F.col("domain"))
    return links(spark, d).select("domain", target.alias("target")).where("target is not null").groupBy("domain", "target").agg(F.count("*").alias("n"))


@query(f"""
with {_LINKS} select href, count(distinct domain) as n_domains, count(*) as n from links group by href order by n_domains desc, n desc, href limit 50""")
def link_target_topk(spark: SparkSession, d: str) -> DataFrame:
    """SRT1: the targets linked from most domains (a top-k report)."""
    found = links(spark, d).groupBy("href").agg(F.count_distinct("domain").alias("n_domains"), F.count("*").alias("n"))
    return found.orderBy(F.desc("n_domains"), F.desc("n"), "href").limit(50)


@query(f"""
with {_LINKS} select domain, count(*) as n from links
where (href like '/wiki/%' or href like '/w/%') and href not like '%action=%' and href not like '%oldid=%' and href not like '%redlink=1%'
and not regexp_matches(href, '^/wiki/(File|Category|Template|Talk|Special|Help|User):') group by domain""")
def wiki_links(spark: SparkSession, d: str) -> DataFrame:
    """FLT10, FLT11: links to articles of the wiki itself."""
    h = F.col("href")
    keep = (h.startswith("/wiki/") | h.startswith("/w/")) & ~h.rlike("action=|oldid=|redlink=1") & ~h.rlike("^/wiki/(File|Category|Template|Talk|Special|Help|User):")
    return links(spark, d).where(keep).groupBy("domain").agg(F.count("*").alias("n"))


@query("""
with u as (select cache_id, regexp_extract(url, '^([^#]*)', 1) as u, unnest(range(1, 4)) as page from raw_pages where url is not null)
select cache_id, cast(page as integer) as page, case when regexp_matches(u, '[?&]page=') then regexp_replace(u, '([?&]page=)[^&#]*', '\\1' || page, 'g') else u || case when contains(u, '?') then '&' else '?' end || 'page=' || page end as next_url from u""")
def pagination_urls(spark: SparkSession, d: str) -> DataFrame:
    """FN11, ITR4: the first three pages of every paginated URL."""
    pages = table(spark, d, "raw_pages").where("url is not null").select("cache_id", "url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    return pages.select("cache_id", "page", urls.set_query("url", "page", F.col("page")).alias("next_url"))


@query("""
with m as (select *, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as p from manifest where url is not null),
s as (select page_seq, domain, list_filter(string_split(p, '/'), lambda x: x <> '') as seg from m)
select page_seq, coalesce(seg[-1], 'index') as name, case when len(seg) > 1 then seg[1] else 'root' end as directory,
  list_aggregate(list_transform(string_split(translate(coalesce(seg[-1], 'index'), '_-', '  '), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), 'string_agg', ' ') as title from s""")
def manifest_from_urls(spark: SparkSession, d: str) -> DataFrame:
    """FLT14: title, file name and directory of a page made from its URL alone."""
    seg = F.filter(F.split(urls.path("url"), "/"), lambda x: x != "")
    last = F.coalesce(F.try_element_at(seg, F.lit(-1)), F.lit("index"))
    title = F.array_join(F.transform(F.split(F.translate(last, "_-", "  "), " "), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), " ")
    return table(spark, d, "manifest").where("url is not null").select("page_seq", last.alias("name"), F.when(F.size(seg) > 1, seg[0]).otherwise("root").alias("directory"), title.alias("title"))


@query("""
with m as (select coalesce(domain, '') as domain, coalesce(nullif(target_directory, ''), 'misc') as directory, title, page_seq, is_list_page from manifest)
select domain, lower(directory) as directory, count(*) as n_pages, bool_or(coalesce(is_list_page, false)) as has_index,
  list_aggregate((list(title order by page_seq))[1:5], 'string_agg', ' | ') as sample, cast(greatest(ceil(count(*) * 5 / 60.0), 1) as bigint) as minutes from m group by all""")
def manifest_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG2, AGG5, AGG6, W4: pages of each directory with the first five titles and an estimate of time.

    The five titles are kept by a bounded aggregate, so a directory with a third of all pages is no hot group.
    """
    m = table(spark, d, "manifest").select(F.coalesce("domain", F.lit("")).alias("domain"), F.lower(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc"))).alias("directory"), "title", "page_seq", F.coalesce("is_list_page", F.lit(False)).alias("is_list"))
    counts = m.groupBy("domain", "directory").agg(F.count("*").alias("n_pages"), F.bool_or("is_list").alias("has_index"))
    salted = m.withColumn("salt", F.pmod("page_seq", F.lit(32)))
    sample = first_n(first_n(salted, ["domain", "directory", "salt"], "page_seq", 5), ["domain", "directory"], "page_seq", 5)
    titles = sample.groupBy("domain", "directory").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "title"))), lambda x: x["title"]), " | ").alias("sample"))
    return counts.join(titles, ["domain", "directory"]).withColumn("minutes", F.greatest(F.ceil(F.col("n_pages") * 5 / 60.0), F.lit(1)).cast("bigint"))


def first_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group; a row_number filter that Spark turns into a group limit."""
    from pyspark.sql import Window

    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_rn") <= n).drop("_rn")


#: Include and exclude rules as a site configuration writes them.
INCLUDE = (("article", r"/wiki/[A-M]"), ("late", r"/wiki/[N-Z]"), ("any", r"/wiki/"))
EXCLUDE = ("https://*.test/wiki/*", "/wiki/Z**")


@query(r"""
select page_seq, case when regexp_matches(url, '/wiki/[A-M]') then 'article' when regexp_matches(url, '/wiki/[N-Z]') then 'late' when regexp_matches(url, '/wiki/') then 'any' end as page_type,
  (regexp_full_match(url, 'https://[^/]*\.test/wiki/[^/]*') or regexp_full_match(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/wiki/Z.*')) as excluded from manifest where url is not null""")
def include_exclude_patterns(spark: SparkSession, d: str) -> DataFrame:
    """FLT6, FLT7, J15: the first page type whose pattern fits, and whether an exclusion glob fits URL or path."""
    kind = F.coalesce(*(F.when(F.col("url").rlike(p), F.lit(n)) for n, p in INCLUDE))
    excluded = F.lit(False)
    for glob in EXCLUDE:
        excluded = excluded | F.col("url").rlike(urls.glob_regex(glob)) | urls.path("url").rlike(urls.glob_regex(glob))
    return table(spark, d, "manifest").where("url is not null").select("page_seq", kind.alias("page_type"), excluded.alias("excluded"))


@query(r"""
with h as (select page_seq, regexp_extract(url, '^https?://([^/?#]+)', 1) as host from manifest where url is not null)
select page_seq, host, (select domain from registry r where h.host = r.domain or ends_with(h.host, '.' || r.domain) order by length(domain) desc limit 1) as strategy from h""")
def strategy_longest_suffix(spark: SparkSession, d: str) -> DataFrame:
    """J1, SRT4: the registered domain that is the longest dot suffix of a page's host.

    Hosts are expanded to their few suffixes and joined on equality; distinct hosts only, so the
    registry is probed once a host and not once a page.
    """
    pages = table(spark, d, "manifest").where("url is not null").select("page_seq", urls.host("url").alias("host"))
    parts = F.split("host", r"\.")
    hosts = pages.select("host").distinct().withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))))
    known = table(spark, d, "registry").select(F.col("domain").alias("suffix")).distinct()
    best = hosts.join(known, "suffix").groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("strategy"))
    return pages.join(best, "host", "left").select("page_seq", "host", "strategy")


@query("""
with p as (select cache_id, domain, html from raw_pages where html is not null)
select cache_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title from p""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """The title element of each page."""
    return table(spark, d, "raw_pages").where("html is not null").select("cache_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))


@query("""
with k as (select title, domain, url, row_number() over (partition by regexp_replace(lower(url), '[?#].*$', '') order by page_seq) as rn, page_seq from manifest where url is not null)
select page_seq, domain, title from k where rn = 1""")
def url_canonical_dedup(spark: SparkSession, d: str) -> DataFrame:
    """AGG8, W1, SET1: of pages with the same URL but for query, fragment and case, the first.

    The smallest page_seq of each URL is an aggregate with partial sums, so a URL listed a million times is no hot key.
    """
    pages = table(spark, d, "manifest").where("url is not null").withColumn("canonical", F.regexp_replace(F.lower("url"), "[?#].*$", ""))
    return pages.groupBy("canonical").agg(F.min(F.struct("page_seq", "domain", "title")).alias("m")).select("m.page_seq", "m.domain", "m.title")


@query("""
select page_seq, title from (select *, row_number() over (partition by domain, pageid order by page_seq) as rn from manifest) where pageid is null or rn = 1""")
def pageid_dedup(spark: SparkSession, d: str) -> DataFrame:
    """AGG8: the first page of each domain and page id; pages without an id all stay."""
    m = table(spark, d, "manifest").select("page_seq", "title", "domain", "pageid")
    firsts = m.where("pageid is not null").groupBy("domain", "pageid").agg(F.min(F.struct("page_seq", "title")).alias("m")).select("m.page_seq", "m.title")
    return firsts.unionByName(m.where("pageid is null").select("page_seq", "title"))
