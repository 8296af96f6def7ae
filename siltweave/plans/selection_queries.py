"""How sites are reached and their pages selected: routes, markers, patterns, limits, paged scans and page files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltweave.functions import text, urls
from siltweave.io import table
from siltweave.operators.ranks import numbered
from siltweave.operators.wikitext import QUERY_MARK
from siltweave.plans.link_queries import _RELATIVE, _TREE, files
from siltweave.plans.registry import query
from siltweave.plans.url_queries import first_n
from siltweave.session import shared_folder
from siltweave.sources import readers, sinks


@query("""
with r as (select *, starts_with(coalesce(backend, ''), 'mediawiki') as api, coalesce(anti_crawl_refs, []) as refs from registry),
k as (select *, case when api then 'api' when list_has_any(refs, ['cloudflare-turnstile', 'recaptcha']) or protection_level = 'high' then 'stealth' when protection_level = 'authenticated' or list_has_any(coalesce(page_types, []), ['dynamic_list', 'dynamic_content', 'search_results']) then 'browser' else 'get' end as route from r)
select domain, route, case when route = 'api' then coalesce(file, '') when route = 'stealth' then '' when trim(coalesce(description, '')) <> '' then '-s ' || trim(description) else '--main-text' end as arguments,
  case when list_has_any(refs, ['cloudflare-turnstile', 'recaptcha']) then 'high' when list_contains(refs, 'rate-limit-api') or list_contains(refs, 'rate-limit-html') then 'medium' when list_contains(refs, 'login-wall-redirect') then 'authenticated' else 'low' end as level from k""")
def fetch_routes(spark: SparkSession, d: str) -> DataFrame:
    """FLT22, FN37, FN39: how each site is fetched (a cascade of its registry entry), with which argument, and its protection level."""
    refs, types = F.coalesce("anti_crawl_refs", F.array().cast("array<string>")), F.coalesce("page_types", F.array().cast("array<string>"))
    among = lambda c, *v: F.arrays_overlap(c, F.array(*map(F.lit, v)))
    hard, level = among(refs, "cloudflare-turnstile", "recaptcha"), F.coalesce("protection_level", F.lit(""))
    route = F.when(F.coalesce("backend", F.lit("")).startswith("mediawiki"), "api").when(hard | (level == "high"), "stealth").when((level == "authenticated") | among(types, "dynamic_list", "dynamic_content", "search_results"), "browser").otherwise("get")
    said = F.trim(F.coalesce("description", F.lit("")))
    args = F.when(F.col("route") == "api", F.coalesce("file", F.lit(""))).when(F.col("route") == "stealth", "").when(said != "", F.concat(F.lit("-s "), said)).otherwise("--main-text")
    rank = F.when(hard, "high").when(among(refs, "rate-limit-api", "rate-limit-html"), "medium").when(among(refs, "login-wall-redirect"), "authenticated").otherwise("low")
    return table(spark, d, "registry").withColumn("route", route).select("domain", "route", args.alias("arguments"), rank.alias("level"))


@query(r"""
with l as (select distinct fetch_id, engine, coalesce(error_type, '') as e, status, concat_ws(' ', engine, status, http_status, error_type) as line from fetch_log), k as (select *, regexp_extract(line, '\b(4\d{2}|5\d{2}|3\d{2}|200)\b', 1) as code from l)
select engine, case when code = '' then -1 else cast(code as integer) end as code, case when status = 'success' then 'none' when e in ('parse_error', 'conversion_failure', 'preflight_failure', 'strategy_gap') or code = '' and e = '' then 'internal' else 'external' end as origin, count(*) as n from k group by all""")
def failure_origins(spark: SparkSession, d: str) -> DataFrame:
    """FLT21, FLT26: the status code read out of a log line, and whether a failure is the engine's own or the site's."""
    line = F.concat_ws(" ", "engine", "status", F.col("http_status").cast("string"), "error_type")
    k = table(spark, d, "fetch_log").select("fetch_id", "engine", F.coalesce("error_type", F.lit("")).alias("e"), "status", line.alias("line")).distinct()
    k = k.withColumn("c", F.regexp_extract("line", r"\b(4\d{2}|5\d{2}|3\d{2}|200)\b", 1))
    origin = F.when(F.col("status") == "success", "none").when(F.col("e").isin("parse_error", "conversion_failure", "preflight_failure", "strategy_gap") | (F.col("c") == "") & (F.col("e") == ""), "internal").otherwise("external")
    return k.groupBy("engine", F.when(F.col("c") == "", -1).otherwise(F.expr("try_cast(c as int)")).alias("code"), origin.alias("origin")).agg(F.count("*").alias("n"))


@query(r"""
with l as (select domain, min(case when http_status = 429 or error_type = 'rate_limited' then {'t': ts, 'f': fetch_id, 'k': 'rate-limit'} when http_status = 403 then {'t': ts, 'f': fetch_id, 'k': 'blocked'} when http_status = 401 then {'t': ts, 'f': fetch_id, 'k': 'login-wall'} end).k as kind from fetch_log group by domain),
h as (select domain, bool_or(regexp_matches(lower(html), 'just a moment|checking your browser')) as managed, bool_or(regexp_matches(lower(html), '<iframe[^>]*(?:turnstile|challenges\.)')) as turnstile, bool_or(contains(lower(html), 'recaptcha')) as captcha,
  bool_or(regexp_matches(lower(html), 'type="password"') and regexp_matches(lower(html), 'login|sign in|log in')) as login from raw_pages where html is not null group by domain)
select coalesce(l.domain, h.domain) as domain, coalesce(l.kind, case when h.managed or h.captcha then 'managed-challenge' when h.turnstile then 'turnstile' when h.login then 'login-wall' else 'none' end) as protection, case when l.kind is not null then 'attempts' when h.managed or h.captcha or h.turnstile or h.login then 'html' else '' end as basis
from l full outer join h on h.domain = l.domain""")
def protection_markers(spark: SparkSession, d: str) -> DataFrame:
    """FLT19: a site's protection by its first telling attempt, else by markers in its stored pages."""
    at = lambda k: F.struct("ts", "fetch_id", F.lit(k).alias("k"))
    hit = F.when((F.col("http_status") == 429) | (F.col("error_type") == "rate_limited"), at("rate-limit")).when(F.col("http_status") == 403, at("blocked")).when(F.col("http_status") == 401, at("login-wall"))
    tried = table(spark, d, "fetch_log").groupBy("domain").agg(F.min(hit)["k"].alias("kind"))
    low = F.lower("html")
    shown = table(spark, d, "raw_pages").where("html is not null").groupBy("domain").agg(
        F.bool_or(low.rlike("just a moment|checking your browser") | F.contains(low, F.lit("recaptcha"))).alias("managed"), F.bool_or(low.rlike(r"<iframe[^>]*(?:turnstile|challenges\.)")).alias("turnstile"),
        F.bool_or(low.rlike('type="password"') & low.rlike("login|sign in|log in")).alias("login"),
    )
    marked = F.when(F.col("managed"), "managed-challenge").when(F.col("turnstile"), "turnstile").when(F.col("login"), "login-wall")
    basis = F.when(F.col("kind").isNotNull(), "attempts").when(marked.isNotNull(), "html").otherwise("")
    return tried.join(shown, "domain", "full_outer").select("domain", F.coalesce("kind", marked, F.lit("none")).alias("protection"), basis.alias("basis"))


@query("""
with p as (select domain, unnest(page_types) as t, generate_subscripts(page_types, 1) as pos from registry), e as (select domain, unnest(entry_points[1:5]) as t, generate_subscripts(entry_points[1:5], 1) as pos from registry)
select domain, t || '_page' as id, upper(left(t, 1)) || substr(replace(t, '_', ' '), 2) as label, case when contains(t, 'list') then 'wiki_list_page' else 'wiki_article' end as content_type from p
union all select domain, 'nav_' || (pos - 1), t, 'wiki_list_page' from e""")
def declared_pages(spark: SparkSession, d: str) -> DataFrame:
    """FN38: the page rows a site's entry declares: one a page type and one for each of its first five entry points."""
    r = table(spark, d, "registry")
    p = r.select("domain", F.explode("page_types").alias("t"))
    label = F.concat(F.upper(F.left("t", F.lit(1))), F.substr(F.translate("t", "_", " "), F.lit(2)))
    p = p.select("domain", F.concat("t", F.lit("_page")).alias("id"), label.alias("label"), F.when(F.contains("t", F.lit("list")), "wiki_list_page").otherwise("wiki_article").alias("content_type"))
    e = r.select("domain", F.posexplode(F.slice("entry_points", 1, 5)).alias("at", "label"))
    return p.unionByName(e.select("domain", F.concat(F.lit("nav_"), F.col("at").cast("string")).alias("id"), "label", F.lit("wiki_list_page").alias("content_type")))


def page_pattern(url: Column, pattern: str) -> Column:
    """Whether a URL fits an include pattern: ``exact:`` equals it, ``regex:`` (or bare) is found in it, ``:param`` paths match whole."""
    if pattern.startswith("exact:"):
        return url == pattern[6:]
    if re.search(r"/:[A-Za-z_]", pattern):
        whole = re.match("https?://", pattern)
        return (F.regexp_extract(url, r"^(https?://[^/?#]+[^?#]*)", 1) if whole else urls.path(url)).rlike(urls.parameter_regex(pattern))
    return url.rlike(pattern.removeprefix("regex:"))


def exclude_pattern(url: Column, pattern: str) -> Column:
    """Whether a URL or its path fits an exclude pattern: ``exact:`` is a glob, ``regex:`` (or bare) is searched for."""
    p = urls.glob_regex(pattern[6:]) if pattern.startswith("exact:") else pattern.removeprefix("regex:")
    return url.rlike(p) | urls.path(url).rlike(p)


_INCLUDE = (("first", "exact:https://wiki.mornosver.example/wiki/Luknir"), ("early", "regex:/wiki/[A-K]"), ("page", "/wiki/:name"), ("any", "^https?://"))
_EXCLUDE = ("exact:/wiki/Z**", "exact:https://*.test/wiki/*_*_*", "regex:_M[a-e]")


@query(r"""
with u as (select page_seq, url, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) as p from manifest where url is not null)
select page_seq, case when url = 'https://wiki.mornosver.example/wiki/Luknir' then 'first' when regexp_matches(url, '/wiki/[A-K]') then 'early' when regexp_full_match(p, '/wiki/[^/?#]+') then 'page' when regexp_matches(url, '^https?://') then 'any' end as page_type,
 regexp_matches(url, '^/wiki/Z.*$') or regexp_matches(p, '^/wiki/Z.*$') or regexp_matches(url, '^https://[^/]*\.test/wiki/[^/]*_[^/]*_[^/]*$') or regexp_matches(p, '^https://[^/]*\.test/wiki/[^/]*_[^/]*_[^/]*$') or regexp_matches(url, '_M[a-e]') or regexp_matches(p, '_M[a-e]') as excluded from u""")
def pattern_matches(spark: SparkSession, d: str) -> DataFrame:
    """FLT6, FLT7: the first page type whose include pattern fits, in all its forms, and whether an exclude pattern fits URL or path."""
    u = F.col("url")
    excluded = F.lit(False)
    for p in _EXCLUDE:
        excluded = excluded | exclude_pattern(u, p)
    return table(spark, d, "manifest").where("url is not null").select("page_seq", F.coalesce(*(F.when(page_pattern(u, p), F.lit(n)) for n, p in _INCLUDE)).alias("page_type"), excluded.alias("excluded"))


@query(r"""
with u as (select domain, title, page_seq, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)', 1), ''), 'misc') as dir from manifest where url is not null)
select domain, dir as directory, upper(left(dir, 1)) || substr(replace(dir, '-', ' '), 2) as name, count(*) as n_pages, cast(greatest(ceil(count(*) * 5 / 60.0), 1) as bigint) as minutes, array_to_string((list(title order by page_seq))[1:5], ' | ') as sample from u group by all""")
def sitemap_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG6: pages of each first path segment with the time they take and their first five titles (a sample by design)."""
    m = table(spark, d, "manifest").where("url is not null").withColumn("directory", F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+/([^/?#]+)", 1), F.lit("")), F.lit("misc")))
    m = m.select("domain", "directory", "title", "page_seq")
    counts = m.groupBy("domain", "directory").agg(F.count("*").alias("n_pages"))
    few = first_n(first_n(m.withColumn("salt", F.pmod("page_seq", F.lit(32))), ["domain", "directory", "salt"], "page_seq", 5), ["domain", "directory"], "page_seq", 5)
    sample = few.groupBy("domain", "directory").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "title"))), lambda x: x["title"]), " | ").alias("sample"))
    name = F.concat(F.upper(F.left("directory", F.lit(1))), F.substr(F.translate("directory", "-", " "), F.lit(2)))
    return counts.join(sample, ["domain", "directory"]).select("domain", "directory", name.alias("name"), "n_pages", F.greatest(F.ceil(F.col("n_pages") * 5 / 60.0), F.lit(1)).cast("bigint").alias("minutes"), "sample")


#: Limits of each anti-crawl reference, as their documents state them, the defaults, and what a site's entry overrides.
_TIERS = [("rate-limit-api", 1.0, 1, 5), ("rate-limit-html", 1.5, 2, None), ("default", None, 4, 3)]
_SITES = [("kekkanban.example", 2.5, None, None), ("vosnalsus.example", None, 8, 7)]


@query("""
with t(ref, delay, workers, retries) as (values ('rate-limit-api', 1.0, 1, 5), ('rate-limit-html', 1.5, 2, null), ('default', null, 4, 3)), s(domain, delay, workers, retries) as (values ('kekkanban.example', 2.5, null, null), ('vosnalsus.example', null, 8, 7)),
x as (select domain, unnest(anti_crawl_refs) as ref, generate_subscripts(anti_crawl_refs, 1) as pos from registry), y as (select x.domain, arg_min(t.delay, pos) filter (where t.delay is not null) as delay, arg_min(t.workers, pos) filter (where t.workers is not null) as workers, arg_min(t.retries, pos) filter (where t.retries is not null) as retries, count(t.ref) as n_known, count(*) as n_refs from x left join t on t.ref = x.ref group by 1)
select r.domain, cast(coalesce(s.delay, y.delay, 0.5) as double) as delay, cast(coalesce(s.workers, y.workers, 4) as integer) as workers, cast(coalesce(s.retries, y.retries, 3) as integer) as retries, coalesce(y.n_refs - y.n_known, 0) as n_unknown from registry r left join s on s.domain = r.domain left join y on y.domain = r.domain""")
def rate_limit_fields(spark: SparkSession, d: str) -> DataFrame:
    """FN34, SRC22: each limit of a site from its own entry, else from the first of its references (loaded by id) that states it, else the default."""
    tiers, sites = spark.createDataFrame(_TIERS, "ref string, delay double, workers int, retries int"), spark.createDataFrame(_SITES, "domain string, d double, w int, r int")
    x = table(spark, d, "registry").select("domain", F.posexplode("anti_crawl_refs").alias("at", "ref")).join(F.broadcast(tiers.withColumn("known", F.lit(1))), "ref", "left")  # three rows of configuration
    y = x.groupBy("domain").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("delay", "workers", "retries")), (F.count("*") - F.count("known")).alias("n_unknown"))
    r = table(spark, d, "registry").select("domain").join(F.broadcast(sites), "domain", "left").join(y, "domain", "left")
    return r.select("domain", F.coalesce("d", "delay", F.lit(0.5)).alias("delay"), F.coalesce("w", "workers", F.lit(4)).alias("workers"), F.coalesce("r", "retries", F.lit(3)).alias("retries"), F.coalesce("n_unknown", F.lit(0).cast("long")).alias("n_unknown"))


@query("""
with n as (select domain, ns, title, row_number() over (partition by domain, ns order by title, page_seq) - 1 as rn from manifest where domain is not null)
select domain, ns, cast(floor(rn / 50) as bigint) as batch, count(*) as n_pages, min(title) as first_title, max(title) as continue_from from n group by all""")
def all_pages(spark: SparkSession, d: str) -> DataFrame:
    """SRC1: the paged scan of all pages of a site and namespace, from the stored listing: batches of 50 with the title to go on from."""
    m = table(spark, d, "manifest").where("domain is not null").select("domain", "ns", F.struct("title", "page_seq").alias("place"), "title")
    n = numbered(m, ["domain", "ns"], "place")
    return n.groupBy("domain", "ns", F.floor((F.col("rn") - 1) / 50).alias("batch")).agg(F.count("*").alias("n_pages"), F.min("title").alias("first_title"), F.max("title").alias("continue_from"))


@query("""
with lists as (select distinct domain, title from manifest where is_list_page), p as (select domain, title, arg_max(wikitext, {'a': fetched_at, 'b': cache_id}) as w, max(cache_id) as c from raw_pages where wikitext is not null and fetched_at is not null group by all)
select lists.domain, lists.title, length(p.w) as n_chars, p.w is not null as fetched from lists left join p on p.domain = lists.domain and p.title = lists.title""")
def list_page_bodies(spark: SparkSession, d: str) -> DataFrame:
    """SRC20: list pages with the wikitext of their newest stored page; only sizes are shuffled."""
    lists = table(spark, d, "manifest").where("is_list_page").select("domain", "title").distinct()
    p = table(spark, d, "raw_pages").where("wikitext is not null and fetched_at is not null").groupBy("domain", "title").agg(F.max_by(F.length("wikitext"), F.struct("fetched_at", "cache_id")).cast("bigint").alias("n_chars"))
    return lists.join(p, ["domain", "title"], "left").select("domain", "title", "n_chars", F.col("n_chars").isNotNull().alias("fetched"))


@query("""
with s as (select domain, count(distinct url) as n_urls from manifest where url is not null group by domain)
select 'urls' as kind, domain as name, n_urls as n from s union all select 'error', 'not_fetched', 1 union all select 'error', 'nested_index', 1 union all select 'error', 'parse_error', 1""")
def sitemap_index(spark: SparkSession, d: str) -> DataFrame:
    """SRC9: an index of all sites' sitemaps, written from the manifest with three bad entries, resolved one level deep: URLs and errors."""
    m = table(spark, d, "manifest").where("url is not null").select("domain", "url", "page_seq")
    m = numbered(m, ["domain"], "page_seq", F.floor(F.col("page_seq") / 4096))
    loc = F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))
    maps = m.groupBy("domain", F.floor((F.col("rn") - 1) / 1000).alias("chunk")).agg(F.concat(F.lit("<urlset >"), F.array_join(F.collect_list(loc), ""), F.lit("</urlset>")).alias("xml"))
    maps = maps.select(F.concat(F.lit("https://maps.example/"), "domain", F.lit("-"), F.col("chunk").cast("string"), F.lit(".xml")).alias("url"), "xml", F.lit(200).alias("http_code"))
    bad = spark.createDataFrame([("https://maps.example/deep.xml", "<sitemapindex ><sitemap><loc>https://x/y</loc></sitemap></sitemapindex>", 200), ("https://maps.example/bad.xml", "<html>", 200)], "url string, xml string, http_code int")
    names = maps.select("url").unionByName(bad.select("url")).unionByName(spark.createDataFrame([("https://maps.example/gone.xml",)], "url string"))
    index = names.agg(F.concat(F.lit("<sitemapindex >"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))  # one name a thousand URLs
    found, errors = readers.resolve_sitemaps(maps.unionByName(bad).unionByName(index.select(F.lit("index").alias("url"), "xml", F.lit(200).alias("http_code"))), "index")
    urls_ = found.groupBy(urls.host("url").alias("name")).agg(F.count_distinct("url").alias("n")).select(F.lit("urls").alias("kind"), "name", "n")
    return urls_.unionByName(errors.groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("error").alias("kind"), "name", "n"))


@query(f"""
with {_TREE}, last as (select domain, title, arg_max(content, {{'a': converted_at, 'b': result_id}}) as content from results where status = 'ok' and length(content) > 0 group by all)
select files.domain, files.path, md5(replace(last.content, '<!-- query result -->', '')) as digest, length(last.content) as n_chars from files join last using (domain, title)""")
def page_files(spark: SparkSession, d: str) -> DataFrame:
    """ASM1, SNK4: the files of the output tree, one a written page, with the digest of what is written, placeholders out."""
    r = table(spark, d, "results").where("status = 'ok' and length(content) > 0")
    last = r.groupBy("domain", "title").agg(F.max_by("result_id", F.struct("converted_at", "result_id")).alias("result_id"))
    body = r.select("result_id", F.md5(F.replace("content", F.lit(QUERY_MARK), F.lit("")).cast("binary")).alias("digest"), F.length("content").cast("bigint").alias("n_chars"))
    return files(spark, d).join(last, ["domain", "title"]).join(body, "result_id").select("domain", "path", "digest", "n_chars")


@query("""
with l as (select distinct domain, title, coalesce(target_directory, '') as dir, target_filename as file from manifest where is_list_page),
m as (select distinct domain, coalesce(target_directory, '') as dir, title, target_filename as file from manifest where not coalesce(is_list_page, false) and ns is distinct from 14),
b as (select l.domain, l.dir, l.title as list_title, m.title, '- [' || m.title || '](' || m.file || ')' as line from l join m on m.domain = l.domain and m.dir = l.dir),
n as (select *, row_number() over (partition by domain, dir, list_title order by title, line) - 1 as rn from b)
select domain, dir, list_title, cast(floor(rn / 200) as integer) as part, '# ' || list_title || chr(10) || chr(10) || string_agg(line, chr(10) order by title, line) as body from n group by domain, dir, list_title, floor(rn / 200)""")
def list_page_index(spark: SparkSession, d: str) -> DataFrame:
    """ASM3: the index of each list page: its title and a bullet for each page of its directory, 200 a part."""
    m = table(spark, d, "manifest").select("domain", F.coalesce("target_directory", F.lit("")).alias("dir"), "title", F.col("target_filename").alias("file"), F.coalesce("is_list_page", F.lit(False)).alias("listed"), "ns")
    lists = m.where("listed").select("domain", "dir", F.col("title").alias("list_title")).distinct()
    lines = m.where("not listed and (ns is null or ns <> 14)").select("domain", "dir", "title", "file").distinct().join(lists, ["domain", "dir"]).withColumn("line", F.concat(F.lit("- ["), "title", F.lit("]("), "file", F.lit(")")))
    n = numbered(lines.withColumn("place", F.struct("title", "line")), ["domain", "dir", "list_title"], "place")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: x["line"]), "\n")
    return n.groupBy("domain", "dir", "list_title", F.floor((F.col("rn") - 1) / 200).cast("int").alias("part")).agg(F.concat(F.lit("# "), "list_title", F.lit("\n\n"), body).alias("body"))


@query("""
select distinct domain, case when coalesce(target_directory, '') = '' then '' else target_directory || '/' end || target_filename as path from manifest m where is_list_page and target_filename <> 'index.md'
and exists (select 1 from manifest k where k.domain = m.domain and coalesce(k.target_directory, '') = coalesce(m.target_directory, '') and not coalesce(k.is_list_page, false))""")
def redundant_list_files(spark: SparkSession, d: str) -> DataFrame:
    """ASM5: files of list pages that an index of the same directory takes the place of."""
    m = table(spark, d, "manifest").withColumn("dir", F.coalesce("target_directory", F.lit("")))
    filled = m.where(~F.coalesce("is_list_page", F.lit(False))).select("domain", "dir").distinct()
    return m.where("is_list_page and target_filename <> 'index.md'").join(filled, ["domain", "dir"], "left_semi").select("domain", urls.joined("dir", "target_filename").alias("path")).distinct()


@query(f"""
with {_TREE}, c as (select distinct r.domain, r.title as page, replace(unnest(regexp_extract_all(html, '<li[^>]*>\\s*<a[^>]*href="/wiki/([^"?#]+)', 1)), '_', ' ') as card from raw_pages r where html is not null),
s as (select domain, title, coalesce(arg_min(coalesce(target_directory, ''), page_seq), '') as dir from manifest group by all)
select c.domain, c.page, c.card, case when f.file is null then replace(replace(c.card, ' ', '_'), ':', '_') || '.md' else {_RELATIVE.format(s="coalesce(s.dir, '')", t='f.dir', f='f.file')} end as target, f.file is not null as written
from c left join files f on f.domain = c.domain and f.title = c.card left join s on s.domain = c.domain and s.title = c.page""")
def card_links(spark: SparkSession, d: str) -> DataFrame:
    """Linked list entries of stored pages joined by the title in their href to the files they are written to; a miss gets the name its title would have."""
    h = F.explode(F.regexp_extract_all("html", F.lit(r'<li[^>]*>\s*<a[^>]*href="/wiki/([^"?#]+)'), F.lit(1)))
    c = table(spark, d, "raw_pages").where("html is not null").select("domain", F.col("title").alias("page"), h.alias("h")).select("domain", "page", F.translate("h", "_", " ").alias("card")).distinct()
    s = table(spark, d, "manifest").groupBy("domain", F.col("title").alias("page")).agg(F.min_by(F.coalesce("target_directory", F.lit("")), "page_seq").alias("home"))
    j = c.join(files(spark, d).select("domain", F.col("title").alias("card"), "dir", "file"), ["domain", "card"], "left").join(s, ["domain", "page"], "left")
    own = F.concat(F.translate(F.translate("card", " ", "_"), ":", "_"), F.lit(".md"))
    return j.select("domain", "page", "card", F.when(F.col("file").isNull(), own).otherwise(urls.relative_path(F.coalesce("home", F.lit("")), "dir", F.col("file"))).alias("target"), F.col("file").isNotNull().alias("written"))


@query("""
with c as (select domain, count(*) as n, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'error') as bad, count(*) filter (where coalesce(content, '') = '') as blank from results group by domain)
select domain, concat_ws(chr(10), '# Run of ' || domain, '', '- pages: ' || n, '- ok: ' || ok, '- errors: ' || bad, '- empty: ' || blank, '', case when bad * 2 > n then 'Most pages failed.' when bad > 0 then 'Some pages failed.' else 'All pages were converted.' end) as report from c""")
def run_reports(spark: SparkSession, d: str) -> DataFrame:
    """SNK13: a Markdown report of each site's run."""
    c = table(spark, d, "results").groupBy("domain").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("bad"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("blank"))
    said = F.when(F.col("bad") * 2 > F.col("n"), "Most pages failed.").when(F.col("bad") > 0, "Some pages failed.").otherwise("All pages were converted.")
    return c.where("domain is not null").select("domain", F.concat_ws("\n", F.concat(F.lit("# Run of "), "domain"), F.lit(""), *(F.concat(F.lit(f"- {t}: "), F.col(x).cast("string")) for t, x in (("pages", "n"), ("ok", "ok"), ("errors", "bad"), ("empty", "blank"))), F.lit(""), said).alias("report"))


@query("""
with r as (select domain, split_part(coalesce(backend, ''), '-', 1) as soft, coalesce(protection_level, '') as level from registry),
t as (select a.domain, min(b.domain) filter (where b.soft = a.soft and b.level = a.level) as both_, min(b.domain) filter (where b.soft = a.soft) as soft, min(b.domain) filter (where b.level = a.level) as level from r a left join r b on b.domain <> a.domain group by a.domain)
select domain, coalesce(both_, soft, level, 'default') as template, case when both_ is not null then 1 when soft is not null then 2 when level is not null then 3 else 4 end as tier from t""")
def template_matches(spark: SparkSession, d: str) -> DataFrame:
    """The entry that a new site's is modelled on: one of the same software and protection, else of the same software, else of the same protection."""
    r = table(spark, d, "registry").select("domain", F.element_at(F.split(F.coalesce("backend", F.lit("")), "-"), 1).alias("soft"), F.coalesce("protection_level", F.lit("")).alias("level"))

    def first_other(*keys: str) -> Column:
        two = F.slice(F.array_sort(F.collect_set("domain").over(Window.partitionBy(*keys))), 1, 2)  # the registry is a table of fixed size
        return F.get(F.filter(two, lambda x: x != F.col("domain")), F.lit(0))

    t = r.select("domain", first_other("soft", "level").alias("a"), first_other("soft").alias("b"), first_other("level").alias("c"))
    tier = F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).when(F.col("c").isNotNull(), 3).otherwise(4)
    return t.select("domain", F.coalesce("a", "b", "c", F.lit("default")).alias("template"), tier.alias("tier"))


@query(r"""
select cache_id, length(regexp_replace(html, '(?is)<iframe[^>]*(?:youtube|youtu\.be|vimeo)[^>]*>.*?</iframe>|\[?Play video\]?', '', 'g')) as n_left, len(regexp_extract_all(html, '(?i)<span class="[^"]*tooltip')) as n_tooltips from raw_pages where html is not null""")
def embedded_residue(spark: SparkSession, d: str) -> DataFrame:
    """FN25: what is left of a page without embedded players, and how many tooltips it has."""
    h = table(spark, d, "raw_pages").where("html is not null")
    return h.select("cache_id", F.length(text.strip_video("html")).cast("bigint").alias("n_left"), F.regexp_count("html", F.lit('(?i)<span class="[^"]*tooltip')).cast("bigint").alias("n_tooltips"))


@query("""
with k as (select platform, domain, title, max(fetched_at) as newest from raw_pages where platform is not null and domain is not null and title is not null and fetched_at is not null group by all)
select platform, count(*) as n_pages, count(distinct domain) as n_domains, max(newest) as newest from k group by platform""")
def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SRC12, SRC13: stored pages put into a page cache in two deliveries and read back; the newest version of each page is there."""
    path = shared_folder(spark, "cache")
    pages = table(spark, d, "raw_pages").where("platform is not null and domain is not null and title is not null and fetched_at is not null").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    half = F.pmod(F.xxhash64("cache_id"), F.lit(2))
    for k in (0, 1):  # both halves are delivered
        sinks.upsert_cache(pages.where(half == k), path)
    got = readers.page_cache(spark, path)
    return got.groupBy("platform").agg(F.count("*").alias("n_pages"), F.count_distinct("domain").alias("n_domains"), F.max("fetched_at").cast("timestamp_ntz").alias("newest"))


@query("""
select domain, count(*) as n_pages, count(url) as n_urls, count(*) filter (where coalesce(is_list_page, false)) as n_lists, cast(sum(coalesce(len(categories), 0)) as bigint) as n_categories from manifest where domain is not null group by domain""")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SRC11, SNK3, SNK5: each site's manifest written as JSON documents of statistics and pages, at most 1,000 pages each, and read back."""
    path = shared_folder(spark, "manifest")
    m = table(spark, d, "manifest").where("domain is not null")
    fields = [f.name for f in readers.MANIFEST.fields]
    n = numbered(m, ["domain"], "page_seq", F.floor(F.col("page_seq") / 4096))
    docs = n.groupBy("domain", F.floor((F.col("rn") - 1) / 1000).alias("part")).agg(F.struct(F.count("*").alias("total"), F.count("url").alias("with_url")).alias("stats"), F.collect_list(F.struct("domain", *fields)).alias("pages"))
    sinks.write_json(docs.select("domain", "stats", "pages"), path)
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("pages", T.ArrayType(readers.MANIFEST))])
    p = spark.read.schema(schema).json(path).select("domain", F.explode("pages").alias("p")).select("domain", "p.*")
    return p.groupBy("domain").agg(F.count("*").alias("n_pages"), F.count("url").alias("n_urls"), F.count_if(F.coalesce("is_list_page", F.lit(False))).alias("n_lists"), F.sum(F.coalesce(F.when(F.col("categories").isNotNull(), F.size("categories")), F.lit(0))).cast("bigint").alias("n_categories"))


@query(f"""
with {_TREE}, last as (select domain, title, arg_max(content, {{'a': converted_at, 'b': result_id}}) as content from results where status = 'ok' and length(content) > 0 group by all), f as (select files.domain, files.path, any_value(last.content) as content from files join last using (domain, title) group by all having count(*) = 1)
select domain, count(*) as n_files, cast(sum(length(content)) as bigint) as n_chars from f group by domain""")
def tree_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, SNK4, SRC18: the output tree written as files on the shared folder and read back; paths that two pages claim are left out."""
    root = shared_folder(spark, "tree")
    r = table(spark, d, "results").where("status = 'ok' and length(content) > 0")
    last = r.groupBy("domain", "title").agg(F.max_by("result_id", F.struct("converted_at", "result_id")).alias("result_id"))
    tree = files(spark, d).join(last, ["domain", "title"])
    once = tree.groupBy("domain", "path").agg(F.count("*").alias("n"), F.min("result_id").alias("result_id")).where("n = 1")
    sinks.write_tree(once.join(r.select("result_id", "content"), "result_id").select(F.concat("domain", F.lit("/"), "path").alias("path"), "content"), root)
    got = readers.text_tree(spark, root).withColumn("domain", F.regexp_extract("path", "/tree-[0-9a-f]+/([^/]+)/", 1))
    return got.groupBy("domain").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query(r"""
select cache_id, case when regexp_matches(html, 'class="redirectMsg"') then coalesce(replace(url_decode(regexp_extract(html, '(?is)class="redirectMsg".*?<a\s+href="/wiki/([^"]+)"', 1)), '_', ' '), '') when regexp_matches(wikitext, '(?i)^\s*#redirect\b') then trim(regexp_extract(wikitext, '(?i)^\s*#redirect\s*:?\s*\[\[([^\]|#]+)', 1)) end as target,
  'https://' || domain || '/wiki/' || replace(title, ' ', '_') as source from raw_pages""")
def redirect_marks(spark: SparkSession, d: str) -> DataFrame:
    """FLT23, AGG12: what a stored page redirects to, by its notice or its wikitext: '' where the target can't be read, null where it redirects nowhere."""
    said = F.regexp_extract("html", r'(?is)class="redirectMsg".*?<a\s+href="/wiki/([^"]+)"', 1)
    target = F.when(F.col("html").rlike('class="redirectMsg"'), F.coalesce(F.translate(F.coalesce(urls.percent_decode(said), said), "_", " "), F.lit(""))).when(
        F.col("wikitext").rlike(r"(?i)^\s*#redirect\b"), F.trim(F.regexp_extract("wikitext", r"(?i)^\s*#redirect\s*:?\s*\[\[([^\]|#]+)", 1))
    )
    return table(spark, d, "raw_pages").select("cache_id", target.alias("target"), F.concat(F.lit("https://"), "domain", F.lit("/wiki/"), F.translate("title", " ", "_")).alias("source"))


@query("""
with l as (select distinct domain, title from manifest where is_list_page), h as (select distinct r.domain, r.title, replace(unnest(regexp_extract_all(html, 'href="/wiki/([^"?#]+)', 1)), '_', ' ') as target from raw_pages r where html is not null),
n as (select domain, title, min(ns) as ns from manifest group by all)
select h.domain, h.title as list_title, h.target, n.ns is not null as listed from h join l on l.domain = h.domain and l.title = h.title left join n on n.domain = h.domain and n.title = h.target where coalesce(n.ns, 0) = 0""")
def list_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC4: what list pages link to in the main namespace."""
    m = table(spark, d, "manifest")
    lists = m.where("is_list_page").select("domain", "title").distinct()
    h = table(spark, d, "raw_pages").where("html is not null").select("domain", "title", F.explode(F.regexp_extract_all("html", F.lit('href="/wiki/([^"?#]+)'), F.lit(1))).alias("h"))
    h = h.select("domain", "title", F.translate("h", "_", " ").alias("target")).distinct().join(lists, ["domain", "title"], "left_semi")
    n = m.groupBy("domain", F.col("title").alias("target")).agg(F.min("ns").alias("ns"))
    return h.join(n, ["domain", "target"], "left").where("coalesce(ns, 0) = 0").select("domain", F.col("title").alias("list_title"), "target", F.col("ns").isNotNull().alias("listed"))


@query("""
select domain, title, bool_or(converted_at < timestamp '2024-07-01') as before, bool_or(converted_at >= timestamp '2024-07-01') as since from results where status = 'ok' and converted_at is not null group by all""")
def completed_pages(spark: SparkSession, d: str) -> DataFrame:
    """SET7: pages done before a run or by it, once each; the union is an aggregate of one scan."""
    cut_at = F.lit("2024-07-01").cast("timestamp_ntz")
    r = table(spark, d, "results").where("status = 'ok' and converted_at is not null")
    return r.groupBy("domain", "title").agg(F.bool_or(F.col("converted_at") < cut_at).alias("before"), F.bool_or(F.col("converted_at") >= cut_at).alias("since"))


@query("""
with m as (select distinct domain, title, target_filename as file from manifest where domain is not null and coalesce(nullif(lower(target_directory), ''), 'misc') = 'misc'),
n as (select *, row_number() over (partition by domain order by title, file) - 1 as rn from m)
select domain, cast(floor(rn / 200) as integer) as part, '# Misc' || chr(10) || chr(10) || string_agg('- [' || title || '](' || file || ')', chr(10) order by title, file) as body from n group by domain, floor(rn / 200)""")
def misc_index(spark: SparkSession, d: str) -> DataFrame:
    """ASM7: the index of a site's unsorted pages, 200 a part."""
    m = table(spark, d, "manifest").where("domain is not null").where(F.coalesce(F.expr("nullif(lower(target_directory), '')"), F.lit("misc")) == "misc").select("domain", F.struct("title", F.col("target_filename").alias("file")).alias("place")).distinct()
    n = numbered(m, ["domain"], "place")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("place")), lambda x: F.concat(F.lit("- ["), x["title"], F.lit("]("), x["file"], F.lit(")"))), "\n")
    return n.groupBy("domain", F.floor((F.col("rn") - 1) / 200).cast("int").alias("part")).agg(F.concat(F.lit("# Misc\n\n"), body).alias("body"))


@query(r"""
select result_id, md5(regexp_replace(content, '!\[([^\]]*)\]\((?:https?://[^)\s]*/|/images/)([^)/\s]+)\)', '![\1](../images/\2)', 'g')) as digest, len(regexp_extract_all(content, '!\[[^\]]*\]\([^)\s]+\)')) as n_images from results where content is not null""")
def local_images(spark: SparkSession, d: str) -> DataFrame:
    """Image references of each text rewritten to the files they are stored as."""
    new = F.regexp_replace("content", r"!\[([^\]]*)\]\((?:https?://[^)\s]*/|/images/)([^)/\s]+)\)", r"![$1](../images/$2)")
    return table(spark, d, "results").where("content is not null").select("result_id", F.md5(new.cast("binary")).alias("digest"), F.regexp_count("content", F.lit(r"!\[[^\]]*\]\([^)\s]+\)")).cast("bigint").alias("n_images"))


#: Line rules of the clusters that cleaning profiles choose from (fixed values): lines to drop, and rewrites within lines.
_CLUSTERS = {
    "navigation": ((r"^\[?(?:Tools|Privacy|About|Disclaimers|Terms|Navigation menu)\]?\s*$", r"^\[?(?:Privacy policy|Terms of Use|Cookie statement|Mobile view)\]?\s*$", r"^\[edit[^\]]*\]\s*$", r"Jump to (?:navigation|search)"), ((r"\[edit\](?:\[source\])?\s*", ""),)),
    "template": ((r"^\s*\[[^\[].*\]\s*$", r"^\s*\{.*\}\s*$", r'^\s*"[^"]+":\s*(?:"[^"]*"|[0-9]+|true|false|null)\s*,?\s*$', r"^\s*\(\)\s*$"), ((r"\(\)\s*", ""),)),
    "link": ((r"\[\[Category:", r"^Category:"), ((r"\[!\[([^\]]*)\]\(([^)]+)\)\]\([^)]+\)", r"![\1](\2)"), (r'(\]\([^)\s]+)\s+"[^"]+"\)', r"\1)"), (r"\[(?:File|Category|Template|Special):([^\]]+)\]", r"[\1]"))),
}
_PROFILES = {"full": ("navigation", "template", "link"), "links": ("navigation", "link"), "plain": ("template",)}


def _profile_sql(clusters: tuple[str, ...]) -> str:
    drop = " or ".join("regexp_matches(x, '{}')".format(p.replace("'", "''")) for c in clusters for p in _CLUSTERS[c][0])
    line = "x"
    for c in clusters:
        for p, to in _CLUSTERS[c][1]:
            line = "regexp_replace({}, '{}', '{}', 'g')".format(line, p.replace("'", "''"), to)
    squeezed = f"(case when starts_with({line}, '|') and len(string_split({line}, '|')) > 6 and len(list_filter(string_split({line}, '|'), lambda c: trim(c) <> '')) between 1 and 2 then '| ' || array_to_string(list_transform(list_filter(string_split({line}, '|'), lambda c: trim(c) <> ''), lambda c: trim(c)), ' | ') || ' |' else {line} end)"
    return f"array_to_string(list_transform(list_filter(string_split(t, chr(10)), lambda x: not ({drop})), lambda x: {squeezed}), chr(10))"


@query("with w as (select cache_id, wikitext as t from raw_pages where wikitext is not null)\n" + " union all ".join(f"select cache_id, '{n}' as profile, md5({_profile_sql(c)}) as digest, len({_profile_sql(c)}) as n_chars from w" for n, c in _PROFILES.items()))
def profile_filters(spark: SparkSession, d: str) -> DataFrame:
    """FN36: every page's wikitext under each cleaning profile: dropped lines, rewrites, and fact rows of many empty cells squeezed."""
    w = table(spark, d, "raw_pages").where("wikitext is not null").select("cache_id", F.split("wikitext", "\n").alias("lines"))

    def body(clusters: tuple[str, ...]) -> Column:
        def dropped(x: Column) -> Column:
            hit = F.lit(False)
            for c in clusters:
                for p in _CLUSTERS[c][0]:
                    hit = hit | x.rlike(p)
            return hit

        def changed(x: Column) -> Column:
            for c in clusters:
                for p, to in _CLUSTERS[c][1]:
                    x = F.regexp_replace(x, p, re.sub(r"\\(\d)", r"$\1", to))
            cells = F.filter(F.transform(F.split(x, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
            return F.when(x.startswith("|") & (F.size(F.split(x, r"\|")) > 6) & F.size(cells).between(1, 2), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(x)

        return F.array_join(F.transform(F.filter("lines", lambda x: ~dropped(x)), changed), "\n")

    rows = F.array(*(F.struct(F.lit(n).alias("profile"), body(c).alias("body")) for n, c in _PROFILES.items()))
    return w.select("cache_id", F.explode(rows).alias("p")).select("cache_id", "p.profile", F.md5(F.col("p.body").cast("binary")).alias("digest"), F.length("p.body").cast("bigint").alias("n_chars"))


@query("""
with b as (select p_type, p_brand, count(*) as n, string_agg('- ' || p_name || ' (' || p_size || ')', chr(10) order by p_name, p_partkey) as listed from part group by all), nav as (select p_type, string_agg('[' || p_brand || '](' || replace(p_brand, '#', '') || '.md)', ' | ' order by p_brand) as links from (select distinct p_type, p_brand from part) group by p_type)
select p_type as color, p_brand as rarity, '# ' || p_type || ' — ' || p_brand || chr(10) || chr(10) || n || ' cards' || chr(10) || chr(10) || listed || chr(10) || chr(10) || links as body from b join nav using (p_type)""")
def card_pages(spark: SparkSession, d: str) -> DataFrame:
    """ASM4, AGG13: one page a group of cards, with its cards in order and links to the group's siblings."""
    p = table(spark, d, "part")
    item = F.concat(F.lit("- "), "p_name", F.lit(" ("), F.col("p_size").cast("string"), F.lit(")"))
    b = p.groupBy("p_type", "p_brand").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey", item.alias("item")))), lambda x: x["item"]), "\n").alias("listed"))
    link = F.concat(F.lit("["), "p_brand", F.lit("]("), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".md)"))
    nav = p.select("p_type", "p_brand").distinct().groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_brand", link.alias("l")))), lambda x: x["l"]), " | ").alias("links"))
    body = F.concat(F.lit("# "), "p_type", F.lit(" — "), "p_brand", F.lit("\n\n"), F.col("n").cast("string"), F.lit(" cards\n\n"), "listed", F.lit("\n\n"), "links")
    return b.join(nav, "p_type").select(F.col("p_type").alias("color"), F.col("p_brand").alias("rarity"), body.alias("body"))


@query("""
select fetch_id, url, row_number() over (partition by url order by ts, fetch_id) as attempt, coalesce(error_type, case when http_status >= 400 then 'http_' || http_status end) as failure from (select distinct fetch_id, url, ts, error_type, http_status from fetch_log)""")
def fetch_order(spark: SparkSession, d: str) -> DataFrame:
    """SRC21: the attempts at each URL in order, with what went wrong; few URLs hold most attempts, so they are numbered in ranges."""
    log = table(spark, d, "fetch_log").select("fetch_id", "url", "ts", "error_type", "http_status").distinct()
    failure = F.coalesce("error_type", F.when(F.col("http_status") >= 400, F.concat(F.lit("http_"), F.col("http_status").cast("string"))))
    n = numbered(log.select("fetch_id", "url", F.struct("ts", "fetch_id").alias("place"), failure.alias("failure")), ["url"], "place", name="attempt")
    return n.select("fetch_id", "url", "attempt", "failure")
