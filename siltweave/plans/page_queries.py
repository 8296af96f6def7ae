"""Queries over manifests, stored pages, results and fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltweave.functions import text, urls
from siltweave.io import table
from siltweave.operators import assign
from siltweave.plans.registry import query
from siltweave.plans.url_queries import first_n
from siltweave.session import cut, small_side

EXCLUDED_CATEGORIES = ("Misc B", "News A", "Bosses")
EXCLUDED_DIRECTORIES = ("stages",)


def _log(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The fetch log without the rows that were delivered again, which have the same fetch_id; only the columns needed move."""
    return table(spark, d, "fetch_log").select("fetch_id", *columns).distinct()


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@query("""
select page_seq, title from manifest where not coalesce(list_has_any(source_categories, ['Misc B', 'News A', 'Bosses']), false)
and not coalesce(list_has_any(categories, ['Misc B', 'News A', 'Bosses']), false) and not coalesce(assigned_category in ('stages'), false) and not coalesce(title in ('Misc B', 'News A', 'Bosses'), false)""")
def exclude_filter(spark: SparkSession, d: str) -> DataFrame:
    """FLT1, FLT2, FLT3, SET2, SET3: pages none of whose categories is excluded."""
    gone = F.array_union(F.array(*map(F.lit, EXCLUDED_CATEGORIES[:2])), F.array(*map(F.lit, EXCLUDED_CATEGORIES[1:])))
    hit = lambda c: F.coalesce(F.arrays_overlap(c, gone), F.lit(False))
    titled = F.coalesce(F.col("title").isin(*EXCLUDED_CATEGORIES), F.lit(False))
    return table(spark, d, "manifest").where(~titled & ~hit(F.col("source_categories")) & ~hit(F.col("categories")) & ~F.coalesce(F.col("assigned_category").isin(*EXCLUDED_DIRECTORIES), F.lit(False))).select("page_seq", "title")


@query("""
with x(category) as (values ('Misc B'), ('News A'), ('Bosses'), ('Nothing')),
c as (select unnest(source_categories) as category from manifest union all select assigned_category from manifest)
select x.category, count(c.category) as n from x left join c on c.category = x.category group by x.category""")
def excluded_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG3: how many pages each excluded category has, as source or assigned category; 0 if none."""
    m = table(spark, d, "manifest")
    named = m.select(F.explode("source_categories").alias("category")).unionByName(m.select(F.col("assigned_category").alias("category")))
    wanted = _values(spark, [(c,) for c in (*EXCLUDED_CATEGORIES, "Nothing")], "category string")
    counts = named.join(F.broadcast(wanted), "category", "left_semi").groupBy("category").agg(F.count("*").alias("n"))
    return wanted.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""
with m as (select *, lower(coalesce(nullif(target_directory, ''), 'misc')) as dir from manifest)
select domain, count(*) as n, list_aggregate((list(title order by page_seq))[1:5], 'string_agg', ' | ') as sample from m where dir = 'misc' and not coalesce(assigned_category in ('stages'), false) group by domain""")
def unclassified(spark: SparkSession, d: str) -> DataFrame:
    """AGG4: pages without a directory, by domain, with the first five titles."""
    m = table(spark, d, "manifest").where((F.lower(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc"))) == "misc") & ~F.coalesce(F.col("assigned_category").isin(*EXCLUDED_DIRECTORIES), F.lit(False)))
    counts = m.groupBy("domain").agg(F.count("*").alias("n"))
    few = first_n(first_n(m.withColumn("salt", F.pmod("page_seq", F.lit(32))), ["domain", "salt"], "page_seq", 5), ["domain"], "page_seq", 5)
    sample = few.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "title"))), lambda x: x["title"]), " | ").alias("sample"))
    return counts.join(sample, "domain")


@query("""
with q(dir, cat, n) as (select directory, cats, n from (select coalesce(nullif(target_directory, ''), 'misc') as directory, unnest(categories) as cats from manifest) t, lateral (select 1 as n))
select dir as directory, cat as category, count(*) as n_pages from q group by all""")
def directory_categories(spark: SparkSession, d: str) -> DataFrame:
    """AGG24: pages of each category in each directory."""
    m = table(spark, d, "manifest").select(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc")).alias("directory"), F.explode("categories").alias("category"))
    return m.groupBy("directory", "category").agg(F.count("*").alias("n_pages"))


@query("""
select m.page_seq, m.title from manifest m where not ends_with(m.title, '/tr') and not ends_with(m.title, '_tr')
and not exists (select 1 from results r where r.domain = m.domain and r.title = m.title and r.status = 'error')""")
def existing_pages(spark: SparkSession, d: str) -> DataFrame:
    """FLT4, FLT5: pages that are no translations and were not reported missing."""
    m = table(spark, d, "manifest").where(~F.col("title").endswith("/tr") & ~F.col("title").endswith("_tr"))
    missing = table(spark, d, "results").where("status = 'error'").select("domain", "title").distinct()
    return m.join(missing, ["domain", "title"], "left_anti").select("page_seq", "title")


@query("""
select m.page_seq, m.domain, m.title from manifest m where not exists (select 1 from raw_pages r where r.domain = m.domain and r.title = m.title)""")
def cache_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """J9, J24, SET4, SRC12, STM2: pages that still have to be fetched."""
    cached = table(spark, d, "raw_pages").select("domain", "title").distinct()
    return table(spark, d, "manifest").join(cached, ["domain", "title"], "left_anti").select("page_seq", "domain", "title")


@query("""
with c as (select distinct domain, title from raw_pages) select m.domain, count(*) as n_pages, count(c.title) as n_cached, count(c.title) = count(*) as complete
from manifest m left join c on c.domain = m.domain and c.title = m.title group by m.domain""")
def cache_coverage(spark: SparkSession, d: str) -> DataFrame:
    """SET5: whether a domain's manifest is cached as a whole."""
    cached = table(spark, d, "raw_pages").select("domain", "title").distinct().withColumn("hit", F.lit(1))
    j = table(spark, d, "manifest").join(cached, ["domain", "title"], "left").groupBy("domain")
    return j.agg(F.count("*").alias("n_pages"), F.count("hit").alias("n_cached"), (F.count("hit") == F.count("*")).alias("complete"))


@query("""
with done as (select distinct domain, title from results where status = 'ok' and length(content) > 0), cached as (select distinct domain, title from raw_pages)
select c.domain, c.title from cached c where not exists (select 1 from done x where x.domain = c.domain and x.title = c.title)""")
def resume_pages(spark: SparkSession, d: str) -> DataFrame:
    """J10, SET6, SET7, STM1: cached pages without a finished result."""
    done = table(spark, d, "results").where("status = 'ok' and length(content) > 0").select("domain", "title").distinct()
    return table(spark, d, "raw_pages").select("domain", "title").distinct().join(done, ["domain", "title"], "left_anti")


@query("""
with k as (select *, row_number() over (partition by domain, title order by fetched_at desc nulls last, cache_id desc) as rn from raw_pages)
select cache_id, domain, title, fetched_at from k where rn = 1""")
def latest_pages(spark: SparkSession, d: str) -> DataFrame:
    """SNK1: the newest stored version of each page; page bodies take no part in the shuffle."""
    r = table(spark, d, "raw_pages")
    best = r.groupBy("domain", "title").agg(F.max(F.struct(F.col("fetched_at"), F.col("cache_id"))).alias("m"))
    return best.select("m.cache_id", "domain", "title", "m.fetched_at")


@query("""
with r as (select domain, title, max_by(content, {'a': converted_at, 'b': result_id}) as content from results where status = 'ok' group by all)
select m.page_seq, m.target_directory, m.target_filename, length(r.content) as n_chars from manifest m left join r on r.domain = m.domain and r.title = m.title""")
def page_results(spark: SparkSession, d: str) -> DataFrame:
    """Each manifest page with the size of its latest good result; only sizes are shuffled."""
    r = table(spark, d, "results").where("status = 'ok'").select("domain", "title", F.length("content").cast("bigint").alias("n"), "converted_at", "result_id", F.col("content").isNull().alias("none"))
    best = r.where("not none").groupBy("domain", "title").agg(F.max_by("n", F.struct("converted_at", "result_id")).alias("n_chars"))
    return table(spark, d, "manifest").join(best, ["domain", "title"], "left").select("page_seq", "target_directory", "target_filename", "n_chars")


@query("""
with t as (select page_seq, domain, coalesce(target_directory, '') || '/' || target_filename as path from manifest)
select page_seq, path, case when row_number() over (partition by domain, path order by page_seq) = 1 then 'ok' else 'target_conflict' end as status from t""")
def target_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """AGG11, W1: the first page of a path keeps it, others conflict."""
    t = table(spark, d, "manifest").select("page_seq", "domain", F.concat(F.coalesce("target_directory", F.lit("")), F.lit("/"), F.col("target_filename")).alias("path"))
    first = t.groupBy(F.col("domain").alias("of"), F.col("path").alias("at")).agg(F.min("page_seq").alias("first"))
    return t.join(first, F.col("domain").eqNullSafe(F.col("of")) & (F.col("path") == F.col("at"))).select("page_seq", "path", F.when(F.col("page_seq") == F.col("first"), "ok").otherwise("target_conflict").alias("status"))


_PRIORITY = [("Items", "Items", 1, "items"), ("Items", "Items A", 1, "items"), ("Bosses", "Bosses", 2, "bosses"), ("Bosses", "Bosses B", 2, "bosses"), ("Lore", "Lore", 3, "lore"), ("Guides", "Guides", 4, None), ("Stages", "Stages", 5, "stages")]
_TAXONOMY = [("News B", "Lore"), ("Misc (all)", "Items"), ("Lore (all)", "Lore")]


@query("""
with pr(name, alias, rank, directory) as (values ('Items','Items',1,'items'),('Items','Items A',1,'items'),('Bosses','Bosses',2,'bosses'),('Bosses','Bosses B',2,'bosses'),('Lore','Lore',3,'lore'),('Guides','Guides',4,null),('Stages','Stages',5,'stages')),
tx(tag, top) as (values ('News B','Lore'),('Misc (all)','Items'),('Lore (all)','Lore')),
mn as (select title, min(assigned_category) as directory from manifest where assignment_method = 'manual' and assigned_category is not null group by title),
nm as (select * from pr where name = alias),
s as (select distinct page_seq, unnest(source_categories) as name from manifest),
bs as (select page_seq, count(*) as n, arg_min(coalesce(directory, ''), rank) as dir from s join nm using (name) group by 1),
t as (select page_seq, unnest(categories) as tag, generate_subscripts(categories, 1) as pos from manifest),
bt as (select page_seq, arg_min(directory, rank) as dir from t join pr on t.tag = pr.alias where directory is not null group by 1),
bx as (select page_seq, arg_min(nm.directory, pos) as dir from t join tx using (tag) join nm on nm.name = tx.top where nm.directory is not null group by 1)
select m.page_seq as page, coalesce(mn.directory, case when bs.n = 1 then nullif(bs.dir, '') end, bt.dir, bx.dir, nullif(bs.dir, ''), 'misc') as directory,
  case when mn.directory is not null then 'manual' when bs.n = 1 and bs.dir <> '' then 'source_category_match' when bt.dir is not null or bx.dir is not null then 'mw_category_match' when bs.dir <> '' then 'source_category_fallback' else 'default' end as method
from manifest m left join mn on mn.title = m.title left join bs using (page_seq) left join bt using (page_seq) left join bx using (page_seq)""")
def assignment_chain(spark: SparkSession, d: str) -> DataFrame:
    """AGG9, J14: the directory of each page by the chain of rules."""
    m = table(spark, d, "manifest")
    pages = m.select(F.col("page_seq").alias("page"), "title", "source_categories", "categories")
    manual = m.where("assignment_method = 'manual' and assigned_category is not null").select("title", F.col("assigned_category").alias("directory"))
    return assign.assignment_chain(pages, _values(spark, _PRIORITY, "name string, alias string, rank int, directory string"), manual, _values(spark, _TAXONOMY, "tag string, top string"))


_MAPPED = [("Guides A", "guides"), ("Lore (all)", "lore")]


@query("""
with k(key, directory, ord) as (values ('items', 'items', 0), ('boss', 'bosses', 1), ('lore', 'lore', 2), ('guides_a', 'guides', 3)), mp(category, directory) as (values ('Guides A', 'guides'), ('Lore (all)', 'lore')),
m as (select page_seq, categories, case when coalesce(is_list_page, false) then nullif(target_directory, '') end as own from manifest),
t as (select distinct page_seq, unnest(categories) as category from m), u as (select page_seq, unnest(categories) as category, generate_subscripts(categories, 1) as pos from m),
mapped as (select page_seq, arg_min(mp.directory, pos) as directory from u join mp using (category) group by 1),
s as (select page_seq, directory, ord, case when lower(translate(category, ' ', '_')) = key then 2 when contains(lower(translate(category, ' ', '_')), key) or contains(key, lower(translate(category, ' ', '_'))) then 1 else 0 end as p from t cross join k),
g as (select page_seq, directory, min(ord) as ord, sum(p) as score from s where p > 0 group by all),
b as (select page_seq, arg_max(directory, {'s': score, 'o': -ord}) as directory, max(score) as score from g group by 1)
select m.page_seq as page, coalesce(m.own, mapped.directory, b.directory, 'misc') as directory, cast(coalesce(score, 0) as bigint) as score, case when m.own is not null then 'list_page' when mapped.directory is not null then 'mapped' when b.directory is not null then 'scored' else 'default' end as method
from m left join mapped using (page_seq) left join b using (page_seq)""")
def category_scoring(spark: SparkSession, d: str) -> DataFrame:
    """AGG10: a list page's own directory, else that of the first mapped category, else the best scoring directory of the page's categories."""
    m = table(spark, d, "manifest").select(F.col("page_seq").alias("page"), "categories", F.when(F.coalesce("is_list_page", F.lit(False)), F.expr("nullif(target_directory, '')")).alias("own"))
    tags = m.select("page", F.explode("categories").alias("category")).distinct()
    scored = assign.category_scores(tags, _values(spark, [("items", "items", 0), ("boss", "bosses", 1), ("lore", "lore", 2), ("guides_a", "guides", 3)], "key string, directory string, ord int"))
    mapping = F.broadcast(_values(spark, _MAPPED, "category string, directory string"))  # configuration
    mapped = m.select("page", F.posexplode("categories").alias("at", "category")).join(mapping, "category").groupBy("page").agg(F.min_by("directory", "at").alias("mapped"))
    out = m.join(mapped, "page", "left").join(scored.withColumnRenamed("directory", "scored"), "page", "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    found = F.when(F.col("score") > 0, F.col("scored"))
    method = F.when(F.col("own").isNotNull(), "list_page").when(F.col("mapped").isNotNull(), "mapped").when(found.isNotNull(), "scored").otherwise("default")
    return out.select("page", F.coalesce("own", "mapped", found, F.lit("misc")).alias("directory"), "score", method.alias("method"))


@query("""
with c as (select domain, title, page_seq, unnest(source_categories) as category, generate_subscripts(source_categories, 1) as pos from manifest)
select domain, title, list_aggregate(list(category order by page_seq, pos), 'string_agg', ' | ') as categories from (select domain, title, category, min(page_seq) as page_seq, min(pos) as pos from c group by all) group by domain, title""")
def source_categories(spark: SparkSession, d: str) -> DataFrame:
    """AGG7: the distinct source categories of each title in order of first sight."""
    c = table(spark, d, "manifest").select("domain", "title", "page_seq", F.posexplode("source_categories").alias("at", "category"))
    once = c.groupBy("domain", "title", "category").agg(F.min("page_seq").alias("page_seq"), F.min("at").alias("at"))
    return once.groupBy("domain", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_seq", "at", "category"))), lambda x: x["category"]), " | ").alias("categories"))


@query("""
with c as (select distinct domain, target_directory, unnest(categories) as category, title, target_filename, coalesce(ns, 0) as ns from manifest)
select domain, category, ns, count(*) as n_members, min(title) as first_title, max(title) as last_title from c group by all""")
def category_members(spark: SparkSession, d: str) -> DataFrame:
    """SRC2, SRC5: members of each category of a domain by namespace."""
    c = table(spark, d, "manifest").select("domain", "target_directory", F.explode("categories").alias("category"), "title", "target_filename", F.coalesce("ns", F.lit(0)).alias("ns")).distinct()
    return c.groupBy("domain", "category", "ns").agg(F.count("*").alias("n_members"), F.min("title").alias("first_title"), F.max("title").alias("last_title"))


@query("""
select domain, coalesce(nullif(lower(target_directory), ''), 'misc') as directory, count(*) as n, round(100.0 * count(*) filter (where assigned_category is null) / count(*), 2) as unassigned_pct from manifest group by rollup(domain, coalesce(nullif(lower(target_directory), ''), 'misc'))""")
def directory_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG13, AGG14, ASM8: pages of each directory and domain and in all, in one pass."""
    m = table(spark, d, "manifest").select("domain", F.coalesce(F.expr("nullif(lower(target_directory), '')"), F.lit("misc")).alias("directory"), "assigned_category")
    return m.rollup("domain", "directory").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.col("assigned_category").isNull()) / F.count("*"), 2).alias("unassigned_pct"))


@query("select p_brand, p_type, count(*) as n, min(p_name) as first_name from part group by rollup(p_brand, p_type)")
def card_rollup(spark: SparkSession, d: str) -> DataFrame:
    """AGG13: two-level grouping with totals in one pass."""
    return table(spark, d, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.min("p_name").alias("first_name"))


@query("""
select page_seq, domain, directory from (select page_seq, domain, coalesce(nullif(lower(target_directory), ''), 'misc') as directory,
  row_number() over (partition by domain, coalesce(nullif(lower(target_directory), ''), 'misc') order by (case when is_list_page then 100 else 0 end) + length(title) desc, page_seq) as rn from manifest) where rn <= 3""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """AGG23, KI6: the three best scored pages of each directory (a sampling operator)."""
    m = table(spark, d, "manifest").select("page_seq", "domain", F.coalesce(F.expr("nullif(lower(target_directory), '')"), F.lit("misc")).alias("directory"), (F.when(F.col("is_list_page"), 100).otherwise(0) + F.length("title")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("domain", "directory").orderBy(F.desc("score"), "page_seq"))
    return m.withColumn("rn", rank).where("rn <= 3").select("page_seq", "domain", "directory")


@query("select page_seq, title from manifest order by page_seq limit 25")
def page_budget(spark: SparkSession, d: str) -> DataFrame:
    """SRT1: the first pages of a manifest within a page budget (a limit by design)."""
    return table(spark, d, "manifest").select("page_seq", "title").orderBy("page_seq").limit(25)


@query("""
select result_id, redirect_target, case when status = 'redirect' then coalesce(redirect_target, '') end as target from results where status = 'redirect'""")
def redirects(spark: SparkSession, d: str) -> DataFrame:
    """AGG12, FLT23, D16: the redirect map."""
    return table(spark, d, "results").where("status = 'redirect'").select("result_id", "redirect_target", F.coalesce("redirect_target", F.lit("")).alias("target"))


_MD_LINKS = """md as (select result_id, domain, unnest(regexp_extract_all(content, '(?:^|[^!])\\[[^\\[\\]]*\\]\\(([^()\\s]+)\\)', 1)) as href from results where content is not null)"""


def _md_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("content", F.lit(r"(?:^|[^!])\[[^\[\]]*\]\(([^()\s]+)\)"), F.lit(1))
    return table(spark, d, "results").where("content is not null").select("result_id", "domain", F.explode(found).alias("href"))


@query(f"""
with {_MD_LINKS}, t as (select *, regexp_extract(href, '([^/]+)\\.md$', 1) as file from md), n as (select result_id, domain, href, replace(file, '_', ' ') as title from t where file <> ''),
red as (select domain, title, min(redirect_target) as target from results where status = 'redirect' and redirect_target is not null group by all),
idx as (select domain, title, min(coalesce(nullif(target_directory, ''), 'misc') || '/' || target_filename) as path from manifest group by all)
select n.result_id, n.href, n.domain, idx.path, case when idx.path is null then 'https://' || n.domain || '/wiki/' || replace(n.title, ' ', '_') else idx.path end as resolved, count(*) as n
from n left join red on red.domain = n.domain and red.title = n.title left join idx on idx.domain = n.domain and idx.title = coalesce(red.target, n.title) group by all""")
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J2, J3, J6, ITR6: links of converted texts to manifest paths, one redirect hop first, else to the site.

    Distinct links are resolved, not occurrences, so a page linked from everywhere is no hot key.
    """
    n = _md_links(spark, d).withColumn("file", F.regexp_extract("href", r"([^/]+)\.md$", 1)).where("file <> ''").withColumn("title", F.translate("file", "_", " "))
    counted = n.groupBy("result_id", "href", "domain", "title").agg(F.count("*").alias("n"))
    wanted = counted.select("domain", "title").distinct()
    red = table(spark, d, "results").where("status = 'redirect' and redirect_target is not null").groupBy("domain", "title").agg(F.min("redirect_target").alias("target"))
    idx = table(spark, d, "manifest").groupBy("domain", F.col("title").alias("final")).agg(F.min(F.concat(F.coalesce(F.expr("nullif(target_directory, '')"), F.lit("misc")), F.lit("/"), F.col("target_filename"))).alias("path"))
    resolved = wanted.join(red, ["domain", "title"], "left").withColumn("final", F.coalesce("target", "title")).join(idx, ["domain", "final"], "left").select("domain", "title", "path")
    out = counted.join(resolved, ["domain", "title"])
    return out.select("result_id", "href", "domain", "path", F.coalesce("path", F.concat(F.lit("https://"), "domain", F.lit("/wiki/"), F.translate("title", " ", "_"))).alias("resolved"), "n")


@query("""
with i as (select domain, unnest(images) as image from raw_pages), s as (select * from i where not regexp_matches(image, '(?i)(icon|logo|sprite)')),
used as (select domain, image, count(*) as n from s group by all) select domain, image, n from used where not exists (select 1 from raw_pages r where r.domain = used.domain and contains(coalesce(r.html, r.wikitext, ''), used.image))""")
def missing_images(spark: SparkSession, d: str) -> DataFrame:
    """J8, AGG15, FLT12: images that pages list and no stored body of the site names.

    Bodies are reduced to the distinct file names they hold, so the comparison is an equality anti-join.
    """
    r = table(spark, d, "raw_pages")
    used = r.select("domain", F.explode("images").alias("image")).where(~F.col("image").rlike("(?i)(icon|logo|sprite)")).groupBy("domain", "image").agg(F.count("*").alias("n"))
    body = F.coalesce("html", "wikitext", F.lit(""))
    named = r.select("domain", F.explode(F.regexp_extract_all(body, F.lit(r"([\p{L}\p{N}_-]+\.[A-Za-z]{3,4})"), F.lit(1))).alias("image")).distinct()
    return used.join(named, ["domain", "image"], "left_anti")


@query("""
select domain, count(*) as n, count(*) filter (where status = 'ok') as ok, count(*) filter (where status = 'empty') as empty, count(*) filter (where status = 'error') as error,
  count(*) filter (where status = 'redirect') as redirect, count(*) filter (where status = 'error') > 0.5 * count(*) as failed,
  case when count(*) filter (where status = 'error') = 0 then 'success' when count(*) filter (where status = 'ok') > 0 then 'partial_success' else 'failure' end as outcome from results group by domain""")
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    """AGG1, FLT25, FLT27, D9: counters of each site's conversion in a single pass, and its outcome."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    a = table(spark, d, "results").groupBy("domain").agg(F.count("*").alias("n"), is_("ok").alias("ok"), is_("empty").alias("empty"), is_("error").alias("error"), is_("redirect").alias("redirect"))
    return a.withColumn("failed", F.col("error") > 0.5 * F.col("n")).withColumn("outcome", F.when(F.col("error") == 0, "success").when(F.col("ok") > 0, "partial_success").otherwise("failure"))


@query("""
with l as (select distinct * from fetch_log), k as (select engine, row_number() over (order by count(*) filter (where status = 'success') desc, engine) as rank from l group by engine)
select url, count(*) as attempts, arg_min(l.engine, {'t': ts, 'f': fetch_id}) filter (where status = 'success') as engine, min(ts) filter (where status = 'success') as answered, arg_min(l.engine, k.rank) filter (where status = 'success') as preferred from l join k on k.engine = l.engine group by url""")
def probe_chain(spark: SparkSession, d: str) -> DataFrame:
    """SRC16: of each page the engine that answered first, and of those that answered the one of best rank (engines by successes).

    Few pages hold most rows; both aggregates have partial sums, so they are no hot keys.
    """
    good = F.when(F.col("status") == "success", F.struct("ts", "fetch_id"))
    log = _log(spark, d, "url", "status", "ts", "engine")
    counts = log.groupBy("engine").agg(F.count_if(F.col("status") == "success").alias("n"))
    ranked = small_side(cut(counts.select("engine", F.row_number().over(Window.orderBy(F.desc("n"), "engine")).alias("rank"))))  # one row an engine
    rank = F.when(F.col("status") == "success", F.col("rank"))
    return log.join(ranked, "engine").groupBy("url").agg(F.count("*").alias("attempts"), F.min_by("engine", good).alias("engine"), F.min(F.when(F.col("status") == "success", F.col("ts"))).alias("answered"), F.min_by("engine", rank).alias("preferred"))


@query("""
with l as (select distinct * from fetch_log), c as (select engine, case when http_status = 403 then 'forbidden' when http_status = 429 then 'rate_limited' when http_status = 401 then 'unauthorized' when error_type = 'timeout' then 'timeout'
  when http_status >= 500 then 'server' when error_type is not null then error_type when status = 'success' then 'none' else 'unknown' end as kind, elapsed_ms from l)
select engine, kind, count(*) as n, cast(sum(case when elapsed_ms >= 0 then elapsed_ms end) as bigint) as elapsed_ms from c group by all""")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    """FLT20, D14: fetches of each engine by class of error; negative times count as unknown."""
    kind = (
        F.when(F.col("http_status") == 403, "forbidden").when(F.col("http_status") == 429, "rate_limited").when(F.col("http_status") == 401, "unauthorized").when(F.col("error_type") == "timeout", "timeout")
        .when(F.col("http_status") >= 500, "server").when(F.col("error_type").isNotNull(), F.col("error_type")).when(F.col("status") == "success", "none").otherwise("unknown")
    )
    return _log(spark, d, "engine", "http_status", "error_type", "status", "elapsed_ms").groupBy("engine", kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))).alias("elapsed_ms"))


@query("""
with l as (select distinct * from fetch_log), e as (select engine, count(distinct domain) filter (where status = 'success') / cast((select count(distinct domain) from l) as double) as a, count(*) filter (where status = 'success') / cast(count(*) as double) as s,
  avg(case when elapsed_ms >= 0 then elapsed_ms end) as t from l group by engine), x as (select *, 1 - t / max(t) over () as f from e)
select engine, cast(round((0.5 * a + 0.3 * s + 0.2 * f) * 100) as bigint) as score, row_number() over (order by round((0.5 * a + 0.3 * s + 0.2 * f) * 100) desc, engine) as rank from x""")
def engine_scores(spark: SparkSession, d: str) -> DataFrame:
    """FN33, D23: engines scored by reach, stability and speed taken from the log."""
    log = _log(spark, d, "engine", "domain", "status", "elapsed_ms")
    good = F.col("status") == "success"
    e = log.groupBy("engine").agg(F.count_distinct(F.when(good, F.col("domain"))).alias("reach"), (F.count_if(good) / F.count("*").cast("double")).alias("s"), F.avg(F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))).alias("t"))
    all_ = log.agg(F.count_distinct("domain").alias("n_domains"))
    slowest = e.agg(F.max("t").alias("tmax"))
    x = e.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(slowest))  # one row each
    score = F.round((0.5 * F.col("reach") / F.col("n_domains") + 0.3 * F.col("s") + 0.2 * (1 - F.col("t") / F.col("tmax"))) * 100).cast("bigint")
    return x.select("engine", score.alias("score")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "engine")).cast("bigint"))


@query("""
with l as (select distinct url, ts, fetch_id, status from fetch_log), g as (select *, case when status = 'success' then 1 else 0 end as good from l),
w as (select *, coalesce(sum(good) over (partition by url order by ts, fetch_id rows between unbounded preceding and 1 preceding), 0) as run from g),
f as (select url, run, count(*) filter (where good = 0) as failures from w group by all)
select url, max(failures) as longest, cast(max(least(power(2.5, failures) * 800, 60000)) as double) as delay_ms, max(failures) >= 5 as stops from f group by url""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """W2, W8, W9, STM4: longest run of failures of each page, the delay that exponential back-off had reached, and whether five in a row stop it.

    Few pages hold most rows, so no task may hold all attempts of a page: attempts are folded minute by
    minute into leading, trailing and longest runs, then hour by hour, then page by page.
    """
    log = table(spark, d, "fetch_log").select("url", "ts", "fetch_id", (F.col("status") == "success").alias("ok")).distinct()
    minutes = log.groupBy("url", F.date_trunc("minute", "ts").alias("at")).agg(F.array_sort(F.collect_list(F.struct("ts", "fetch_id", "ok"))).alias("rows"))
    empty = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("run"), F.lit(0).alias("most"), F.lit(True).alias("all"))

    def join(a, f):
        """Two stretches after one another; ``all``: nothing but failures, then lead, run and most are their number."""
        run = F.when(f["all"], a["run"] + f["run"]).otherwise(f["run"])
        lead = F.when(a["all"], a["lead"] + f["lead"]).otherwise(a["lead"])
        return F.struct(lead.alias("lead"), run.alias("run"), F.greatest(a["most"], a["run"] + f["lead"], f["most"]).alias("most"), (a["all"] & f["all"]).alias("all"))

    def one(x):
        bad = (~x["ok"]).cast("int")
        return F.struct(bad.alias("lead"), bad.alias("run"), bad.alias("most"), (~x["ok"]).alias("all"))

    folded = minutes.select("url", "at", F.aggregate("rows", empty, lambda a, x: join(a, one(x))).alias("f"))
    for to in (F.date_trunc("hour", "at"), F.lit(None).cast("timestamp")):
        folded = folded.groupBy("url", to.alias("to")).agg(F.array_sort(F.collect_list(F.struct("at", "f"))).alias("parts")).select("url", F.col("to").alias("at"), F.aggregate("parts", empty, lambda a, x: join(a, x["f"])).alias("f"))
    runs = folded.select("url", F.col("f.most").cast("bigint").alias("longest"))
    return runs.withColumn("delay_ms", F.least(F.pow(F.lit(2.5), F.col("longest")) * 800, F.lit(60000.0))).withColumn("stops", F.col("longest") >= 5)


@query("""
with l as (select distinct * from fetch_log), t as (select domain, ts, case when http_status = 429 or error_type = 'rate_limited' then 1 else 0 end as hit from l),
h as (select domain, ts from t where hit = 1), g as (select domain, ts, case when lag(ts) over (partition by domain order by ts) is null or ts - lag(ts) over (partition by domain order by ts) >= interval 3 hour then 1 else 0 end as fresh from h),
s as (select domain, ts, sum(fresh) over (partition by domain order by ts rows unbounded preceding) as k from g)
select domain, min(ts) as began, max(ts) as last, count(*) as n from s group by domain, k""")
def cooldown_sessions(spark: SparkSession, d: str) -> DataFrame:
    """STM5: rate-limit events of a site less than three hours apart, as sessions.

    Events of a minute are summed first, with their first and last time, which tells all gaps exactly;
    what is ordered within a site is then at most one row a minute.
    """
    hits = _log(spark, d, "domain", "ts", "http_status", "error_type").where("http_status = 429 or error_type = 'rate_limited'")
    minutes = hits.groupBy("domain", F.date_trunc("minute", "ts").alias("minute")).agg(F.min("ts").alias("first"), F.max("ts").alias("final"), F.count("*").alias("k"))
    w = Window.partitionBy("domain").orderBy("minute")
    fresh = F.coalesce(F.col("first") - F.lag("final").over(w) >= F.expr("interval 3 hours"), F.lit(True)).cast("int")
    return minutes.withColumn("fresh", fresh).withColumn("session", F.sum("fresh").over(w)).groupBy("domain", "session").agg(F.min("first").alias("began"), F.max("final").alias("last"), F.sum("k").alias("n")).drop("session")


@query("""
with r as (select cache_id, platform, domain, coalesce(content_acquisition, '') as how, html is not null as h, wikitext is not null as w, rendered_html is not null as x from raw_pages)
select how, case when x then 'rendered_html' when w then 'wikitext' when h then 'html' else 'empty' end as route, platform, count(*) as n from r group by all""")
def conversion_routes(spark: SparkSession, d: str) -> DataFrame:
    """FLT24, SRC14: which body of a stored page is converted."""
    route = F.when(F.col("rendered_html").isNotNull(), "rendered_html").when(F.col("wikitext").isNotNull(), "wikitext").when(F.col("html").isNotNull(), "html").otherwise("empty")
    return table(spark, d, "raw_pages").groupBy(F.coalesce("content_acquisition", F.lit("")).alias("how"), route.alias("route"), "platform").agg(F.count("*").alias("n"))


@query("""
with t as (select cache_id, coalesce(html, rendered_html) as h from raw_pages), c as (select cache_id, h, len(regexp_extract_all(h, '(?i)<p[ >]')) as p, len(regexp_extract_all(h, '(?i)<li[ >]')) as li, len(regexp_extract_all(h, '(?i)<tr[ >]')) as tr, len(regexp_extract_all(h, '(?i)<img[ >]')) as img, len(regexp_extract_all(h, '(?i)<table[ >]')) as tb from t where h is not null)
select cache_id, case when regexp_matches(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1), '(?i)main page|home') then 'home' when (tr > 5 or li > 20) and not (p > 10 and tr < 10) then 'list' when img > 10 then 'gallery' when p > 3 then 'article' else 'home' end as kind,
  tb > 2 as many_tables, regexp_matches(h, 'class="[^"]*infobox') as infobox, len(regexp_extract_all(h, '(?i)<(?:ul|ol)[ >]')) > 5 as many_lists, regexp_matches(h, 'class="[^"]*card') as cards, cast(p as bigint) as p, cast(li as bigint) as li from c""")
def page_structure_class(spark: SparkSession, d: str) -> DataFrame:
    """FLT17, FLT18: page type and structure flags from tag counts, all in the JVM."""
    n = lambda tag: F.regexp_count("h", F.lit(rf"(?i)<{tag}[ >]"))
    c = table(spark, d, "raw_pages").select("cache_id", F.coalesce("html", "rendered_html").alias("h")).where("h is not null").select("cache_id", "h", n("p").alias("p"), n("li").alias("li"), n("tr").alias("tr"), n("img").alias("img"), n("table").alias("tb"))
    home = F.regexp_extract("h", "(?is)<title[^>]*>(.*?)</title>", 1).rlike("(?i)main page|home")
    kind = F.when(home, "home").when(((F.col("tr") > 5) | (F.col("li") > 20)) & ~((F.col("p") > 10) & (F.col("tr") < 10)), "list").when(F.col("img") > 10, "gallery").when(F.col("p") > 3, "article").otherwise("home")
    return c.select("cache_id", kind.alias("kind"), (F.col("tb") > 2).alias("many_tables"), F.col("h").rlike('class="[^"]*infobox').alias("infobox"), (F.regexp_count("h", F.lit("(?i)<(?:ul|ol)[ >]")) > 5).alias("many_lists"), F.col("h").rlike('class="[^"]*card').alias("cards"), F.col("p").cast("bigint").alias("p"), F.col("li").cast("bigint").alias("li"))


@query("""
select cache_id, case when regexp_matches(rendered_html, '(?i)<meta name="generator" content="mediawiki') and regexp_matches(rendered_html, 'class="[^"]*mw-') and contains(coalesce(url, ''), '/wiki/') then 'mediawiki' when regexp_matches(rendered_html, '(?i)<meta name="generator"') then 'other' else 'unknown' end as backend,
  regexp_extract(rendered_html, '(?i)<meta name="generator" content="MediaWiki ([0-9.]+)', 1) as version from raw_pages where rendered_html is not null""")
def backend_detection(spark: SparkSession, d: str) -> DataFrame:
    """FLT16, FLT31: the software behind a page: the first whose every sign (generator mark, class, URL) is there."""
    h = F.col("rendered_html")
    signs = h.rlike('(?i)<meta name="generator" content="mediawiki') & h.rlike('class="[^"]*mw-') & F.contains(F.coalesce("url", F.lit("")), F.lit("/wiki/"))
    backend = F.when(signs, "mediawiki").when(h.rlike('(?i)<meta name="generator"'), "other").otherwise("unknown")
    return table(spark, d, "raw_pages").where("rendered_html is not null").select("cache_id", backend.alias("backend"), F.regexp_extract(h, '(?i)<meta name="generator" content="MediaWiki ([0-9.]+)', 1).alias("version"))


@query("""
with r as (select distinct domain, unnest(page_types) as page_type from registry), m as (select domain, coalesce(page_type, '') as page_type, count(*) as n from manifest group by all)
select m.domain, m.page_type, m.n from m where m.page_type <> '' and not exists (select 1 from r where r.domain = m.domain and r.page_type = m.page_type)""")
def capability_gaps(spark: SparkSession, d: str) -> DataFrame:
    """J20, FLT28: page types that a site's pages need and its registry entry doesn't declare."""
    declared = table(spark, d, "registry").select("domain", F.explode("page_types").alias("page_type")).distinct()
    needed = table(spark, d, "manifest").where("page_type is not null and page_type <> ''").groupBy("domain", "page_type").agg(F.count("*").alias("n"))
    return needed.join(declared, ["domain", "page_type"], "left_anti")


@query("""
with o(domain, delay) as (values ('kekkanban.example', 2.5), ('vosnalsus.example', 0.2)), t(ref, tier_delay) as (values ('rate-limit-api', 1.0), ('rate-limit-html', 1.5)),
s as (select domain, min(tier_delay) as tier_delay from (select domain, unnest(anti_crawl_refs) as ref from registry) join t using (ref) group by 1), n as (select domain, count(*) as n from manifest group by 1)
select r.domain, cast(coalesce(o.delay, s.tier_delay, 0.5) as double) as delay, cast(case when coalesce(n.n, 0) = 0 then 0 else greatest(ceil(n.n * greatest(coalesce(o.delay, s.tier_delay, 0.5), 0.5) / 60.0), 1) end as bigint) as minutes
from registry r left join o on o.domain = r.domain left join s on s.domain = r.domain left join n on n.domain = r.domain""")
def rate_limit_layers(spark: SparkSession, d: str) -> DataFrame:
    """FN34, AGG5, D22: a site's delay from override, tier or default, and the time its pages take."""
    over = _values(spark, [("kekkanban.example", 2.5), ("vosnalsus.example", 0.2)], "domain string, own double")
    tiers = _values(spark, [("rate-limit-api", 1.0), ("rate-limit-html", 1.5)], "ref string, tier double")
    r = table(spark, d, "registry")
    tier = r.select("domain", F.explode("anti_crawl_refs").alias("ref")).join(tiers, "ref").groupBy("domain").agg(F.min("tier").alias("tier"))
    n = table(spark, d, "manifest").groupBy("domain").agg(F.count("*").alias("n"))
    delay = F.coalesce("own", "tier", F.lit(0.5))
    out = r.select("domain").join(over, "domain", "left").join(tier, "domain", "left").join(n, "domain", "left")
    return out.select("domain", delay.alias("delay"), F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.ceil(F.col("n") * F.greatest(delay, F.lit(0.5)) / 60.0), F.lit(1))).cast("bigint").alias("minutes"))
