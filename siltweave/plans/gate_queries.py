"""Quality gates of converted texts against the stored page they come from, and the issues made of their failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import text
from siltweave.io import table
from siltweave.operators import quality
from siltweave.operators.ranks import numbered
from siltweave.plans.registry import query


def converted(spark: SparkSession, d: str) -> DataFrame:
    """(result_id, domain, md, html, wiki, unlinked): each good result with its newest stored page; ``unlinked`` are names of
    known pages that the page links to and the text should. Bodies are joined once, by the id of the newest page."""
    pages = table(spark, d, "raw_pages")
    newest = pages.groupBy("domain", "title").agg(F.max(F.struct("fetched_at", "cache_id")).alias("m")).select("domain", "title", "m.cache_id")
    done = table(spark, d, "results").where("status = 'ok'").select("result_id", "domain", "title", F.coalesce("content", F.lit("")).alias("md"))
    bodies = pages.select("cache_id", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("wikitext", F.lit("")).alias("wiki"))
    both = done.join(newest, ["domain", "title"]).join(bodies, "cache_id")
    names = pages.where("html is not null").select("cache_id", "domain", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/wiki/([^"?#]+)'), F.lit(1)))).alias("h"))
    known = table(spark, d, "manifest").select("domain", F.col("title").alias("name")).distinct()
    linked = names.withColumn("name", F.translate("h", "_", " ")).where(~F.col("name").rlike("^(?:Special|File|Image):")).join(known, ["domain", "name"])
    linked = linked.groupBy("cache_id").agg(F.collect_set("name").alias("unlinked"))
    return both.join(linked, "cache_id", "left").drop("cache_id", "title")


_CONVERTED = """newest as (select domain, title, max({'a': fetched_at, 'b': cache_id}).b as cache_id from (select * from raw_pages where fetched_at is not null) group by all
  union all select domain, title, max(cache_id) from raw_pages group by all having count(fetched_at) = 0),
linked as (select l.cache_id, list(distinct l.name) as unlinked from (select cache_id, domain, replace(unnest(regexp_extract_all(html, 'href="/wiki/([^"?#]+)', 1)), '_', ' ') as name from raw_pages where html is not null) l
  join (select distinct domain, title from manifest) m on m.domain = l.domain and m.title = l.name where not regexp_matches(l.name, '^(?:Special|File|Image):') group by l.cache_id),
conv as (select r.result_id, r.domain, coalesce(r.content, '') as md, coalesce(p.html, '') as html, coalesce(p.wikitext, '') as wiki, coalesce(k.unlinked, []) as unlinked
  from results r join newest n on n.domain = r.domain and n.title = r.title join raw_pages p on p.cache_id = n.cache_id left join linked k on k.cache_id = n.cache_id where r.status = 'ok')"""

_CHECKS = rf"""{_CONVERTED},
pre as (select *, len(regexp_extract_all(html, '(?i)<img[ >]')) - len(regexp_extract_all(html, '(?i)<img[^>]*src="data:image/gif;base64[^>]*>')) as imgs, len(regexp_extract_all(md, '!\[[^\]]*\]\([^)]*\)')) as mdimgs,
  list_filter(list_transform(regexp_extract_all(html, '(?is)class="mw-headline"[^>]*>(.*?)</span>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: x <> '' and x <> 'Contents') as sections,
  list_transform(list_filter(string_split(md, chr(10)), lambda x: regexp_matches(trim(x), '^#{{1,6}}\s+.+$')), lambda x: trim(x)) as heads,
  list_filter(regexp_extract_all(html, '(?is)<table[^>]*>.*?</table>', 0), lambda t: len(regexp_extract_all(t, '(?i)<tr[ >]')) > 2 and not regexp_matches(t, '(?i)^<table[^>]*class="[^"]*(?:navbox|nav-box|mw-collapsible|nav-main|nav-header|nav-footer)')) as tables,
  len(list_filter(string_split(md, chr(10)), lambda x: starts_with(trim(x), '|') and not contains(x, '---') and not regexp_matches(trim(x), '^\|[\s\-:|]+\|$'))) as mdrows,
  len(list_filter(string_split(regexp_extract(md, '(?s)## Infobox\n(.*?)(?:\n## |\z)', 1), chr(10)), lambda x: regexp_matches(x, '^(?:\||- )'))) as fields from conv),
rows_ as (select *, list_sum(list_transform(tables, lambda t: len(list_filter(regexp_split_to_array(t, '(?i)<tr[ >]')[2:], lambda x: not (contains(x, '<th') and not contains(x, '<td')))))) as hrows from pre),
c as (select result_id, domain, unnest([
 {{'k': 'S1', 's': case when html = '' then 'skip' when regexp_matches(md, '!\[[^\]]*\]\(/images/') or imgs <> mdimgs then 'fail' else 'pass' end}},
 {{'k': 'S2', 's': case when html = '' then 'skip' when regexp_matches(md, '\[[^\]]*\]\(/wiki/') then 'fail' when regexp_matches(md, '\[[^\]]+\]\(https?://[^/]+/wiki/') then 'pass' when len(list_filter(unlinked, lambda n: not contains(md, '[' || n || '](' || replace(n, ' ', '_') || '.md)'))) > 0 then 'fail' else 'pass' end}},
 {{'k': 'S3', 's': case when not regexp_matches(wiki, '(?i)\{{\{{Infobox') then 'skip' when fields < 3 or regexp_matches(regexp_extract(md, '(?s)## Infobox\n(.*?)(?:\n## |\z)', 1), '<[a-z/]') then 'fail' else 'pass' end}},
 {{'k': 'S4', 's': case when trim(regexp_replace(md, '(?s)\A---.*?---', ''), chr(10) || chr(9) || chr(13) || ' ') = '' then 'fail' else 'pass' end}},
 {{'k': 'S5', 's': case when regexp_matches(regexp_replace(md, '!\[.*?\]\([^)]+?\)', '', 'g'), '(?:^|[^`])[a-z]\d+(?:\.\d+)?[a-z](?:[^`]|$)') or contains(md, 'data:image/gif;base64') or regexp_matches(md, '\\\*') or regexp_matches(md, '</a>|</span>|</div>') or regexp_matches(md, '&amp;|&lt;|&gt;') then 'fail' else 'pass' end}},
 {{'k': 'S6', 's': case when coalesce(hrows, 0) = 0 then 'skip' when abs(mdrows - hrows) > 0.1 * hrows then 'fail' else 'pass' end}},
 {{'k': 'S7', 's': case when regexp_matches(md, '\[!\[[^\]]*\]\([^)]*\)\]\([^)]*\)') then 'fail' else 'pass' end}},
 {{'k': 'S8', 's': case when len(sections) = 0 then 'skip' when len(list_filter(sections, lambda s: len(list_filter(heads, lambda h: contains(h, s))) = 0)) > 0 then 'fail' else 'pass' end}},
 {{'k': 'S10', 's': case when regexp_matches(md, '\[(?:Video|YouTube video|Watch)\]\(') then 'fail' else 'pass' end}},
 {{'k': 'S11', 's': case when regexp_matches(md, '\]\(/(?:wiki|images)/') then 'fail' else 'pass' end}}]) as x from rows_),
checks as (select result_id, domain, x.k as check_id, x.s as status from c)"""


@query(f"with {_CHECKS} select check_id, count(*) as n, count(*) filter (where status = 'skip') as skipped, count(*) filter (where status = 'fail') as failed from checks group by check_id")
def markdown_quality(spark: SparkSession, d: str) -> DataFrame:
    """Each good result checked against its newest stored page, summed up by check."""
    c = quality.page_checks(converted(spark, d))
    return c.groupBy("check_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "skip").alias("skipped"), F.count_if(F.col("status") == "fail").alias("failed"))


@query(f"""with {_CHECKS} select domain, check_id, count(*) filter (where status = 'fail') as failed, round(count(*) filter (where status = 'fail') / count(*)::double, 3) as share from checks where status <> 'skip' group by all""")
def page_quality(spark: SparkSession, d: str) -> DataFrame:
    """S1 to S11 by site: failures and their share of the checks that apply."""
    c = quality.page_checks(converted(spark, d)).where("status <> 'skip'")
    failed = F.count_if(F.col("status") == "fail")
    return c.groupBy("domain", "check_id").agg(failed.alias("failed"), F.round(failed / F.count("*"), 3).alias("share"))


@query(r"""
with b as (select result_id, regexp_extract(coalesce(content, ''), '(?m)^\| ?(?:Name|名称|Wert|Item) ?\| ?([^|\n]*)', 1) as name, regexp_extract(coalesce(content, ''), '(?m)^\| ?(?:ID|Id|Nr\.) ?\| ?([^|\n]*)', 1) as id from results where status = 'ok')
select result_id, regexp_matches(name, '[a-z][A-Z]') as camel, regexp_matches(lower(name), '\.(?:png|jpe?g|gif|webp)') as filename, regexp_matches(lower(id), 'menu|navigation|edit|collection') as navigation from b where name <> '' or id <> ''""")
def infobox_semantics(spark: SparkSession, d: str) -> DataFrame:
    """The name and id a fact table states: names run together, file names, or menu words in an id."""
    m = F.coalesce("content", F.lit(""))
    b = table(spark, d, "results").where("status = 'ok'").select("result_id", F.regexp_extract(m, r"(?m)^\| ?(?:Name|名称|Wert|Item) ?\| ?([^|\n]*)", 1).alias("name"), F.regexp_extract(m, r"(?m)^\| ?(?:ID|Id|Nr\.) ?\| ?([^|\n]*)", 1).alias("id"))
    return b.where("name <> '' or id <> ''").select("result_id", F.col("name").rlike("[a-z][A-Z]").alias("camel"), F.lower("name").rlike(r"\.(?:png|jpe?g|gif|webp)").alias("filename"), F.lower("id").rlike("menu|navigation|edit|collection").alias("navigation"))


#: What a failed check calls for, and who owns it (fixed values of the issue list).
_FIX = {"S1": "image_wrapper", "S2": "link_resolution", "S3": "infobox_html_residue", "S4": "empty_content", "S5": "space_normalization", "S6": "table_class_missing", "S7": "image_wrapper", "S8": "section_loss", "S11": "relative_link"}
_PIPELINE_FIXES = ("infobox_html_residue", "section_loss", "nav_leak", "relative_image_url", "relative_link", "infobox_mismatch", "id_navigation_leak")
_OWNER = {"S1": "self_check", "S2": "pipeline", "S3": "pipeline", "S5": "self_check", "S6": "self_check", "S8": "pipeline", "S9": "pipeline", "S11": "pipeline", "S12": "pipeline"}
_FIX_SQL = "case check_id " + " ".join(f"when '{k}' then '{v}'" for k, v in _FIX.items()) + " end"
_OWNER_SQL = f"case when {_FIX_SQL} in {_PIPELINE_FIXES} then 'pipeline' else coalesce(case check_id " + " ".join(f"when '{k}' then '{v}'" for k, v in _OWNER.items()) + " end, 'self_check') end"
_ISSUES = f"""issues as (select domain, check_id, {_FIX_SQL} as fix, {_OWNER_SQL} as owner, count(*) as n from checks where status = 'fail' group by all),
ranked as (select *, case when fix in ('id_navigation_leak', 'infobox_mismatch') or check_id = 'S2' then 'P0' when fix in ('space_normalization', 'infobox_html_residue', 'section_loss', 'nav_leak') or check_id = 'S5' and owner = 'self_check' then 'P1' when owner = 'self_check' and check_id in ('S1', 'S6') then 'P2' else 'P3' end as priority from issues)"""


def issues(spark: SparkSession, d: str) -> DataFrame:
    """(domain, check_id, fix, owner, n, priority): failures of each site and check with their owner and priority."""
    c = quality.page_checks(converted(spark, d)).where("status = 'fail'").groupBy("domain", "check_id").agg(F.count("*").alias("n"))
    named = lambda m: F.coalesce(*(F.when(F.col("check_id") == k, F.lit(v)) for k, v in m.items()))
    c = c.withColumn("fix", named(_FIX)).withColumn("owner", F.when(F.col("fix").isin(*_PIPELINE_FIXES), "pipeline").otherwise(F.coalesce(named(_OWNER), F.lit("self_check"))))
    own = F.col("owner") == "self_check"
    priority = (
        F.when(F.col("fix").isin("id_navigation_leak", "infobox_mismatch") | (F.col("check_id") == "S2"), "P0")
        .when(F.col("fix").isin("space_normalization", "infobox_html_residue", "section_loss", "nav_leak") | (F.col("check_id") == "S5") & own, "P1")
        .when(own & F.col("check_id").isin("S1", "S6"), "P2").otherwise("P3")
    )
    return c.withColumn("priority", priority)


@query(f"with {_CHECKS}, {_ISSUES} select domain, check_id, owner, priority, n from ranked")
def known_issues(spark: SparkSession, d: str) -> DataFrame:
    """KI1, KI2: failed checks of each site as issues with owner (by fix, then by check) and priority (a cascade of rules)."""
    return issues(spark, d).select("domain", "check_id", "owner", "priority", "n")


@query(f"""with {_CHECKS}, {_ISSUES}, w as (select *, row_number() over (partition by domain order by priority, check_id) as rn from ranked)
select domain, '| ID | Check | Owner | Priority | Count |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg('| KI-' || rn || ' | ' || check_id || ' | ' || owner || ' | ' || priority || ' | ' || n || ' |', chr(10) order by rn) as body from w group by domain""")
def issue_tables(spark: SparkSession, d: str) -> DataFrame:
    """KI4: each site's issues as a Markdown table; a site has at most one row a check."""
    w = numbered(issues(spark, d).withColumn("place", F.struct("priority", "check_id")), ["domain"], "place")
    row = F.format_string("| KI-%d | %s | %s | %s | %d |", "rn", "check_id", "owner", "priority", "n")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", row.alias("row")))), lambda x: x["row"]), "\n")
    return w.groupBy("domain").agg(F.concat(F.lit("| ID | Check | Owner | Priority | Count |\n| --- | --- | --- | --- | --- |\n"), rows).alias("body"))


@query(f"""with {_CHECKS}, found as (select domain, list(distinct {_FIX_SQL}) filter (where {_FIX_SQL} is not null) as fixes from checks where status = 'fail' group by domain),
had as (select domain, list_concat(coalesce(pagination, []), coalesce(entry_points, [])) as rules from registry)
select h.domain, array_to_string(list_sort(list_distinct(list_concat(h.rules, coalesce(f.fixes, [])))), ',') as rules from had h left join found f on f.domain = h.domain""")
def rule_amendments(spark: SparkSession, d: str) -> DataFrame:
    """Q13, KI5: what a site's failed checks call for, merged into the rules it has."""
    found = issues(spark, d).where("fix is not null").groupBy("domain").agg(F.collect_set("fix").alias("fixes"))
    none = F.array().cast("array<string>")
    had = table(spark, d, "registry").select("domain", F.concat(F.coalesce("pagination", none), F.coalesce("entry_points", none)).alias("rules"))
    return had.join(found, "domain", "left").select("domain", F.array_join(F.array_sort(F.array_union("rules", F.coalesce("fixes", none))), ",").alias("rules"))


_STEP = r"regexp_replace(regexp_replace({0}, '(?:</a>|</span>|</div>)', '', 'g'), '\]\(/(wiki|images)/', '](https://' || domain || '/\1/', 'g')"
_BAD = r"regexp_matches({0}, '</a>|</span>|</div>') or regexp_matches({0}, '\]\(/(?:wiki|images)/') or regexp_matches({0}, '&amp;|&lt;|&gt;')"


@query(f"""
with a as (select domain, coalesce(content, '') as t0 from results where status = 'ok'), b as (select *, {_STEP.format('t0')} as t1 from a), c as (select *, replace(replace(replace(t1, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as t2 from b)
select 0 as iteration, count(*) filter (where {_BAD.format('t0')}) as failed from c union all select 1, count(*) filter (where {_BAD.format('t1')}) from c union all select 2, count(*) filter (where {_BAD.format('t2')}) from c""")
def remediation_loop(spark: SparkSession, d: str) -> DataFrame:
    """ITR5: convert, check, put right: texts that still fail after each of two rounds of amendments, in one pass over the texts."""
    t0 = F.coalesce("content", F.lit(""))
    t1 = text.absolute_links(F.regexp_replace(t0, "(?:</a>|</span>|</div>)", ""), F.concat(F.lit("https://"), "domain"))
    t2 = F.replace(F.replace(F.replace(t1, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    bad = lambda t: F.count_if(t.rlike("</a>|</span>|</div>") | t.rlike(r"\]\(/(?:wiki|images)/") | t.rlike("&amp;|&lt;|&gt;"))
    sums = table(spark, d, "results").where("status = 'ok'").agg(F.array(bad(t0), bad(t1), bad(t2)).alias("f"))
    return sums.select(F.posexplode("f").alias("iteration", "failed"))


@query(r"""
with l as (select result_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from results where content is not null),
f as (select *, sum(case when starts_with(trim(line), '```') then 1 else 0 end) over (partition by result_id order by n) as fence from l),
t as (select *, starts_with(trim(line), '|') and fence % 2 = 0 as row from f), g as (select *, n - sum(case when row then 1 else 0 end) over (partition by result_id order by n) as grp from t),
c as (select result_id, grp, len(string_split(replace(trim(line), '\|', ''), '|')) as cols from g where row), s as (select result_id, grp, count(*) as rows_, count(distinct cols) as kinds from c group by all)
select result_id, count(*) as n_tables, cast(sum(rows_) as bigint) as n_rows, count(*) filter (where kinds > 1) as n_uneven from s group by result_id""")
def table_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Q15, AGG21: tables, table rows and tables of uneven rows of each text, code fences and escaped pipes apart; a fold over
    the text's own lines needs no shuffle."""
    zero = F.struct(F.lit(False).alias("code"), F.lit(False).alias("on"), F.lit(0).alias("cols"), F.lit(False).alias("bad"), F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("r"), F.lit(0).cast("bigint").alias("u"))

    def step(a, x):
        bare = F.trim(x)
        code = F.when(bare.startswith("```"), ~a["code"]).otherwise(a["code"])
        row = bare.startswith("|") & ~code
        cols = F.size(F.split(F.replace(bare, F.lit("\\|"), F.lit("")), r"\|"))
        new = row & ~a["on"]
        odd = row & a["on"] & (cols != a["cols"])
        return F.struct(
            code.alias("code"), row.alias("on"), F.when(row & a["on"], a["cols"]).otherwise(cols).alias("cols"), F.when(row & a["on"], a["bad"] | odd).otherwise(F.lit(False)).alias("bad"),
            (a["t"] + new.cast("bigint")).alias("t"), (a["r"] + row.cast("bigint")).alias("r"), (a["u"] + (odd & ~a["bad"]).cast("bigint")).alias("u"),
        )

    folded = F.aggregate(F.split("content", "\n"), zero, step)
    return table(spark, d, "results").where("content is not null").select("result_id", folded.alias("f")).where("f.r > 0").select("result_id", F.col("f.t").alias("n_tables"), F.col("f.r").alias("n_rows"), F.col("f.u").alias("n_uneven"))


@query("""
select 'site without pages' as finding, domain from registry r where not exists (select 1 from manifest m where m.domain = r.domain)
union all select distinct 'pages without site', domain from manifest m where domain is not null and not exists (select 1 from registry r where r.domain = m.domain)
union all select 'file of another site', domain from registry where file is not null and not contains(file, domain)
union all select 'declared type unused: ' || k.t, k.domain from (select distinct domain, unnest(page_types) as t from registry) k where not exists (select 1 from manifest m where m.domain = k.domain and m.page_type = k.t)
union all select 'used type undeclared: ' || k.t, k.domain from (select distinct domain, page_type as t from manifest where page_type is not null and domain is not null) k where not exists (select 1 from registry r where r.domain = k.domain and list_contains(r.page_types, k.t))""")
def registry_consistency(spark: SparkSession, d: str) -> DataFrame:
    """What registry and manifest lack of each other, sites and page types, and entries whose file is another site's."""
    r, m = table(spark, d, "registry"), table(spark, d, "manifest").select("domain").where("domain is not null").distinct()
    lack = r.select("domain").join(m, "domain", "left_anti").select(F.lit("site without pages").alias("finding"), "domain")
    odd = r.where("file is not null").where(~F.contains("file", "domain")).select(F.lit("file of another site").alias("finding"), "domain")
    declared = r.select("domain", F.explode("page_types").alias("t")).distinct()
    used = table(spark, d, "manifest").where("page_type is not null and domain is not null").select("domain", F.col("page_type").alias("t")).distinct()
    unused = declared.join(used, ["domain", "t"], "left_anti").select(F.concat(F.lit("declared type unused: "), "t").alias("finding"), "domain")
    gaps = used.join(declared, ["domain", "t"], "left_anti").select(F.concat(F.lit("used type undeclared: "), "t").alias("finding"), "domain")
    return lack.unionByName(unused).unionByName(gaps).unionByName(m.join(r.select("domain"), "domain", "left_anti").select(F.lit("pages without site").alias("finding"), "domain")).unionByName(odd)


@query("""
select domain, array_to_string(list_filter(coalesce(page_types, []), lambda x, i: list_position(page_types, x) = i), ',') as page_types, array_to_string(list_filter(coalesce(pagination, []), lambda x, i: list_position(pagination, x) = i), ',') as pagination, list_has_all(coalesce(page_types, []), ['static_article']) as complete from registry""")
def registry_types(spark: SparkSession, d: str) -> DataFrame:
    """AGG20, FLT28: declared page types and paginations of each site, once each, in order, and whether all that is required is among them."""
    once = lambda c: F.array_join(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))), ",").alias(c)
    lacks = F.size(F.array_except(F.array(F.lit("static_article")), F.coalesce("page_types", F.array().cast("array<string>"))))
    return table(spark, d, "registry").select("domain", once("page_types"), once("pagination"), (lacks == 0).alias("complete"))
