"""Queries over converted texts: text functions, quality checks, assembly and crawling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.functions import text, urls
from siltweave.io import table
from siltweave.operators import quality
from siltweave.operators.ranks import numbered
from siltweave.plans.registry import query


@query("""
select result_id, trim(regexp_replace(content, '[\\s\\x{00a0}\\x{3000}]+', ' ', 'g')) as collapsed,
 replace(replace(replace(replace(replace(replace(regexp_replace(content, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as plain from results where content is not null""")
def normalized_text(spark: SparkSession, d: str) -> DataFrame:
    """FN12, FN13: white space collapsed, and tags stripped with entities decoded."""
    return table(spark, d, "results").where("content is not null").select("result_id", text.collapse("content").alias("collapsed"), text.strip_tags("content").alias("plain"))


@query("""
with l as (select result_id, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from results where content is not null),
h as (select result_id, coalesce(regexp_replace(list_filter(lines, lambda x: regexp_matches(x, '^#{1,6} '))[1], '^#{1,6} +', ''), lines[1], '') as heading from l)
select result_id, heading, regexp_replace(regexp_replace(lower(heading), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g') as anchor from h""")
def first_headings(spark: SparkSession, d: str) -> DataFrame:
    """FN15, FN16: each text's heading and its anchor."""
    h = table(spark, d, "results").where("content is not null").select("result_id", text.first_heading("content").alias("heading"))
    return h.withColumn("anchor", text.anchor("heading"))


@query("""
with e as (select result_id, list_sort(map_keys(frontmatter)) as k, frontmatter as f from results where frontmatter is not null)
select result_id, '---' || chr(10) || coalesce(list_aggregate(list_transform(k, lambda x: x || ': ' || case when regexp_matches(f[x], '[\\n:"]') then '"' || replace(replace(f[x], '"', '\\"'), chr(10), '\\n') || '"' else f[x] end), 'string_agg', chr(10)), '') || chr(10) || '---' || chr(10) as block,
 '---' || chr(10) || coalesce(list_aggregate(list_transform(k, lambda x: x || ': ' || case when regexp_matches(f[x], '[\\n:"]') then '"' || replace(f[x], chr(10), '\\n') || '"' else f[x] end), 'string_agg', chr(10)), '') || chr(10) || '---' || chr(10) as bare_block from e""")
def frontmatter_blocks(spark: SparkSession, d: str) -> DataFrame:
    """FN17: front matter as YAML, keys in order, with and without escaped quotes (the two converters differ in that)."""
    return table(spark, d, "results").where("frontmatter is not null").select("result_id", text.frontmatter("frontmatter").alias("block"), text.frontmatter("frontmatter", escape=False).alias("bare_block"))


@query("""
with r as (select result_id, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || coalesce(content, '') as page from results)
select result_id, regexp_replace(page, '\\A---\\n.*?\\n---\\n', '', 's') as body,
  trim(regexp_replace(regexp_replace(page, '\\A---\\n.*?\\n---\\n', '', 's'), '(?m)^#+ .*$', '', 'g'), chr(10) || ' ') = '' as blank from r""")
def content_integrity(spark: SparkSession, d: str) -> DataFrame:
    """FN18, Q14, S4: pages whose body is empty once front matter and headings are gone."""
    page = F.concat(F.lit("---\ntitle: "), "title", F.lit("\n---\n"), F.coalesce("content", F.lit("")))
    body = text.strip_frontmatter(page)
    return table(spark, d, "results").select("result_id", body.alias("body"), (F.btrim(F.regexp_replace(body, "(?m)^#+ .*$", ""), F.lit("\n ")) == "").alias("blank"))


@query("""
with i as (select cache_id, list_filter(images, lambda x: not regexp_matches(x, '(?i)(icon|logo|sprite)'))[1] as image, domain from raw_pages)
select cache_id, replace(image, ' ', '_') as image, 'https://' || domain || '/images/' || replace(image, ' ', '_') as url, 'https://' || domain || '/Special:Redirect/file/' || replace(url_encode(image), '+', '%20') as redirect from i""")
def image_names(spark: SparkSession, d: str) -> DataFrame:
    """FN19, FN20: the first image of a page that isn't skipped, and its URL."""
    raw = F.get(F.filter("images", lambda x: ~x.rlike("(?i)(icon|logo|sprite)")), F.lit(0))
    first = F.translate(raw, " ", "_")
    return table(spark, d, "raw_pages").select("cache_id", first.alias("image"), F.concat(F.lit("https://"), "domain", F.lit("/images/"), first).alias("url"), F.concat(F.lit("https://"), "domain", F.lit("/Special:Redirect/file/"), F.replace(F.url_encode(raw), F.lit("+"), F.lit("%20"))).alias("redirect"))


@query("""
with r as (select result_id, content as c, 'Domain: ' || domain as b from results where content is not null),
p as (select *, regexp_extract(c, '(?m)^(#{1,6} [^\\n]*)$', 1) as h from r), q as (select *, case when h = '' then 0 when starts_with(c, h) then 1 else strpos(c, chr(10) || h) + 1 end as at0 from p)
select result_id, case when at0 = 0 then b || chr(10) || chr(10) || c when length(c) < at0 + length(h) then c || chr(10) || chr(10) || b else substr(c, 1, at0 + length(h)) || chr(10) || b || chr(10) || substr(c, at0 + length(h) + 1) end as page from q""")
def inserted_blocks(spark: SparkSession, d: str) -> DataFrame:
    """FN21, FN22, K17: a block put after the first heading."""
    return table(spark, d, "results").where("content is not null").select("result_id", text.insert_after_heading("content", F.concat(F.lit("Domain: "), "domain")).alias("page"))


@query("""
select result_id, regexp_replace(regexp_replace(regexp_replace(content, ' +([,.;:!?])', '\\1', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') as spaced,
  regexp_replace(regexp_replace(regexp_replace(content, '\\\\([_*\\[\\]()#+.!-])', '\\1', 'g'), ' ?\\(\\s*\\)', '', 'g'), '(?:\\s*[|•·]\\s*){2,}', ' | ', 'g') as unescaped,
  regexp_replace(content, '\\]\\((/(?:wiki|images)/[^)]*)\\)', '](https://' || domain || '\\1)', 'g') as absolute from results where content is not null""")
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    """FN23, FN24, FN26, K24: spacing, escapes and relative targets put right."""
    return table(spark, d, "results").where("content is not null").select("result_id", text.fix_spaces("content").alias("spaced"), text.clean_escapes("content").alias("unescaped"), text.absolute_links("content", F.concat(F.lit("https://"), "domain")).alias("absolute"))


@query()
def repeated_words(spark: SparkSession, d: str) -> DataFrame:
    """FN23: texts in which a word directly follows itself (needs a back-reference, which the SQL dialect lacks)."""
    r = table(spark, d, "results").where("content is not null").select("result_id", "content", text.deduplicate_words("content").alias("fixed"))
    return r.where("content <> fixed").select("result_id", (F.length("content") - F.length("fixed")).alias("saved"))


@query("""
with p as (select doc_id, list_transform(string_split_regex(text, '\\n\\n+'), lambda x: trim(x)) as parts from documents where text is not null)
select doc_id, coalesce(list_filter(parts, lambda x: length(x) >= 30 and len(regexp_extract_all(x, '[一-鿿]')) > 0.3 * length(x))[1], '') as intro from p""")
def chinese_intro(spark: SparkSession, d: str) -> DataFrame:
    """FN28: the first mostly Chinese paragraph."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.chinese_paragraph("text").alias("intro"))


@query("""
with k as (select page_seq, list_filter(['Bar', 'Mok', 'Zel', 'Pin'], lambda n: contains(upper(title), upper(n))) as hit from manifest)
select page_seq, case when len(hit) > 0 then list_aggregate(hit, 'string_agg', ', ') else 'none' end as names from k""")
def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """FN29: the listed names a title holds."""
    return table(spark, d, "manifest").select("page_seq", text.keywords("title", ["Bar", "Mok", "Zel", "Pin"], "none").alias("names"))


@query("""
select doc_id, '<movie><title>' || replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</title><year>' || coalesce(strftime(collected_at, '%Y'), '') || '</year><premiered>' || coalesce(strftime(collected_at, '%Y-%m-%d'), '') || '</premiered></movie>' as nfo from documents""")
def sidecars(spark: SparkSession, d: str) -> DataFrame:
    """SNK9, FN30, FN31: XML sidecars with escaped text and date parts."""
    part = lambda f: F.coalesce(F.date_format("collected_at", f), F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("<movie><title>"), text.xml_escape(F.coalesce("title", F.lit(""))), F.lit("</title><year>"), part("yyyy"), F.lit("</year><premiered>"), part("yyyy-MM-dd"), F.lit("</premiered></movie>")).alias("nfo"))


@query()
def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    """FN27: titles in compatibility form for matching."""
    return table(spark, d, "manifest").select("page_seq", text.nfkc("title").alias("folded"))


@query("""
with l as (select result_id, list_filter(string_split(content, chr(10)), lambda x: not regexp_matches(x, '^\\s*(?:\\* )?(?:Retrieved from|Sign up|Share this|©)') and not regexp_matches(x, '^\\s*\\|?\\s*\\|\\s*$')) as kept, len(string_split(content, chr(10))) as n from results where content is not null)
select result_id, cast(n - len(kept) as bigint) as dropped, coalesce(list_aggregate(kept, 'string_agg', chr(10)), '') as body from l""")
def line_filters(spark: SparkSession, d: str) -> DataFrame:
    """FN36: lines that a profile's rules drop."""
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda x: ~x.rlike(r"^\s*(?:\* )?(?:Retrieved from|Sign up|Share this|©)") & ~x.rlike(r"^\s*\|?\s*\|\s*$"))
    return table(spark, d, "results").where("content is not null").select("result_id", (F.size(lines) - F.size(kept)).cast("bigint").alias("dropped"), F.array_join(kept, "\n").alias("body"))


_NAV = ", ".join(f"'{w}'" for w in quality.NAVIGATION)


@query(f"""
with l as (select result_id, line_no, lower(trim(regexp_replace(line, '^[-*+#>\\s]+|[\\[\\]]|\\([^)]*\\)', '', 'g'))) in ({_NAV}) as nav from (select result_id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from results where content is not null)),
g as (select *, line_no - sum(case when nav then 1 else 0 end) over (partition by result_id order by line_no) as grp from l), r as (select result_id, grp, count(*) filter (where nav) as n from g group by all)
select result_id as doc, cast(max(n) as integer) as longest from r group by result_id""")
def nav_leak_runs(spark: SparkSession, d: str) -> DataFrame:
    """S9, AGG17, W2: the longest run of menu lines of each text."""
    return quality.navigation_runs(table(spark, d, "results"), "result_id", "content")


@query("""
with s as (select domain, title, max_by(content, {'a': converted_at, 'b': result_id}) as content from results where status = 'ok' and length(content) > 0 group by all),
h as (select domain, title, '## ' || title || chr(10) || chr(10) || content as section, '- [' || title || '](#' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '-', 'g'), '^-|-$', '', 'g') || ')' as toc, row_number() over (partition by domain order by title) - 1 as rn from s)
select domain, cast(floor(rn / 100) as integer) as part, list_aggregate(list(toc order by title), 'string_agg', chr(10)) as toc, list_aggregate(list(section order by title), 'string_agg', chr(10) || chr(10) || '---' || chr(10) || chr(10)) as body from h group by all""")
def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """SNK7, K23, ASM1, SRT2: each site's latest texts merged whole with a table of contents, 100 a part.

    Titles are numbered without their texts, which move to their part afterwards.
    """
    r = table(spark, d, "results").where("status = 'ok' and length(content) > 0")
    latest = r.groupBy("domain", "title").agg(F.max(F.struct("converted_at", "result_id")).alias("m")).select("domain", "title", "m.result_id")
    parts = numbered(latest, ["domain"], "title").select("result_id", F.floor((F.col("rn") - 1) / 100).cast("int").alias("part"))
    rows = r.select("result_id", "domain", "title", "content").join(parts, "result_id")
    rows = rows.select("domain", "part", "title", F.concat(F.lit("## "), "title", F.lit("\n\n"), "content").alias("section"), F.concat(F.lit("- ["), "title", F.lit("](#"), text.anchor("title"), F.lit(")")).alias("toc"))
    listed = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", c))), lambda x: x[c]), sep)
    return rows.groupBy("domain", "part").agg(listed("toc", "\n").alias("toc"), listed("section", "\n\n---\n\n").alias("body"))


@query("""
with p as (select m.domain, coalesce(nullif(lower(m.target_directory), ''), 'misc') as dir, bool_or(coalesce(m.is_list_page, false)) as has_index, count(*) as n from manifest m group by all)
select domain, dir, '# ' || upper(left(dir, 1)) || substr(dir, 2) || chr(10) || chr(10) || n || ' pages' as body from p where not has_index""")
def stub_indexes(spark: SparkSession, d: str) -> DataFrame:
    """ASM6, ASM7: stub index pages of directories without a list page."""
    p = table(spark, d, "manifest").groupBy("domain", F.coalesce(F.expr("nullif(lower(target_directory), '')"), F.lit("misc")).alias("dir")).agg(F.bool_or(F.coalesce("is_list_page", F.lit(False))).alias("has_index"), F.count("*").alias("n"))
    return p.where("not has_index").select("domain", "dir", F.concat(F.lit("# "), F.upper(F.left("dir", F.lit(1))), F.substr("dir", F.lit(2)), F.lit("\n\n"), F.col("n").cast("string"), F.lit(" pages")).alias("body"))


@query("""
with c as (select distinct domain, unnest(categories) as category from manifest), k as (select domain, category, lower(replace(category, ' ', '-')) as dir from c),
m as (select domain, title, min(page_seq) as page_seq from manifest group by all)
select coalesce(k.domain, m.domain) as domain, coalesce(k.category, m.title) as title, k.category is not null as is_list_page, k.dir from k full outer join m on m.domain = k.domain and m.title = k.category""")
def homepage_manifest(spark: SparkSession, d: str) -> DataFrame:
    """ASM9: pages and category pages in one manifest, category pages with a derived directory."""
    m = table(spark, d, "manifest")
    k = m.select(F.col("domain").alias("kd"), F.explode("categories").alias("category")).distinct()
    p = m.groupBy("domain", "title").agg(F.min("page_seq").alias("page_seq"))
    j = k.join(p, (F.col("kd") == F.col("domain")) & (F.col("category") == F.col("title")), "full_outer")
    return j.select(F.coalesce("kd", "domain").alias("domain"), F.coalesce("category", "title").alias("title"), F.col("category").isNotNull().alias("is_list_page"), F.lower(F.replace("category", F.lit(" "), F.lit("-"))).alias("dir"))


_STATE = {"error": 1, "signup": 2, "click": 3}


@query("""
with e as (select user_id, event_type, count(*) as n, max(ts) as last from events group by all)
select user_id, coalesce(max(n) filter (where event_type = 'error'), 0) as errors, arg_max(event_type, {'t': last, 'e': event_type}) as last_type,
 case when coalesce(max(n) filter (where event_type = 'error'), 0) >= 20 then 'P0' when coalesce(max(n) filter (where event_type = 'error'), 0) >= 10 then 'P1' when coalesce(max(n) filter (where event_type = 'error'), 0) > 0 then 'P2' else 'P3' end as priority from e group by user_id""")
def issue_priorities(spark: SparkSession, d: str) -> DataFrame:
    """AGG18: priority of an issue by its counted errors, last event by time."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    errors = F.coalesce(F.max(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0).cast("long"))
    a = e.groupBy("user_id").agg(errors.alias("errors"), F.max_by("event_type", F.struct("last", "event_type")).alias("last_type"))
    return a.withColumn("priority", F.when(F.col("errors") >= 20, "P0").when(F.col("errors") >= 10, "P1").when(F.col("errors") > 0, "P2").otherwise("P3"))


@query("""
with e as (select user_id as issue, ts, case event_type when 'click' then 'in_progress' when 'purchase' then 'resolved' else 'wontfix' end as s from events where event_type in ('click', 'purchase', 'error')),
f as (select issue, min({'t': ts, 's': s}) as a from e where s in ('in_progress', 'wontfix') group by issue), g as (select e.issue, min({'t': ts, 's': s}) as b from e join f on f.issue = e.issue where f.a.s = 'in_progress' and e.s in ('resolved', 'wontfix') and (e.ts > f.a.t or e.ts = f.a.t and e.s > f.a.s) group by e.issue)
select i.issue, coalesce(g.b.s, f.a.s, 'open') as state, cast(case when f.a is null then 0 when g.b is null then 1 else 2 end as integer) as n_steps from (select distinct issue from e) i left join f on f.issue = i.issue left join g on g.issue = i.issue""")
def ki_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """KI3: the last legal state of each issue, a fold over its ordered transitions."""
    from siltweave.operators.lifecycle import last_state

    e = table(spark, d, "events").select(F.col("user_id").alias("issue"), "ts", F.when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "purchase", "resolved").when(F.col("event_type") == "error", "wontfix").alias("state"))
    return last_state(e.where("state is not null"), "issue", "ts", "state")


@query("""
with c as (select result_id, domain, status, unnest(warnings) as warning from results), k as (select domain, warning, count(*) as n from c group by all),
p as (select *, case when n >= 5 then 'P0' when n >= 2 then 'P1' else 'P2' end as priority from k), w as (select *, row_number() over (order by priority, n desc, domain, warning) as rn from p)
select priority, count(*) as n_issues, cast(sum(n) as bigint) as n_findings, min('KI-' || rn) as first_id from w group by priority""")
def ki_batches(spark: SparkSession, d: str) -> DataFrame:
    """AGG18, W5, D11: issues of each priority with ids numbered over all, one a domain and kind of warning."""
    k = table(spark, d, "results").select("domain", F.explode("warnings").alias("warning")).groupBy("domain", "warning").agg(F.count("*").alias("n"))
    p = k.withColumn("priority", F.when(F.col("n") >= 5, "P0").when(F.col("n") >= 2, "P1").otherwise("P2"))
    w = numbered(p.withColumn("place", F.struct("priority", -F.col("n"), "domain", "warning")), [], "place")
    return w.groupBy("priority").agg(F.count("*").alias("n_issues"), F.sum("n").alias("n_findings"), F.min(F.concat(F.lit("KI-"), F.col("rn").cast("string"))).alias("first_id"))


@query("""
with w as (select domain, unnest(warnings) as w from results), f as (select domain, list_sort(list(distinct case w when 'unresolved_link' then 'fix_links' when 'missing_image' then 'skip_images' when 'empty_section' then 'drop_empty' else 'expand_templates' end)) as ops from w group by domain)
select domain, list_aggregate(ops, 'string_agg', ',') as amendments from f""")
def remediation(spark: SparkSession, d: str) -> DataFrame:
    """Q13, KI5: the rule amendments that a site's findings call for."""
    op = F.when(F.col("w") == "unresolved_link", "fix_links").when(F.col("w") == "missing_image", "skip_images").when(F.col("w") == "empty_section", "drop_empty").otherwise("expand_templates")
    w = table(spark, d, "results").select("domain", F.explode("warnings").alias("w"))
    return w.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set(op)), ",").alias("amendments"))


@query("""
with h as (select domain, converted_at >= timestamp '2024-07-01' as run, count(*) filter (where status = 'error') as errors, count(*) filter (where coalesce(content, '') = '') as blank, coalesce(sum(len(warnings)), 0)::bigint as warned from results where converted_at is not null group by all)
select c.domain, c.errors - coalesce(b.errors, 0) as more_errors, c.blank - coalesce(b.blank, 0) as more_blank, c.warned - coalesce(b.warned, 0) as more_warnings from h c left join h b on b.domain = c.domain and not b.run where c.run""")
def regression_deltas(spark: SparkSession, d: str) -> DataFrame:
    """AGG22: counters of the conversions since a date against those before it, from one pass."""
    run = (F.col("converted_at") >= F.lit("2024-07-01").cast("timestamp")).alias("run")
    r = table(spark, d, "results").where("converted_at is not null").groupBy("domain", run).agg(F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.coalesce("content", F.lit("")) == "").alias("blank"), F.coalesce(F.sum(F.when(F.col("warnings").isNotNull(), F.size("warnings"))), F.lit(0)).cast("bigint").alias("warned"))
    part = lambda c, now: F.max(F.when(F.col("run") == now, F.col(c)))
    p = r.groupBy("domain").agg(part("errors", True).alias("e1"), part("errors", False).alias("e0"), part("blank", True).alias("b1"), part("blank", False).alias("b0"), part("warned", True).alias("w1"), part("warned", False).alias("w0"))
    return p.where("e1 is not null").select("domain", (F.col("e1") - F.coalesce("e0", F.lit(0))).alias("more_errors"), (F.col("b1") - F.coalesce("b0", F.lit(0))).alias("more_blank"), (F.col("w1") - F.coalesce("w0", F.lit(0))).alias("more_warnings"))


@query("""
with a as (select domain, title, content, row_number() over (partition by domain, title order by converted_at, result_id) as n, count(*) over (partition by domain, title) as k from results where status = 'ok')
select x.domain, x.title, x.content = y.content as same from a x join a y on x.domain = y.domain and x.title = y.title and x.n = 1 and y.n = y.k where y.k > 1""")
def golden_diff(spark: SparkSession, d: str) -> DataFrame:
    """Q17: whether the first and the last conversion of a page agree, compared by digest."""
    r = table(spark, d, "results").where("status = 'ok'").select("domain", "title", "converted_at", "result_id", F.md5("content").alias("digest"))
    order = F.struct("converted_at", "result_id")
    g = r.groupBy("domain", "title").agg(F.min_by("digest", order).alias("first"), F.max_by("digest", order).alias("last"), F.count("*").alias("k"))
    return g.where("k > 1").select("domain", "title", (F.col("first") == F.col("last")).alias("same"))
