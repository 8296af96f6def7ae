"""Plain SQL for the training-text queries that SQL can express on whole tables."""

_WORDS = """regexp_extract_all(regexp_replace(lower({0}), '([一-鿿])', ' \\1 ', 'g'), '[一-鿿]|[\\p{{L}}\\p{{N}}]+')"""

_GRAMS = """select {id} as id, w, i from (select {id}, """ + _WORDS + """ as w from {table} where {text} is not null), unnest(range(1, len(w) - 10)) t(i) where len(w) >= 12"""

_NEAR = """texts as (
  select 'content' as src, result_id as id, '' as grp, regexp_replace(lower(content), '[^\\p{L}\\p{N}]', '', 'g') as t, 12 as k from results where content is not null
  union all
  select 'title', page_seq, coalesce(domain, ''), regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g'), 3 from manifest where title is not null
), kept as (select * from texts where length(t) >= case when src = 'content' then 300 else 3 end),
same as (select src, grp, t, k, min(id) as rep from kept group by all),
sh as (select distinct src, grp, rep, substr(t, i, k) as s from same, unnest(range(1, length(t) - k + 2)) u(i)),
n as (select src, rep, count(*) as n from sh group by all),
both_ as (select a.src, a.rep as ra, b.rep as rb, count(*) as m from sh a join sh b on a.src = b.src and a.grp = b.grp and a.s = b.s and a.rep < b.rep group by all),
near as (select both_.src, ra, rb from both_ join n x on x.src = both_.src and x.rep = ra join n y on y.src = both_.src and y.rep = rb where m * 10 >= 6 * (x.n + y.n - m)),
members as (select kept.src, id, rep from kept join same using (src, grp, t))"""

_FREQUENT = """lines as (
  select result_id, domain, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as line_no from results where content <> ''
), keyed as (select *, regexp_replace(lower(line), '[^\\p{L}]', '', 'g') as key from lines),
docs as (select domain, count(distinct result_id) as n from lines group by domain),
frequent as (
  select domain, key from keyed join docs using (domain) where length(key) >= 12 group by domain, key, n
  having count(distinct result_id) >= 5 and count(distinct result_id) * 10 >= n
)"""

_LEAKS = (
    """d as ("""
    + _GRAMS.format("text", id="doc_id", table="documents", text="text")
    + """),
e as ("""
    + _GRAMS.format("text", id="item_id", table="eval_items", text="text")
    + """),
g as (select distinct id, array_to_string(w[i:i+11], ' ') as short, case when len(w) >= i + 19 then array_to_string(w[i:i+19], ' ') end as long from d),
h as (select distinct id, array_to_string(w[i:i+11], ' ') as short, case when len(w) >= i + 19 then array_to_string(w[i:i+19], ' ') end as long from e),
leaks as (select distinct g.id as doc_id, h.id as item_id from g join h on g.short = h.short where not regexp_matches(g.short, '[一-鿿]') or g.long = h.long)"""
)

SQL = {
    "p3_found": "with " + _NEAR + """,
pairs as (
  select near.src, a.id as x, b.id as y from near join members a on a.src = near.src and a.rep = ra join members b on b.src = near.src and b.rep = rb
  union all
  select a.src, a.id, b.id from members a join members b on a.src = b.src and a.rep = b.rep and a.id < b.id
)
select distinct src, least(x, y) as id_a, greatest(x, y) as id_b from pairs""",
    "p3_classes": "with recursive " + _NEAR + """,
edges as (select src, ra as x, rb as y from near union select src, rb, ra from near),
reach(src, x, y) as (select distinct src, rep, rep from members union select reach.src, reach.x, edges.y from reach join edges on edges.src = reach.src and edges.x = reach.y),
label as (select src, x, min(y) as class_id from reach group by all)
select distinct members.src, members.id, label.class_id from members join label on label.src = members.src and label.x = members.rep""",
    "p4_found": "with " + _FREQUENT + """
select distinct result_id, cast(line_no as integer) as line_no from keyed join frequent using (domain, key)""",
    "p4_clean": "with " + _FREQUENT + """,
kept as (select result_id, coalesce(string_agg(line, chr(10) order by line_no) filter (where frequent.key is null), '') as content
  from keyed left join frequent on frequent.domain = keyed.domain and frequent.key = keyed.key group by result_id)
select r.result_id, case when r.content <> '' then kept.content else r.content end as content from results r left join kept on kept.result_id = r.result_id""",
    "p7_found": "with " + _LEAKS + " select doc_id, item_id from leaks",
    "p7_clean": "with " + _LEAKS + " select doc_id, lang, source, kind, title, text from documents where doc_id not in (select doc_id from leaks)",
}
