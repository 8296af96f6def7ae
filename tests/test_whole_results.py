"""Queries that must give whole texts and all rows."""

from siltweave.plans import catalog
from tests.compare import database


def test_merged_documents(spark, data):
    want = database(data).sql("select sum(n) from (select length('## ' || title || chr(10) || chr(10) || max_by(content, {'a': converted_at, 'b': result_id})) as n from results where status = 'ok' and length(content) > 0 group by domain, title)").fetchall()[0][0]
    parts = catalog.QUERIES["merged_documents"](spark, data).collect()
    joints = sum(7 * (len(p.toc.split("\n")) - 1) for p in parts)
    assert sum(len(p.body) for p in parts) - joints == want


def test_numbered_rows(spark, data):
    rows = catalog.QUERIES["numbered_rows"](spark, data).orderBy("position").collect()
    n = database(data).sql("select count(*) from results where content is not null").fetchall()[0][0]
    assert n > 40 and [r.position for r in rows] == list(range(1, n + 1))
    assert [r.number for r in rows] == sorted(r.number for r in rows)
