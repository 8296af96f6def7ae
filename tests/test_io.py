"""Sources, sinks, streaming, column functions and iteration on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

from siltweave.functions import text, urls
from siltweave.operators import crawl, lifecycle, quality
from siltweave.sources import readers, sinks
from siltweave.streaming import pipelines


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


def test_sitemaps(spark):
    urlset = "<urlset><url><loc>https://a/1</loc></url><url><loc><![CDATA[https://a/2]]></loc></url><url><loc>ftp://no</loc></url></urlset>"
    index = "<sitemapindex>" + "".join(f"<sitemap><loc>https://a/{n}.xml</loc></sitemap>" for n in ("s", "t", "bad", "deep", "gone")) + "</sitemapindex>"
    rows = [("root", index, 200), ("https://a/s.xml", urlset, 200), ("https://a/t.xml", urlset, 200), ("https://a/bad.xml", "<html>", 200), ("https://a/deep.xml", index, 200), ("https://a/gone.xml", None, 404)]
    found, errors = readers.resolve_sitemaps(spark.createDataFrame(rows, "url string, xml string, http_code int"), "root")
    assert sorted(r["url"] for r in found.collect()) == ["https://a/1", "https://a/2"]
    assert {r["reason"] for r in errors.collect()} == {"parse_error", "nested_index", "http_404"}


def test_manifest(spark, tmp_path):
    (tmp_path / "new.json").write_text('{"pages": [{"title": "A", "ns": 0}, {"title": "B"}]}')
    (tmp_path / "old.json").write_text('{"visited": ["https://a/1"]}')
    assert [r["title"] for r in readers.manifest(spark, str(tmp_path / "new.json")).orderBy("seq").collect()] == ["A", "B"]
    assert readers.manifest(spark, str(tmp_path / "old.json")).first()["url"] == "https://a/1"


def test_strategy():
    s = readers.strategy("---\ndomain: w.example\npages:\n  - id: a\n    url: \"/x\"\n  - id: b\napi:\n  delay: 0.5\n  on: true\ntags: [p, q]\n---\ntext")
    assert s == {"domain": "w.example", "pages": [{"id": "a", "url": "/x"}, {"id": "b"}], "api": {"delay": 0.5, "on": True}, "tags": ["p", "q"]}
    assert readers.strategy("no front matter") == {}


def test_cache_upsert(spark, tmp_path):
    schema = "platform string, domain string, title string, html string, fetched_at timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    path = str(tmp_path / "cache")
    sinks.upsert_cache(spark.createDataFrame([("m", "d", "A", "1", day(1)), ("m", "e", "B", "1", day(1))], schema), path)
    sinks.upsert_cache(spark.createDataFrame([("m", "d", "A", "2", day(2)), ("m", "d", "A", "0", day(1)), ("m", "d", "C", "3", None)], schema), path)
    got = {(r["title"], r["html"]) for r in readers.page_cache(spark, path, "m").collect()}
    assert got == {("A", "2"), ("B", "1"), ("C", "3")}


def test_tree(spark, tmp_path):
    files = spark.createDataFrame([("a/x.md", "X"), ("y.md", None)], "path string, content string")
    assert sinks.write_tree(files, str(tmp_path)) == 2
    assert sorted(r["text"] for r in readers.text_tree(spark, str(tmp_path)).collect()) == ["", "X"] or (tmp_path / "a/x.md").read_text() == "X"
    (tmp_path / "v.mp4").write_bytes(b"1")
    assert readers.media_files(spark, str(tmp_path)).count() == 1


def test_sections_and_entries(spark):
    assert one(spark, sinks.section_replaced("m", "KI", F.lit("new $1")), m="# T\n\n## KI\n\nold\n\n## Z\n") == "# T\n\n## KI\n\nnew $1\n\n## Z\n"
    assert one(spark, sinks.section_replaced("m", "KI", F.lit("n")), m="# T\n") .endswith("## KI\n\nn\n")
    a, b = (spark.createDataFrame(r, "domain string, v int") for r in ([("x", 1), ("y", 1)], [("x", 2)]))
    assert {tuple(r) for r in sinks.replace_entries(a, b, "domain").collect()} == {("x", 2), ("y", 1)}
    img = spark.createDataFrame([("data:image/png;base64,QUJD",), ("http://x",)], "u string")
    assert [bytes(r["bytes"]) for r in sinks.decoded_images(img, "u").collect()] == [b"ABC"]


def test_url_functions(spark):
    assert one(spark, urls.normalize_href("h", "d"), h="//x/y", d="a") == "https://x/y"
    assert one(spark, urls.normalize_href("h", "d"), h="javascript:1", d="a") is None
    assert one(spark, urls.normalize_href("h", "d"), h="/wiki/A", d="") == "/wiki/A"
    assert one(spark, urls.relative_path("a", "b", F.lit("f.md")), a="x/y", b="x/z") == "../z/f.md"
    assert one(spark, urls.relative_path("a", "b", F.lit("f.md")), a="", b="x") == "x/f.md"
    assert one(spark, urls.percent_decode("h"), h="a%20b+c") == "a b+c"
    assert one(spark, urls.set_query("u", "page", F.lit(3)), u="https://a/b?page=1&x=2#f") == "https://a/b?page=3&x=2"
    import re

    assert re.match(urls.glob_regex("https://*.a/**"), "https://x.a/b/c") and not re.match(urls.glob_regex("/a/*"), "/a/b/c")
    assert re.match(urls.parameter_regex("/wiki/:name"), "/wiki/x") and not re.match(urls.parameter_regex("/wiki/:name"), "/wiki/x/y")


def test_text_functions(spark):
    assert one(spark, text.deduplicate_words("t"), t="the the cat cat cat sat") == "the cat sat"
    assert one(spark, text.strip_frontmatter("t"), t="---\na: 1\n---\nb") == "b"
    assert one(spark, text.merge_tooltips("t"), t='<span class="tooltip"><a href="/a"></a><a href="/a">A</a></span>') == '<a href="/a">A</a>'
    assert one(spark, text.nfkc("t"), t="Ａ－ｂ  ①") == "a b 1"
    assert one(spark, text.strip_video("t"), t='x<iframe src="//youtube.com/e"></iframe>y') == "xy"


def test_quality(spark):
    rows = [(1, "---\nt: x\n---\n", "<img src=a>"), (2, "# A\n\n![i](/images/x)", None), (3, None, None)]
    got = {(r["doc"], r["check"]) for r in quality.checks(spark.createDataFrame(rows, "id int, md string, html string"), "id", "md", "html").where("failed").collect()}
    assert {(1, "S1"), (1, "S4"), (2, "S1"), (2, "S11"), (3, "S4")} <= got
    runs = quality.navigation_runs(spark.createDataFrame([(1, "- Home\n- [Search](x)\n\n- Help\n- Menu\n- Login"), (2, "")], "id int, md string"), "id", "md")
    assert {tuple(r) for r in runs.collect()} == {(1, 2), (2, 0)}


def test_crawl(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 4), (9, 9), (4, None)], "source long, target long")
    seeds = spark.createDataFrame([(1,), (1,)], "page long")
    assert {tuple(r) for r in crawl.reach(edges, seeds).collect()} == {(1, 0), (2, 1), (4, 1), (3, 2)}
    assert crawl.reach(edges, seeds, max_pages=2).count() == 2


def test_lifecycle(spark):
    t = lambda n: dt.datetime(2024, 1, 1, n)
    rows = [(1, t(1), "resolved"), (1, t(2), "in_progress"), (1, t(3), "resolved"), (2, t(1), "wontfix"), (2, t(2), "in_progress"), (3, t(1), "resolved")]
    e = spark.createDataFrame(rows, "issue long, ts timestamp, state string")
    assert {tuple(r) for r in lifecycle.last_state(e, "issue", "ts", "state").collect()} == {(1, "resolved", 2), (2, "wontfix", 1), (3, "open", 0)}


def test_streams(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "domain string, ts timestamp, http_status int, error_type string, status string, issue long, state string"
    rows = [("a", t(1), 429, None, "failure", 1, "in_progress"), ("a", t(2), 429, None, "failure", 1, "resolved"), ("a", t(9), 429, None, "failure", 2, "resolved"), ("b", t(9), 200, None, "success", 1, "open")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = pipelines.new_pages(spark, src, spark.read.parquet(src).schema)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sorted(r["n"] for r in run(pipelines.cooldowns(stream), "complete", "cool")) == [1, 2]
    assert {(r["issue"], r["state"], r["n_steps"]) for r in run(pipelines.issue_states(stream.select("issue", "ts", "state")), "update", "states")} == {(1, "resolved", 2), (2, "open", 0)}
    q = pipelines.convert_incrementally(stream, lambda b: b.groupBy("domain").count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_numbered(spark):
    from siltweave.operators.ranks import numbered

    rows = [(g, i) for g in ("a", None) for i in range(0, 500, 7)]
    df = spark.createDataFrame(rows, "g string, i int")
    got = {(r["g"], r["i"]): r["rn"] for r in numbered(df, ["g"], "i", F.floor(F.col("i") / 50)).collect()}
    assert got == {(g, i): i // 7 + 1 for g, i in rows}
