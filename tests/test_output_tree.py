"""Links of an output tree, document links, storage and matching on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltweave import session
from siltweave.functions import urls
from siltweave.operators import assign, crawl, markdown, media
from siltweave.plans.link_queries import document_resolved, fixed
from siltweave.plans.selection_queries import exclude_pattern, page_pattern
from siltweave.sources import readers, sinks


def test_normalized(spark):
    df = spark.createDataFrame([("a/../b/x.md", "b/x.md"), ("./a/./x.md", "a/x.md"), ("../a/x.md", "../a/x.md"), ("a/b/../../x.md", "x.md"), ("../../x", "../../x"), ("", "")], "p string, want string")
    assert all(r.got == r.want for r in df.select(urls.normalized("p").alias("got"), "want").collect())


def test_fixed_links(spark):
    tree = spark.createDataFrame([("d", "Big Boss", "bosses", "Big_Boss.md", "bosses/Big_Boss.md"), ("d", "Home", "", "Home.md", "Home.md"), ("d", "A (b)", "items", "A_(b).md", "items/A_(b).md")], "domain string, title string, dir string, file string, path string")
    cases = [
        ("items", "/wiki/Big_Boss?action=edit#Loot", "../bosses/Big_Boss.md#Loot"), ("items", "/wiki/Big_Boss#Loot", "../bosses/Big_Boss.md#Loot"), ("", "https://d/wiki/Big%20Boss", "bosses/Big_Boss.md"), ("items", "https://other/wiki/Big_Boss", "https://other/wiki/Big_Boss"),
        ("items", "/wiki/Category:Bosses", "/wiki/Category:Bosses"), ("items", "/wiki/Nobody", "/wiki/Nobody"), ("items", "../bosses/Big_Boss.md", "../bosses/Big_Boss.md"), ("items", "../p/Big_Boss.md", "../bosses/Big_Boss.md"), ("bosses", "../p/Home.md", "../Home.md"),
        ("items", "x.md.md", "x.md"), ("bosses", "../q/A_(b).md", "../items/A_(b).md"), ("items", "#top", "#top"),
    ]
    hrefs = spark.createDataFrame([(k, "d", s, h) for k, (s, h, _) in enumerate(cases)], "n int, domain string, source_dir string, href string")
    got = {r.n: r.fixed for r in fixed(hrefs, tree).collect()}
    assert got == {k: w for k, (_, _, w) in enumerate(cases)}


def test_document_links(spark):
    pages = spark.createDataFrame([("d", "Page_12.html", "Twelve.md"), ("d", "intro.html", "Intro.md")], "domain string, base string, file string")
    cases = {"https://x/y": (1, "https://x/y"), "#a": (1, "#a"), "../Pages/Page_12.html": (2, "Twelve.md"), "../Pages/Page_13.html": (2, "R/Pages/Page_13.html"), "../title.html": (3, "R/title.html"), "../intro.html": (4, "Intro.md"), "../k/other.html": (4, "R/k/other.html"), "Pages/Page_12.html": (5, "Twelve.md"), "x/intro.html": (6, "Intro.md"), "x/none.html": (6, "R/x/none.html")}
    got = document_resolved(spark.createDataFrame([("d", h) for h in cases], "domain string, href string"), pages, F.lit("R/"))
    assert {r.href: (r.rule, r.resolved) for r in got.collect()} == cases


def test_patterns(spark):
    df = spark.createDataFrame([("https://a/docs/v1/x",), ("https://a/docs/y",)], "u string")
    hit = lambda c: [r[0] for r in df.select(c).collect()]
    assert hit(page_pattern(F.col("u"), "exact:https://a/docs/y")) == [False, True]
    assert hit(page_pattern(F.col("u"), "regex:/v\\d/")) == [True, False]
    assert hit(page_pattern(F.col("u"), "/docs/:name")) == [False, True]
    assert hit(page_pattern(F.col("u"), "https://a/docs/:name")) == [False, True]
    assert hit(exclude_pattern(F.col("u"), "exact:/docs/**")) == [True, True]
    assert hit(exclude_pattern(F.col("u"), "exact:/docs/*")) == [False, True]


def test_media_over_whole_collections(spark):
    posts = spark.createDataFrame([("c", 1, "Red Dragon"), ("c", 2, "red-dragon"), ("c", 3, "The Long Winter Night"), ("c", 4, "Harvest Moon"), ("c", 5, "x")], "collection string, post long, title string")
    files = spark.createDataFrame([("c", "/1", "Red_Dragon.mp4"), ("c", "/2", "RedDragon.mkv"), ("c", "/3", "Long Winter.mp4"), ("c", "/4", "harvest moon_1080p.mp4"), ("d", "/5", "x.mp4")], "collection string, path string, name string")
    assert {(r.post, r.path, r.tier) for r in media.matched(posts, files).collect()} == {(1, "/1", 1), (2, "/2", 1), (4, "/4", 2), (3, "/3", 3)}


def test_category_scores_beyond_any_cap(spark):
    tags = spark.createDataFrame([(1, "Big Items"), (2, "it"), (3, "none")], "page int, category string")
    keys = spark.createDataFrame([(f"key{k}", "k", k) for k in range(12_000)] + [("items", "items", 12_000)], "key string, directory string, ord int")
    assert {(r.page, r.directory, r.score) for r in assign.category_scores(tags, keys).collect()} == {(1, "items", 1), (2, "items", 1), (3, "misc", 0)}


def test_card_stats():
    page = '<div class="druid-infobox"><div class="druid-row-Name"><div class="druid-toggleable-data" data-druid-tab-key="Base">Hit</div><div class="druid-toggleable-data" data-druid-tab-key="Upgraded">Hit+</div></div><div class="druid-row-Type">Attack</div></div>'
    assert markdown.card_stats(page).split("\n")[2:] == ["| **Name** | Hit | Hit+ |", "| **Type** | Attack | Attack |"]
    assert markdown.card_stats("<p>no box</p>") == markdown.card_stats(None) == ""


def test_upsert_keeps_what_is_newer(spark, tmp_path):
    schema = "platform string, domain string, title string, html string, fetched_at timestamp"
    day = lambda n: dt.datetime(2024, 1, n)
    path = str(tmp_path / "cache")
    sinks.upsert_cache(spark.createDataFrame([("m", "d", "A", "new", day(9)), ("m", "d", "B", "b", day(1))], schema), path)
    sinks.upsert_cache(spark.createDataFrame([("m", "d", "A", "old", day(2)), ("m", "d", "B", "b2", day(3))], schema), path)
    assert {(r.title, r.html) for r in readers.page_cache(spark, path, "m").collect()} == {("A", "new"), ("B", "b2")}
    bad = tmp_path / "broken" / "platform=m" / "domain=d"
    bad.mkdir(parents=True)
    (bad / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        sinks.upsert_cache(spark.createDataFrame([("m", "d", "A", "x", day(1))], schema), str(tmp_path / "broken"))
    assert (bad / "part.parquet").exists()


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return super().get(key, default)

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert session.checkpoint_folder(Session(spark_checkpoint_dir="file:/x/", spark_master="spark://h")) == "file:/x"
    assert session.checkpoint_folder(Session(spark_master="local[4]"))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            session.checkpoint_folder(Session(spark_master=master))


def test_small_side_is_measured_in_bytes(spark):
    df = session.cut(spark.createDataFrame([("x" * 100,)] * 50, "s string"))
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(session.small_side(df, 10_000)).lower()
    assert "broadcast" not in plan(session.small_side(df, 1_000)).lower()


def test_crawl_budget(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "e")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "page string")
    assert {tuple(r) for r in crawl.reach(edges, seeds, max_pages=4).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_progress():
    from types import SimpleNamespace

    from siltweave.streaming.pipelines import Progress

    seen = []
    p = Progress(seen.append, every=10)
    p.onQueryStarted(None)
    for n in (4, 4, 4, 20):
        p.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=n)))
    assert seen == [12, 32]


def test_crawl_budget_covers_seeds(spark):
    edges = spark.createDataFrame([("a", "x")], "source string, target string")
    seeds = spark.createDataFrame([("c",), ("a",), ("b",), ("a",)], "page string")
    assert {tuple(r) for r in crawl.reach(edges, seeds, max_pages=2).collect()} == {("a", 0), ("b", 0)}
