"""Queries whose cases the test tables lack, on tables of their own."""

from siltweave.plans import catalog


def test_redirect_marks(spark, tmp_path):
    rows = [
        (1, "d", "Old Name", '<div class="redirectMsg"><p>Redirect to:</p><a href="/wiki/New_N%C3%A4me" title="x">x</a></div>', None),
        (2, "d", "B", '<div class="redirectMsg">nowhere</div>', None),
        (3, "d", "C", None, "#REDIRECT [[Target Page#Part]]"),
        (4, "d", "D", None, "Text about #redirect [[X]]"),
        (5, "d", "E", "<p>x</p>", None),
        (6, None, None, None, None),
    ]
    spark.createDataFrame(rows, "cache_id long, domain string, title string, html string, wikitext string").write.parquet(str(tmp_path / "raw_pages.parquet"))
    got = {r.cache_id: r.target for r in catalog.QUERIES["redirect_marks"](spark, str(tmp_path)).collect()}
    assert got == {1: "New Näme", 2: "", 3: "Target Page", 4: None, 5: None, 6: None}


def test_local_images(spark, tmp_path):
    import hashlib

    rows = [(1, "a ![x](https://h/images/a.png) ![](/images/b.jpg) [l](/images/c)"), (2, "no image"), (3, None)]
    spark.createDataFrame(rows, "result_id long, content string").write.parquet(str(tmp_path / "results.parquet"))
    got = {r.result_id: (r.digest, r.n_images) for r in catalog.QUERIES["local_images"](spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {1: (digest("a ![x](../images/a.png) ![](../images/b.jpg) [l](/images/c)"), 2), 2: (digest("no image"), 0)}


def test_profile_rules(spark, tmp_path):
    page = "Jump to navigation\nPrivacy policy\nText () here[edit]\n{\"a\": 1}\n[[Category:X]]\n[![t](a.png)](p) and [l](u \"title\")\n| k | | | | | v |\n[File:Y]"
    spark.createDataFrame([(1, page)], "cache_id long, wikitext string").write.parquet(str(tmp_path / "raw_pages.parquet"))
    got = {r.profile: r.n_chars for r in catalog.QUERIES["profile_filters"](spark, str(tmp_path)).collect()}
    full = "Text here\n![t](a.png) and [l](u)\n| k | v |"
    assert got["full"] == len(full)
    assert got["plain"] > got["links"] > got["full"]
