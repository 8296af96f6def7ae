"""Matching names of media files to posts, each file at most once."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltweave.session import cut

_SUFFIX = re.compile(r"(?:[\s_.-]+(?:\d{3,4}p|[48]k|x26[45]|h26[45]|hevc|web|final|v\d+|part\s?\d+|\(\d+\)))+$", re.I)


def folded(name: str) -> str:
    """Compatibility form, lower case, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", name or "").lower() if c.isalnum())


def stripped(name: str) -> str:
    """The folded name without quality and version suffixes."""
    return folded(_SUFFIX.sub("", re.sub(r"\.\w{2,4}$", "", name or "")))


def pairs(posts: list[tuple[int, str]], files: list[tuple[str, str]]) -> list[tuple[int, str, int]]:
    """(post, path, tier) in post order: equal names; equal stripped names of 8 letters; one name in
    the other; one stripped name in the other."""
    left = [(p, folded(re.sub(r"\.\w{2,4}$", "", n)), stripped(n)) for p, n in files]
    out = []
    for post, title in posts:
        a, b = folded(title), stripped(title)
        tests = (
            lambda f, s: f == a and a != "",
            lambda f, s: s == b and len(b) >= 8,
            lambda f, s: min(len(f), len(a)) >= 8 and (f in a or a in f),
            lambda f, s: min(len(s), len(b)) >= 8 and (s in b or b in s),
        )
        for tier, test in enumerate(tests, 1):
            hit = next((k for k, (_, f, s) in enumerate(left) if test(f, s)), None)
            if hit is not None:
                out.append((post, left.pop(hit)[0], tier))
                break
    return out


def _names(df: DataFrame, key: str, name: str, cut_ending: bool) -> DataFrame:
    """(collection, key, f, s): folded and stripped names, by an Arrow pass over names alone."""

    @F.pandas_udf("struct<f:string,s:string>")
    def both(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"f": [folded(re.sub(r"\.\w{2,4}$", "", n or "") if cut_ending else n) for n in names], "s": [stripped(n) for n in names]})

    return df.select("collection", key, both(F.col(name)).alias("n")).select("collection", key, "n.f", "n.s")


def _one_to_one(pairs_: DataFrame) -> DataFrame:
    """(collection, post, path) of candidates, each post and path once: the pairs that are each other's first are taken, until none is left."""
    left, out = cut(pairs_.distinct()), None
    while True:
        a = left.groupBy("collection", "post").agg(F.min("path").alias("path"))
        b = left.groupBy("collection", "path").agg(F.min("post").alias("post"))
        took = cut(a.join(b, ["collection", "post", "path"]))
        if took.isEmpty():
            return out if out is not None else took
        out = took if out is None else out.unionByName(took)
        left = cut(left.join(took.select("collection", "post"), ["collection", "post"], "left_anti").join(took.select("collection", "path"), ["collection", "path"], "left_anti"))


def _equal(posts: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """Posts and files of one name paired in order, the first with the first."""
    rank = lambda k: F.row_number().over(Window.partitionBy("collection", by).orderBy(k))
    return posts.withColumn("r", rank("post")).join(files.withColumn("r", rank("path")), ["collection", by, "r"]).select("collection", "post", "path")


def _inside(short: DataFrame, long: DataFrame, by: str, key: str) -> DataFrame:
    """Rows of ``short`` whose name of at least 8 letters is part of one of ``long``: an equality join on all such parts."""
    n = F.length(by)
    parts = long.where(n >= 8).select("collection", key, by, F.explode(F.sequence(F.lit(1), n - 7)).alias("i")).select("collection", key, by, "i", F.explode(F.sequence(F.lit(8), n - F.col("i") + 1)).alias("k"))
    parts = parts.select("collection", key, F.substring(F.col(by), F.col("i"), F.col("k")).alias(by)).distinct()
    return short.where(n >= 8).join(parts, ["collection", by]).select("collection", "post", "path")


def matched(posts: DataFrame, files: DataFrame) -> DataFrame:
    """(collection, post, path, tier) for posts (collection, post, title) and files (collection, path, name), each post and file once.

    Tier by tier: equal names, equal stripped names of 8 letters, one name in the other, one stripped name in the other. Every
    tier is an equality join, so a collection may be as large as a site.
    """
    p, f, out = cut(_names(posts, "post", "title", False)), cut(_names(files, "path", "name", True)), None
    for tier, by in ((1, "f"), (2, "s"), (3, "f"), (4, "s")):
        if tier == 1:
            found = _equal(p.where("f <> ''"), f, "f")
        elif tier == 2:
            found = _equal(p.where(F.length("s") >= 8), f, "s")
        else:
            found = _one_to_one(_inside(p, f, by, "path").unionByName(_inside(f, p, by, "post").select("collection", "post", "path")))
        found = cut(found.withColumn("tier", F.lit(tier)))
        out = found if out is None else out.unionByName(found)
        p = p.join(found.select("collection", "post"), ["collection", "post"], "left_anti")
        f = f.join(found.select("collection", "path"), ["collection", "path"], "left_anti")
    return out
