"""Sitemaps, manifests, page caches, site strategies and output trees (SRC8 to SRC13, SRC18, SRC19, SRC22)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Manifest entries of all origins in one schema; missing fields are null.
MANIFEST = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("pageid", T.LongType()),
        T.StructField("ns", T.IntegerType()),
        T.StructField("url", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("source_categories", T.ArrayType(T.StringType())),
        T.StructField("assigned_category", T.StringType()),
        T.StructField("assignment_method", T.StringType()),
        T.StructField("is_list_page", T.BooleanType()),
        T.StructField("target_directory", T.StringType()),
        T.StructField("target_filename", T.StringType()),
        T.StructField("page_type", T.StringType()),
    ]
)
_LOC = r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]]*?)\s*(?:\]\]>)?\s*</loc>"


def sitemap_kind(xml) -> Column:
    """``index``, ``urlset`` or ``parse_error``."""
    x = F.coalesce(F.col(xml), F.lit(""))
    return F.when(x.rlike("(?i)<sitemapindex[ >]"), "index").when(x.rlike("(?i)<urlset[ >]"), "urlset").otherwise("parse_error")


def sitemap_locations(xml) -> Column:
    """The http(s) locations of a sitemap, in order."""
    return F.filter(F.regexp_extract_all(F.coalesce(F.col(xml), F.lit("")), F.lit(_LOC), F.lit(1)), lambda u: u.rlike("^https?://"))


def resolve_sitemaps(sitemaps: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(urls, errors) of a stored sitemap collection (url, xml, http_code) from its root.

    One level of indexes is followed; an index in an index, a failed fetch and unreadable XML are
    errors with a reason; URLs come once, in order of first sight.
    """
    s = sitemaps.withColumn("kind", sitemap_kind("xml")).withColumn("locs", sitemap_locations("xml"))
    top = s.where(F.col("url") == root)
    subs = top.where("kind = 'index'").select(F.posexplode("locs").alias("pos", "sub"))
    joined = subs.join(s, subs["sub"] == s["url"], "left")
    reason = F.when(F.col("url").isNull(), "not_fetched").when(F.coalesce("http_code", F.lit(200)) >= 400, F.concat(F.lit("http_"), F.col("http_code").cast("string"))).when(F.col("kind") == "index", "nested_index").when(F.col("kind") == "parse_error", "parse_error")
    good = joined.where(reason.isNull()).select("pos", F.posexplode("locs").alias("at", "loc"))
    flat = top.where("kind = 'urlset'").select(F.lit(-1).alias("pos"), F.posexplode("locs").alias("at", "loc"))
    firsts = good.unionByName(flat).groupBy("loc").agg(F.min(F.struct("pos", "at")).alias("seq"))
    return firsts.select(F.col("loc").alias("url"), "seq"), joined.where(reason.isNotNull()).select(F.col("sub").alias("url"), reason.alias("reason"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON manifest {"pages": [...]}; an older one lists bare URLs under "visited". ``seq`` keeps its order."""
    schema = T.StructType([T.StructField("pages", T.ArrayType(MANIFEST)), T.StructField("visited", T.ArrayType(T.StringType()))])
    raw = spark.read.schema(schema).json(path, multiLine=True)
    new = raw.select(F.posexplode("pages").alias("seq", "p")).select("seq", "p.*")
    old = raw.where("pages is null").select(F.posexplode("visited").alias("seq", "url"))
    return new.unionByName(old, allowMissingColumns=True)


def page_cache(spark: SparkSession, path: str, platform: str | None = None, domain: str | None = None) -> DataFrame:
    """The page cache; partitions are pruned by platform and domain."""
    df = spark.read.parquet(path)
    for name, value in (("platform", platform), ("domain", domain)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def text_tree(spark: SparkSession, path: str, suffix: str = "md") -> DataFrame:
    """(path, text) of every file below ``path`` with the suffix."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def media_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("mp4", "mkv", "webm"), depth: int = 5) -> DataFrame:
    """(path, length) of media files at most ``depth`` folders down; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    base = os.path.abspath(path)
    below = F.size(F.split(F.regexp_replace("path", f"^(?:file:)?/*{base.lstrip('/')}/", ""), "/"))
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$") & (below <= depth + 1))


def strategy(text: str) -> dict:
    """The front matter of a site strategy file: nested mappings, lists and scalars of the YAML subset such files use."""
    lines = text.split("\n")
    if not lines or lines[0].strip() != "---":
        return {}
    body = []
    for line in lines[1:]:
        if line.strip() == "---":
            break
        if line.strip() and not line.lstrip().startswith("#"):
            body.append((len(line) - len(line.lstrip()), line.strip()))

    def scalar(v: str):
        v = v.strip()
        if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"":
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        if v in ("true", "false"):
            return v == "true"
        if v in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    def read(k: int, indent: int):
        if k < len(body) and body[k][1].startswith("- "):
            out: list = []
            while k < len(body) and body[k][0] == indent and body[k][1].startswith("- "):
                item = body[k][1][2:]
                if ":" in item and not item.startswith(("'", '"', "[")) and item.split(":", 1)[1][:1] in ("", " "):
                    body[k] = (indent + 2, item)
                    value, k = read(k, indent + 2)
                else:
                    value, k = scalar(item), k + 1
                out.append(value)
            return out, k
        out = {}
        while k < len(body) and body[k][0] == indent and ":" in body[k][1]:
            key, _, value = body[k][1].partition(":")
            k += 1
            if value.strip():
                out[key.strip()] = scalar(value)
            elif k < len(body) and (body[k][0] > indent or body[k][0] == indent and body[k][1].startswith("- ")):
                out[key.strip()], k = read(k, body[k][0])
            else:
                out[key.strip()] = None
        return out, k

    return read(0, body[0][0])[0] if body else {}
