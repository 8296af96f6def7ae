"""Category assignment and scoring (AGG9, AGG10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assignment_chain(pages: DataFrame, priority: DataFrame, manual: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """A directory and the method that found it for each page.

    ``pages``: page, title, source_categories, categories. ``priority``: name, alias, rank, directory
    (one row an alias; the name is its own alias). ``manual``: title, directory. ``taxonomy``: tag, top.

    Precedence: manual; the only priority name among the source categories; the first priority name
    that the page's tags match by name or alias; a tag whose taxonomy top is a priority name; the
    first priority name among the source categories; misc. The dimensions are configuration and are
    left to the optimiser's size check. Everything a page needs is one aggregate over its exploded
    categories, so pages are shuffled once.
    """
    manual = manual.groupBy("title").agg(F.min("directory").alias("manual"))
    names = priority.where("alias = name").select("name", F.col("rank").alias("name_rank"), F.col("directory").alias("name_dir"))
    src = pages.select("page", F.explode(F.array_distinct("source_categories")).alias("name")).join(names, "name")
    by_src = src.groupBy("page").agg(F.count("*").alias("n_src"), F.min(F.struct("name_rank", "name_dir")).alias("src"))
    tags = pages.select("page", F.posexplode(F.array_distinct("categories")).alias("at", "alias"))
    hits = tags.join(priority.select("alias", "rank", "directory"), "alias").where("directory is not null")
    by_tag = hits.groupBy("page").agg(F.min(F.struct("rank", "directory")).alias("tag"))
    tops = tags.withColumnRenamed("alias", "tag_name").join(taxonomy, F.col("tag_name") == F.col("tag")).join(names.withColumnRenamed("name", "top"), "top").where("name_dir is not null")
    by_top = tops.groupBy("page").agg(F.min(F.struct("at", "name_dir")).alias("top"))
    out = pages.select("page", "title").join(manual, "title", "left").join(by_src, "page", "left").join(by_tag, "page", "left").join(by_top, "page", "left")
    only = F.when((F.col("n_src") == 1), F.col("src.name_dir"))
    method = (
        F.when(F.col("manual").isNotNull(), "manual")
        .when(only.isNotNull(), "source_category_match")
        .when(F.col("tag").isNotNull() | F.col("top").isNotNull(), "mw_category_match")
        .when(F.col("src.name_dir").isNotNull(), "source_category_fallback")
        .otherwise("default")
    )
    return out.select("page", F.coalesce("manual", only, F.col("tag.directory"), F.col("top.name_dir"), F.col("src.name_dir"), F.lit("misc")).alias("directory"), method.alias("method"))


def _parts(df: DataFrame, whole: str) -> DataFrame:
    """Each value of ``whole`` with each of its substrings (``part``)."""
    n = F.length(whole)
    starts = df.select("*", F.explode(F.sequence(F.lit(1), n)).alias("_i"))
    return starts.select("*", F.explode(F.sequence(F.lit(1), n - F.col("_i") + 1)).alias("_n")).select(*df.columns, F.substring(F.col(whole), F.col("_i"), F.col("_n")).alias("part")).distinct()


def category_scores(tags: DataFrame, keys: DataFrame) -> DataFrame:
    """The best directory of each page: 2 for a category equal to a key, 1 where one contains the other.

    ``tags``: page, category. ``keys``: key, directory, ord. Each distinct category is scored once; that one
    contains the other is an equality join on its substrings. Ties go to the lower ord; pages without a score get misc.
    """
    names = tags.select("category").distinct().withColumn("c", F.lower(F.translate("category", " ", "_"))).where("c <> ''")
    keys = keys.withColumn("k", F.lower("key")).where("k <> ''")
    pairs = _parts(names.select("c").distinct(), "c").join(keys.select(F.col("k").alias("part")).distinct(), "part").select("c", F.col("part").alias("k"))
    pairs = pairs.unionByName(_parts(keys.select("k").distinct(), "k").join(names.select(F.col("c").alias("part")).distinct(), "part").select(F.col("part").alias("c"), "k")).distinct()
    scored = names.join(pairs, "c").join(keys, "k").select("category", "directory", "ord", F.when(F.col("c") == F.col("k"), 2).otherwise(1).alias("points"))
    totals = tags.join(scored, "category").groupBy("page", "directory").agg(F.sum("points").alias("score"), F.min("ord").alias("ord"))
    best = totals.groupBy("page").agg(F.max_by(F.struct("directory", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return tags.select("page").distinct().join(best, "page", "left").select("page", F.coalesce("b.directory", F.lit("misc")).alias("directory"), F.coalesce("b.score", F.lit(0).cast("long")).alias("score"))
