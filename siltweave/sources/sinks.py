"""Writers: page cache upserts, output trees, reports and registries (SNK1 to SNK8, SNK10 to SNK12)."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.session import cut, small_side


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def upsert_cache(new: DataFrame, path: str) -> None:
    """Rows of new pages into the cache, newest version of (platform, domain, title) wins.

    Only the partitions that get rows are read and replaced; a crash before the commit leaves the old ones.
    A cache that isn't there counts as empty, one that can't be read is an error. Versions are compared
    by key and time alone; bodies are not shuffled but for the new rows.
    """
    spark = new.sparkSession
    keys = ["platform", "domain", "title"]
    new = new.withColumn("fetched_at", F.coalesce("fetched_at", F.current_timestamp()))
    rest = [c for c in new.columns if c not in keys]
    order = F.struct("fetched_at", F.xxhash64(*[c for c in rest if c != "fetched_at"]))
    new = cut(new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*"))
    if _exists(spark, path):
        touched = small_side(new.select("platform", "domain").distinct())
        old = spark.read.parquet(path).join(touched, ["platform", "domain"], "left_semi")
        arrived = small_side(new.select(*keys, F.col("fetched_at").alias("_new")))
        later = old.select(*keys, "fetched_at").join(arrived, keys).where(F.col("fetched_at") > F.col("_new")).select(*keys).distinct()
        later = cut(later)  # the few pages whose stored version is newer
        new = new.join(later, keys, "left_anti")
        kept = old.join(small_side(new.select(*keys)), keys, "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("platform", "domain").parquet(path)


def write_tree(files: DataFrame, root: str) -> int:
    """(path, content) rows as files below ``root``, a folder that all executors mount (a path or a file: address); returns their number.

    Each file is written under a temporary name and renamed, so a repeated task leaves no half file.
    """

    if re.match(r"(?!file:)[A-Za-z][\w+.-]*:", root):
        raise ValueError(f"no mounted folder: {root}")
    root = re.sub("^file:/*", "/", root)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                target = os.path.normpath(os.path.join(root, path))
                if not target.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"path leaves the tree: {path}")
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(f"{target}.{os.getpid()}.tmp", "w", encoding="utf-8") as f:
                    f.write(content or "")
                os.replace(f"{target}.{os.getpid()}.tmp", target)
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_json(df: DataFrame, path: str) -> None:
    """Results, reports, manifests and summaries as JSON lines."""
    df.write.mode("overwrite").json(path)


def with_source(title, url, markdown) -> Column:
    """A text with its title and a source line."""
    return F.concat(F.lit("# "), F.col(title), F.lit("\n\n> Source: "), F.col(url), F.lit("\n\n"), F.col(markdown), F.lit("\n"))


def replace_entries(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A registry in which new entries take the place of old ones with the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def section_replaced(markdown, heading: str, body) -> Column:
    """A Markdown text whose section of that heading has a new body; appended where it is missing."""
    m, part = F.col(markdown), F.concat(F.lit(f"## {heading}\n\n"), body, F.lit("\n"))
    pattern = rf"(?s)(^|\n)## {heading}\n.*?(?=\n## |\z)"
    safe = F.regexp_replace(part, r"([\\$])", r"\\$1")
    return F.when(m.rlike(pattern), F.regexp_replace(m, F.lit(pattern), F.concat(F.lit("$1"), safe))).otherwise(F.concat(F.rtrim(m), F.lit("\n\n"), part))


def decoded_images(df: DataFrame, url: str, limit: int = 2 << 20) -> DataFrame:
    """Stored data URLs as (type, bytes), none larger than ``limit``."""
    kind = F.regexp_extract(url, "^data:(image/[a-z+.-]+);base64,", 1)
    data = F.try_to_binary(F.regexp_extract(url, "^data:image/[a-z+.-]+;base64,(.*)$", 1), F.lit("base64"))
    return df.where(kind != "").select("*", kind.alias("type"), data.alias("bytes")).where(F.length("bytes").between(1, limit))


def image_references(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """(…, image) of the Markdown images whose target fits a pattern."""
    targets = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1))
    return df.withColumn("image", F.explode(F.array_distinct(F.filter(targets, lambda x: x.rlike(pattern)))))


def registry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
