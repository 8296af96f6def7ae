"""The queries of the training-text operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltweave.io import table
from siltweave.llm import leakage, main_content, markup, near_duplicates, packing, reading_level, repeated_lines, residue
from siltweave.session import small_side


def _residues(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages").withColumn("_fragment", F.col("platform") == "mediawiki")
    html = residue.residues(pages, "cache_id", "html", html=True, fragment="_fragment")
    content = residue.residues(table(spark, d, "results"), "result_id", "content")
    return html.select(F.lit("html").alias("src"), "*").unionByName(content.select(F.lit("content").alias("src"), "*"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _residues(spark, d).select("src", "rec_id").distinct()


def p1_findings(spark: SparkSession, d: str) -> DataFrame:
    """Records by source and kind of finding."""
    return _residues(spark, d).distinct().groupBy("src", "finding").agg(F.count("*").alias("n_records"))


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The converted records that are left when those with findings are taken out."""
    results = table(spark, d, "results").where(F.length("content") > 0)
    bad = residue.residues(results, "result_id", "content").select(F.col("rec_id").alias("result_id")).distinct()
    return results.select("result_id", "domain", "title").join(bad, "result_id", "left_anti")


def _marked_up(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, str, str]]:
    pages = table(spark, d, "raw_pages")
    return [
        ("wikitext", pages, "cache_id", "wikitext"),
        ("html", pages.where("platform = 'mediawiki'"), "cache_id", "html"),
        ("content", table(spark, d, "results"), "result_id", "content"),
    ]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([markup.elements(df, key, text, src).select(F.lit(src).alias("src"), "rec_id", "kind", "elem") for src, df, key, text in _marked_up(spark, d)])


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every marked-up document as clean text."""
    return _union([markup.cleaned(df, key, text, src).select(F.lit(src).alias("src"), "rec_id", "text") for src, df, key, text in _marked_up(spark, d)])


def _contents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, d, "results"), "result_id", "content", 12, min_chars=300)


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates.near_duplicates(table(spark, d, "manifest"), "page_seq", "title", 3, group="domain")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    content, title = near_duplicates.pairs_of(*_contents(spark, d)), near_duplicates.pairs_of(*_titles(spark, d))
    return content.select(F.lit("content").alias("src"), "*").unionByName(title.select(F.lit("title").alias("src"), "*")).distinct()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row a record with its class."""
    content = near_duplicates.classes_of(table(spark, d, "results"), "result_id", "content", 12, min_chars=300)
    title = near_duplicates.classes_of(table(spark, d, "manifest"), "page_seq", "title", 3, group="domain")
    return content.select(F.lit("content").alias("src"), "*").unionByName(title.select(F.lit("title").alias("src"), "*"))


def _sequences(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return repeated_lines.prefix_span(table(spark, d, "results"), "result_id", "domain", "content")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    edges, found, _ = _sequences(spark, d)
    lines = found.join(small_side(repeated_lines.sequence_lines(edges)), ["src", "key"], "left_semi")
    return lines.select(F.col("doc").alias("result_id"), "line_no").distinct()


def p4_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Frequent line sequences by domain and length."""
    edges, _, needs = _sequences(spark, d)
    return repeated_lines.sequence_lengths(edges, needs).withColumnRenamed("source", "domain")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every content without the lines its domain repeats."""
    results = table(spark, d, "results")
    edges, _, needs = _sequences(spark, d)
    patterns = repeated_lines.sequence_lines(edges).join(small_side(needs.select("src", "source")), "src").select("source", F.array("key").alias("keys"))
    return repeated_lines.without_repeated(results, patterns, "result_id", "domain", "content").select("result_id", "content")


def _articles(spark: SparkSession, d: str, chars: int | None) -> DataFrame:
    pages = table(spark, d, "raw_pages")
    whole = main_content.article_blocks(pages.where("platform = 'chrome-cdp'"), "html", ["cache_id"], chars)
    rendered = main_content.article_blocks(pages, "rendered_html", ["cache_id"], chars)
    return whole.select(F.lit("html").alias("src"), "*").unionByName(rendered.select(F.lit("rendered_html").alias("src"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d, main_content.BLOCK_CHARS)


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """The article's blocks in full."""
    return _articles(spark, d, None)


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    sizes = table(spark, d, "containers").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    used = p6_containers(spark, d).groupBy("container_kind").agg(F.count_distinct("container_id").alias("n_containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("n_tokens"))
    return used.join(F.broadcast(sizes), "container_kind").select("container_kind", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity"))).alias("fill"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each leaked item with its place in document and item."""
    return _leaks(spark, d)


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold no evaluation text."""
    return leakage.without_leaks(table(spark, d, "documents").select("doc_id", "lang", "source", "kind", "title", "text"), _leaks(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "reading_labels")
    rated = labels.select("doc_id").where("doc_id is not null").distinct()
    return reading_level.levels(docs.where("n_chars >= 400"), labels, rated_from=docs).join(rated, "doc_id", "left_anti").distinct()


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by level."""
    return reading_level.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).groupBy("level").agg(F.count("*").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_findings, p1_kept, p2_found, p2_clean, p3_found, p3_classes, p4_found, p4_sequences, p4_clean, p5_found, p5_text, p6_containers, p6_fill, p7_found, p7_matches, p7_clean, p8_found, p8_profile)}
