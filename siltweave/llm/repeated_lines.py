"""Problem 4: lines that many documents of one source repeat, mined with PrefixSpan and removed.

Each document is the sequence of its line identifiers (hashes of the folded lines), cut once. The first scan counts single
lines; then every document keeps only its frequent lines in order, and documents that keep the same ones are one sequence
with their number as weight. PrefixSpan projects these sequences on a prefix (what is left of each after the first place at
which the prefix ends), counts every line left in the projection, whether other lines lie in between or not, and projects
on each frequent one again, for all sources at once, until nothing is frequent. A pattern is frequent when at least
``MIN_DOCS`` and at least ``MIN_SHARE`` of the source's documents hold it.

Prefixes with the same projection have the same continuations. A projection is therefore a state that is grown once,
however many prefixes lead to it, and an edge is a frequent line that continues it: every path from ``ROOT`` is a frequent
sequence, and every frequent sequence is one path. A template of n lines has 2^n - 1 frequent sequences, but n states. Where
lines come and go independently of one another, states can be as many as sequences; none is dropped.

Lines are deleted that belong to a frequent sequence, single lines included, which are the lines of the edges.
:func:`mine` lists only sequences of frequent lines that follow one another, each with its lines.

Counting is two-stage (document and line first, then line), so a source or a line with a third of
all rows is summed on the map side. A source has at most 1 / MIN_SHARE times its mean number of
lines a document as frequent lines, so the table of those is small; it is broadcast only after
its rows have been counted.

Defined results: a null or empty content has no lines and does not count as a document; a null
source is a source of its own; several rows of one document id count once; lines with fewer than
``MIN_LETTERS`` letters are never removed; empty tables give empty results; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltweave.session import cut, small_side

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 12, 5, 0.1
#: The state of the empty prefix; a state whose sequences are all at their end is (0, 0).
ROOT = (1, 1)


def line_key(line: Column) -> Column:
    """128 bits of the line's letters in lower case; null below MIN_LETTERS letters."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(F.char_length(letters) >= MIN_LETTERS, F.unhex(F.md5(letters.cast("binary"))))


def lines(docs: DataFrame, doc_id: str, source: str, content: str) -> DataFrame:
    """(source, doc, line_no, key) of each line that can count."""
    cells = docs.where(F.length(content) > 0).select(_named(source).alias("source"), F.col(doc_id).cast("long").alias("doc"), F.posexplode(F.split(content, "\n")).alias("line_no", "line"))
    return cells.select("source", "doc", (F.col("line_no") + 1).alias("line_no"), line_key(F.col("line")).alias("key")).where("key is not null")


def _named(source: str) -> Column:
    return F.coalesce(F.col(source), F.lit("\0"))


def _cells(docs: DataFrame, doc_id: str, source: str, content: str) -> DataFrame:
    """(src, doc, line_no, key) of each line that can count, cut once; numbers stand for sources."""
    return cut(lines(docs, doc_id, source, content).select(F.xxhash64("source").alias("src"), "doc", "line_no", "key"))


def _needs(docs: DataFrame, doc_id: str, source: str, content: str, min_docs: int, min_share: float) -> DataFrame:
    """(src, source, need): in how many documents of a source a pattern must be; one row a source."""
    held = docs.where(F.length(content) > 0).groupBy(_named(source).alias("source")).agg(F.greatest(F.lit(min_docs), F.ceil(F.count_distinct(doc_id) * min_share - 1e-9)).alias("need"))
    return cut(held.select(F.xxhash64("source").alias("src"), "source", "need"))


def _frequent(rows: DataFrame, by: list[str], needs: DataFrame, min_docs: int, *also: Column) -> DataFrame:
    counted = rows.groupBy("src", *by).agg(F.count_distinct("doc").alias("n_docs"), *also)
    return cut(counted.where(F.col("n_docs") >= min_docs).join(small_side(needs.select("src", "need")), "src").where("n_docs >= need").drop("need"))


def frequent_lines(docs: DataFrame, doc_id: str, source: str, content: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(singles, marked, needs): the first level (src, key, n_docs), and its occurrences (src, doc, line_no, key)."""
    cells, needs = _cells(docs, doc_id, source, content), _needs(docs, doc_id, source, content, min_docs, min_share)
    singles = _frequent(cells, ["key"], needs, min_docs)
    return singles, cells.join(small_side(singles.select("src", "key")), ["src", "key"]), needs


def _state(a: Column, b: Column) -> Column:
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def _project(found: DataFrame, needs: DataFrame, min_docs: int) -> DataFrame:
    """The edges (src, state, key, n_docs, to): n_docs documents hold a prefix of ``state`` with ``key`` after it."""
    # repeated rows of a document count once
    ordered = found.where("doc is not null").select("src", "doc", "line_no", "key").distinct().groupBy("src", "doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "key"))).alias("lines"))
    held = ordered.groupBy("src", F.col("lines.key").alias("keys")).agg(F.count("*").alias("n"))
    held = held.withColumn("seq", F.unhex(F.md5(F.array_join(F.transform("keys", F.hex), "").cast("binary"))))
    places = cut(held.select("src", "seq", "n", (F.size("keys") - 1).alias("end"), F.posexplode("keys").alias("at", "key")))
    need = small_side(needs.select("src", "need"))
    following = places.withColumn("state", _state(*map(F.lit, ROOT)))
    left = F.col("place.at") < F.col("place.end")
    known = None
    while True:
        rows = cut(following.groupBy("src", "state", "key", "seq").agg(F.min(F.struct("at", "end", "n")).alias("place")))
        # a projection is a set of places; its state is 128 bits, the exclusive or of theirs
        marks = [F.coalesce(F.bit_xor(F.when(left, F.xxhash64(F.lit(i), "seq", "place.at"))), F.lit(0)) for i in range(2)]
        counted = rows.groupBy("src", "state", "key").agg(F.sum("place.n").alias("n_docs"), *(m.alias(a) for m, a in zip(marks, "ab")))
        frequent = counted.where(F.col("n_docs") >= min_docs).join(need, "src").where("n_docs >= need")
        edges = cut(frequent.select("src", "state", "key", "n_docs", _state(F.col("a"), F.col("b")).alias("to")))
        fresh = edges.groupBy("src", "to").agg(F.min(F.struct("state", "key")).alias("by"))
        if known is not None:
            if edges.isEmpty():
                return known
            fresh = fresh.join(known.select("src", "to"), ["src", "to"], "left_anti")
        known = edges if known is None else known.unionByName(edges)
        grown = rows.where(left).join(fresh.select("src", "by.state", "by.key", "to"), ["src", "state", "key"])
        grown = grown.select("src", "seq", F.col("to").alias("state"), F.col("place.at").alias("after"))
        following = grown.join(places, ["src", "seq"]).where(F.col("at") > F.col("after"))


def prefix_span(docs: DataFrame, doc_id: str, source: str, content: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, found, needs): all frequent sequences as paths of (src, state, key, n_docs, to), and where frequent
    lines stand (src, doc, line_no, key)."""
    _, found, needs = frequent_lines(docs, doc_id, source, content, min_docs, min_share)
    return _project(found, needs, min_docs), found, needs


def sequence_lines(edges: DataFrame) -> DataFrame:
    """(src, key) of every line that belongs to a frequent sequence."""
    return cut(edges.select("src", "key").distinct())


def sequence_lengths(edges: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, n_lines, n_sequences, most_docs): how many frequent sequences of each length a source has, and in how
    many documents the most frequent of them is. ``n_sequences`` is a double (exact up to 2^53), since n lines can make 2^n sequences."""
    edges = cut(edges)
    paths = needs.select("src", _state(*map(F.lit, ROOT)).alias("state"), F.lit(1.0).alias("n"))
    out, length = None, 0
    while True:
        length += 1
        paths = cut(edges.join(paths, ["src", "state"]).groupBy("src", F.col("to").alias("state")).agg(F.sum("n").alias("n"), F.max("n_docs").alias("n_docs")))
        if out is not None and paths.isEmpty():
            return out.join(small_side(needs.select("src", "source")), "src").select("source", "n_lines", "n_sequences", "most_docs")
        level = paths.groupBy("src").agg(F.sum("n").alias("n_sequences"), F.max("n_docs").alias("most_docs")).withColumn("n_lines", F.lit(length))
        out = level if out is None else out.unionByName(level)
        paths = paths.drop("n_docs")


def mine(docs: DataFrame, doc_id: str, source: str, content: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, sequences): the frequent line sequences (source, keys, n_docs), of every length unless
    ``max_length`` is given, and each document's frequent lines in order (source, doc, lines)."""
    singles, found, needs = frequent_lines(docs, doc_id, source, content, min_docs, min_share)
    levels = [singles.select("src", F.col("key").alias("pattern"), F.array("key").alias("keys"), "n_docs")]
    length = 1
    names = small_side(needs.select("src", "source"))
    # repeated rows of a document count once
    ordered = found.select("src", "doc", "line_no", "key").distinct().groupBy("src", "doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "key"))).alias("lines"))
    if max_length != 1:
        # the place of each frequent line among its document's frequent lines
        places = cut(ordered.select("src", "doc", F.posexplode("lines").alias("at", "l")).select("src", "doc", "at", F.col("l.key").alias("key")))
        grown = places.select("src", "doc", "at", F.col("key").alias("pattern"))
    while max_length is None or length < max_length:
        length += 1
        after = places.select("src", "doc", (F.col("at") - 1).alias("at"), "key")
        grown = grown.join(after, ["src", "doc", "at"]).select("src", "doc", (F.col("at") + 1).alias("at"), "key", F.col("pattern").alias("prefix"), F.unhex(F.md5(F.concat("pattern", "key"))).alias("pattern"))
        level = _frequent(grown, ["pattern"], needs, min_docs, F.min(F.struct("prefix", "key")).alias("end"))
        if level.isEmpty():
            break
        before = levels[-1].select("src", F.col("pattern").alias("prefix"), "keys")
        named = level.select("src", "pattern", "n_docs", "end.prefix", "end.key").join(before, ["src", "prefix"])
        levels.append(cut(named.select("src", "pattern", F.concat("keys", F.array("key")).alias("keys"), "n_docs")))
        grown = cut(grown.select("src", "doc", "at", "pattern").join(small_side(level.select("src", "pattern")), ["src", "pattern"]))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.join(names, "src").select("source", "keys", "n_docs"), ordered.join(names, "src").select("source", "doc", "lines")


def sequential_patterns(docs: DataFrame, doc_id: str, source: str, content: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, max_length: int | None = None) -> DataFrame:
    """The frequent line sequences alone."""
    return mine(docs, doc_id, source, content, min_docs, min_share, max_length)[0]


def marked(sequences: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc, line_no) of every line of the mined documents that belongs to a frequent sequence; no further scan."""
    items = patterns.select("source", F.explode("keys").alias("key")).distinct()
    cells = sequences.select("source", "doc", F.explode("lines").alias("l")).select("source", "doc", "l.line_no", "l.key")
    return cells.join(small_side(cut(items)), ["source", "key"], "left_semi").select("doc", "line_no")


def occurrences(docs: DataFrame, patterns: DataFrame, doc_id: str, source: str, content: str) -> DataFrame:
    """(doc, line_no) of every line that belongs to a frequent sequence."""
    items = patterns.select("source", F.explode("keys").alias("key")).distinct()
    return lines(docs, doc_id, source, content).join(small_side(cut(items)), ["source", "key"], "left_semi").select("doc", "line_no")


def without_repeated(docs: DataFrame, patterns: DataFrame, doc_id: str, source: str, content: str) -> DataFrame:
    """``docs`` with those lines left out of ``content``; one pass, no shuffle of the texts."""
    per_source = patterns.select("source", F.explode("keys").alias("key")).groupBy("source").agg(F.collect_set("key").alias("_keys"))
    per_source = small_side(cut(per_source.withColumnRenamed("source", "_source")))  # bounded for each source, see above
    joined = docs.join(per_source, _named(source) == F.col("_source"), "left")
    kept = F.filter(F.split(content, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_keys"), line_key(x)), F.lit(False)))
    return joined.withColumn(content, F.when(F.col("_keys").isNull(), F.col(content)).otherwise(F.array_join(kept, "\n"))).drop("_keys", "_source")
