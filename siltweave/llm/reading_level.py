"""Problem 8: reading level of each document from the acquisition grades of its words.

Fit: the rated documents give each expression (a word, a punctuation mark, or a pair of
neighbours; for Chinese, pairs of characters) its distribution over the levels. Its acquisition
grade is the mean of that distribution with every level weighted alike, drawn towards the middle
while few documents hold it. A document is described by quantiles of the grades of its known
expressions; a ridge regression on quantiles made with grades from the other folds, and cut
points that split the fitted values into the levels, turn them into a level of 1 to 5.

The counts are made in Spark (one row an expression and fold is summed, in whole numbers, so that the
sums don't depend on their order); only grades and the 13 numbers that describe each rated document come to
the driver, which solves the regression.

Apply: one Arrow pass over all documents, whole texts, with the grade table broadcast.

Bounds: the fit uses at most ``MAX_RATED`` rated documents (those with the smallest hash of their
id), which bounds the grade table sent to the executors: expressions of fewer than MIN_DOCS rated
documents have no grade. Everything else covers all rows.

Defined results: several ratings of a document are averaged, null ratings ignored; a null or
empty text, or one without a known expression, gets the level whose quantiles are all in the
middle; without any rating all levels are null; repeated rows stay repeated in ``levels``;
other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.session import cut, spread

MAX_RATED = 4000
LEVELS = 5
MIDDLE = (1 + LEVELS) / 2
FOLDS = 5
MIN_DOCS, PRIOR, RIDGE = 3, 2.0, 1.0
QUANTILES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿][^\W_一-鿿]*|[.,;:?!。，；：？！]")


def expressions(text: str | None) -> list[str]:
    """Words, punctuation marks and pairs of neighbours of a text; single Chinese characters only in pairs."""
    if not text:
        return []
    marks = _TOKEN.findall(text.lower())
    pairs = list(map(" ".join, zip(marks, marks[1:])))
    return (marks if text.isascii() else [m for m in marks if not "一" <= m <= "鿿"]) + pairs


def describe(found: list[str], grades: dict[str, float]) -> np.ndarray:
    """Quantiles and mean of the known expressions' grades, and a constant."""
    v = np.fromiter(filter(None, map(grades.get, found)), float)  # grades are above 0
    if len(v) < 5:
        v = np.append(v, np.full(5 - len(v), MIDDLE))
    v.sort()
    return np.concatenate((v[(np.array(QUANTILES) * (len(v) - 1)).round().astype(int)], [v.mean(), 1.0]))


#: Shares are summed as whole numbers of this part.
UNIT = 1 << 36


def _shares(y: float) -> np.ndarray:
    """A mean rating as shares of the two levels next to it."""
    share, low = np.zeros(LEVELS), int(np.clip(np.floor(y), 1, LEVELS))
    share[low - 1] = 1 - (y - low)
    if y > low:
        share[low] = y - low
    return share


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, fold, n_docs, w1..w5): what the documents of a batch (text, y, fold) say of each expression."""
    for batch in (big.slice(k, 250) for big in batches for k in range(0, big.num_rows, 250)):
        index: dict[tuple[str, int], int] = {}  # the row of each word and fold
        at, times, shares, sizes = [], [], [], []
        for text, y, fold in zip(*(batch.column(c).to_pylist() for c in range(3))):
            found = expressions(text)
            counted = Counter(found)
            at += [index.setdefault((w, fold), len(index)) for w in counted]
            times += counted.values()
            shares.append(_shares(y) / max(1, len(found)))
            sizes.append(len(counted))
        each = np.round(np.repeat(np.array(shares).reshape(-1, LEVELS), sizes, axis=0) * np.array(times, float)[:, None] * UNIT).astype(np.int64)
        table = np.zeros((len(index), 1 + LEVELS), np.int64)
        np.add.at(table, np.array(at, np.int64), np.column_stack((np.ones(len(each), np.int64), each)))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in index], pa.string()), pa.array([f for _, f in index], pa.int32()), *(pa.array(table[:, k]) for k in range(1 + LEVELS))], ["word", "fold", "n_docs", *(f"w{k}" for k in range(1, LEVELS + 1))])


def _grade(n, w: list, total: np.ndarray):
    """The acquisition grade from document count, weights by level and the levels' totals, as a column; null below MIN_DOCS."""
    p = [x / float(t) for x, t in zip(w, total)]
    whole = sum(p[1:], p[0])
    mean = sum((x * (k + 1) for k, x in enumerate(p)), F.lit(0.0)) / whole
    return F.when((n >= MIN_DOCS) & (whole > 0), (n * mean + PRIOR * MIDDLE) / (n + PRIOR))


def _regressed(rows: np.ndarray, y: np.ndarray) -> dict:
    """Centre, weights and cut points that turn descriptions into levels."""
    centre = np.append(rows[:, :-1].mean(0), 0)
    x = rows - centre
    penalty = RIDGE * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    coef = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    fitted, level = x @ coef, np.floor(y + 0.5)
    cuts = []
    for k in range(1, LEVELS):
        cut = k + 0.5
        if min((level > k).sum(), (level <= k).sum()) >= 20:  # else the middle between two levels
            tries = np.quantile(fitted, np.linspace(0.005, 0.995, 199))
            tries = tries[np.abs(tries - cut) < 0.5]
            if len(tries):
                cut = tries[np.argmin([((fitted > c) != (level > k)).sum() for c in tries])]
        cuts.append(float(cut))
    return {"centre": centre, "coef": coef, "cuts": sorted(cuts)}


def level_of(text: str | None, model: dict) -> int:
    value = float((describe(expressions(text), model["grades"]) - model["centre"]) @ model["coef"])
    return 1 + sum(value > c for c in model["cuts"])


def fitted(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> dict | None:
    """The model of the rated documents, at most ``max_rated`` of them."""
    spark = docs.sparkSession
    mean = labels.where(F.col("level").between(1, LEVELS)).groupBy(F.col("doc_id").alias("_id")).agg(F.avg("level").alias("y"))
    mean = mean.orderBy(F.xxhash64("_id"), "_id").limit(max_rated)
    texts = docs.select("doc_id", "text").join(F.broadcast(mean), F.col("doc_id") == F.col("_id"))  # at most max_rated rows
    texts = cut(texts.where(F.length("text") > 0).dropDuplicates(["_id"]).select("text", "y", F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).cast("int").alias("fold"), "_id"))
    ratings = texts.select("fold", "y").collect()  # at most max_rated rows of two numbers
    if not ratings:
        return None
    levels_of = [f"w{k}" for k in range(1, LEVELS + 1)]
    total = np.full((FOLDS, LEVELS), 1e-9)
    for fold, y in ratings:
        total[fold] += _shares(y)
    counted = texts.select("text", "y", "fold").mapInArrow(_counts, "word string, fold int, n_docs long, " + ", ".join(f"{c} long" for c in levels_of))
    counted = counted.groupBy("word", "fold").agg(*(F.sum(c).alias(c) for c in ("n_docs", *levels_of)))
    words = counted.groupBy("word").agg(*(F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(-1, FOLDS) for c in ("n_docs", *levels_of)))
    grade = [_grade(F.col(f"n_docs_{f}"), [F.col(f"{c}_{f}") / UNIT for c in levels_of], total.sum(0) - (total[f] if f >= 0 else 0)).alias(f"g{f}") for f in range(-1, FOLDS)]
    table = words.select("word", *grade).where("`g-1` is not null").toPandas()
    tables = [{w: g for w, g in zip(table["word"], table[f"g{f}"]) if g == g} for f in range(-1, FOLDS)]
    shared = spark.sparkContext.broadcast(tables)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [describe(expressions(t), shared.value[1 + f]).tolist() for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "y", "x"])

    rows = texts.select("text", "y", "fold", F.col("_id").cast("long").alias("_id")).mapInArrow(described, "id long, y double, x array<double>").orderBy("id").collect()  # max_rated rows of 13 numbers
    return {"grades": tables[0], **_regressed(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]))}


def levels(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, rated_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, level) for each row of ``docs``; the rated texts are looked up in ``rated_from`` (else ``docs``)."""
    model = fitted(docs if rated_from is None else rated_from, labels, max_rated)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("int").alias("level"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [level_of(t.as_py(), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], ["doc_id", "level"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rate, "doc_id long, level int")
