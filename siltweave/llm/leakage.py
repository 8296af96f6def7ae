"""Problem 7: evaluation texts inside training text, found with suffix arrays of the corpus.

Each Spark partition is read in shards of about ``SHARD_WORDS`` words. A shard's words become
numbers of the test vocabulary, the suffixes that can hold a match (at least ``RUN`` words of
that vocabulary in a row) are sorted into a suffix array, and every test suffix is looked up in
it by binary search. Matches are then extended word by word to their full length, so that the
longest verbatim match and its place are known for each document and item.

The test texts are the only thing sent to the executors. They go in blocks of at most
``BLOCK_WORDS`` words, one pass over the corpus each, so the broadcast stays bounded however
large the test set is.

Defined results: null, empty or wordless texts on either side match nothing; repeated rows with
the same ids give one result row; items with equal texts are each reported; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.llm.words import HAN, WORD
from siltweave.session import cut, small_side, spread

#: Words in a row that make a match, and those needed when one of the first RUN is a Chinese character.
RUN, RUN_HAN = 12, 20
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 4_000_000
#: Occurrences looked at together.
HITS = 1 << 20

_SCHEMA = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def test_block(items: list[tuple[int, str]]) -> dict:
    """The test side of the search: vocabulary, numbered texts, and the sorted keys of all suffixes."""
    vocabulary: dict[str, int] = {}
    ids, owner, at, han = [], [], [], []
    for item, text in items:
        for k, w in enumerate(WORD.findall((text or "").lower())):
            ids.append(vocabulary.setdefault(w, len(vocabulary) + 1))
            owner.append(item)
            at.append(k)
            han.append(HAN.match(w) is not None)
        ids.append(0)  # a text's end
        owner.append(-1)
        at.append(-1)
        han.append(False)
    ids = np.array(ids, np.int32)
    starts = _starts(ids)
    return {"vocabulary": vocabulary, "ids": ids, "owner": np.array(owner, np.int64), "at": np.array(at, np.int32), "han": np.array(han, bool), "starts": starts, "keys": _keys(ids, starts)}


def _starts(ids: np.ndarray) -> np.ndarray:
    """Positions from which RUN known words follow one another."""
    if len(ids) < RUN:
        return np.empty(0, np.int64)
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    return np.flatnonzero(known[RUN:] - known[:-RUN] == RUN)


def _keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first RUN words of each suffix as bytes whose order is that of the word numbers."""
    grid = ids[starts[:, None] + np.arange(RUN)].astype(">u4")
    return np.ascontiguousarray(grid).view(f"S{4 * RUN}").ravel()


def search(block: dict, docs: list[tuple[int, str]], most: int = HITS) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, item, words, word in doc, word in item) of the longest match of each pair that has one.

    Occurrences are looked at ``most`` at a time, so a stem that many documents and items share fills no
    memory; a pair whose occurrences lie in several portions comes once for each.
    """
    number = block["vocabulary"].get
    ids, lengths = [], []
    for _, text in docs:
        found = WORD.findall((text or "").lower())
        ids += [number(w, 0) for w in found]
        ids.append(0)
        lengths.append(len(found) + 1)
    ids = np.array(ids, np.int32)
    starts = _starts(ids)
    if not len(starts) or not len(block["starts"]):
        return
    keys = _keys(ids, starts)
    order = np.argsort(keys, kind="stable")
    array, keys = starts[order], keys[order]  # the shard's suffix array
    low, high = (np.searchsorted(keys, block["keys"], side) for side in ("left", "right"))
    hit = np.flatnonzero(high > low)
    low, hits, suffix = low[hit], (high - low)[hit], block["starts"][hit]
    begins, ends = np.concatenate(([0], np.cumsum(lengths))), np.cumsum(hits)
    han = np.concatenate(([0], np.cumsum(block["han"])))
    for at in range(0, int(ends[-1]) if len(ends) else 0, most):
        n = np.arange(at, min(at + most, int(ends[-1])))  # numbers of occurrences
        of = np.searchsorted(ends, n, "right")
        yield from _longest(block, docs, ids, array[low[of] + n - (ends[of] - hits[of])], suffix[of], begins, han)


def _longest(block: dict, docs: list, ids: np.ndarray, p: np.ndarray, q: np.ndarray, begins: np.ndarray, han: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """The longest match of each pair among occurrences at ``p`` in the shard of suffixes ``q`` of the test texts."""
    length, live = np.full(len(q), RUN), np.arange(len(q))
    test = block["ids"]
    while len(live):
        a, b = p[live] + length[live], q[live] + length[live]
        same = (a < len(ids)) & (b < len(test))
        same[same] = (ids[a[same]] == test[b[same]]) & (ids[a[same]] > 0)
        live = live[same]
        length[live] += 1
    keep = (han[q + RUN] == han[q]) | (length >= RUN_HAN)
    p, q, length = p[keep], q[keep], length[keep]
    if not len(p):
        return
    doc = np.searchsorted(begins, p, "right") - 1
    item = block["owner"][q]
    best = np.lexsort((q, p, -length, item, doc))
    doc, item, p, q, length = (x[best] for x in (doc, item, p, q, length))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    for d, i, n, x, y in zip(doc[first], item[first], length[first], p[first], q[first]):
        yield docs[d][0], int(i), int(n), int(x - begins[d]), int(block["at"][y])


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Test texts in blocks; rows stream to the driver, which holds one block at a time."""
    block, size = [], 0
    for row in items.select(item_id, text).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).dropDuplicates().toLocalIterator():
        block.append((row[0], row[1]))
        size += len(WORD.findall(row[1]))
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The longest verbatim match of each document and item that share one (columns of ``_SCHEMA``)."""
    spark = docs.sparkSession
    found = None
    for items_of_block in _blocks(items, item_id, item_text, block_words):
        shared = spark.sparkContext.broadcast(test_block(items_of_block))

        def find(batches: Iterator[pa.RecordBatch], shared=shared, shard_words=shard_words) -> Iterator[pa.RecordBatch]:
            def out(shard):
                rows = search(shared.value, shard)
                while part := list(islice(rows, 100_000)):
                    cols = zip(*part)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "n_words", "doc_word", "item_word"])

            shard, size = [], 0
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    value = value.as_py()
                    shard.append((key, value))
                    size += len(value) // 4
                    if size >= shard_words:
                        yield from out(shard)
                        shard, size = [], 0
            yield from out(shard)

        part = spread(docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text))).mapInArrow(find, _SCHEMA)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], _SCHEMA)
    # only matches are shuffled; copies of a document row fall together here
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("n_words"), "doc_word", "item_word")).alias("m")).select("doc_id", "item_id", (-F.col("m.col1")).alias("n_words"), "m.doc_word", "m.item_word")


def without_leaks(docs: DataFrame, matches: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that hold a test text."""
    hit = small_side(cut(matches.select(F.col("doc_id").alias("_hit")).distinct()))
    return docs.join(hit, docs[doc_id] == hit["_hit"], "left_anti")
