"""Problem 6: texts packed into containers of given token capacities.

1. One Arrow pass counts each text's tokens (a public tokenizer); a text longer than the largest
   capacity becomes full pieces and a rest. Only ids and lengths are kept from then on.
2. The global histogram of lengths, at most as many rows as the largest capacity, goes to the
   driver. Dynamic programming over it chooses the boundaries of length buckets, and the capacity
   each bucket uses, so that the padding of uniform batches is least.
3. Token-budget batches form inside each bucket: runs of neighbouring lengths, as many as the
   budget holds. What a batch leaves free is topped up with the longest shorter texts that fit. The
   plan speaks of lengths and counts only, so its size does not depend on the number of texts.
4. Every text finds its place from its length and its rank among texts of that length. Ranks are
   made in groups, as many for a length as its count calls for, and shifted by the groups' running
   counts, so a length that a third of all texts share is no hot key.

Defined results: null texts and texts without a token are not placed; repeated rows are placed as
often as they occur; capacities that are null or below 1 are ignored, without any left nothing is
placed; equal capacities count once; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltweave.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The usual word splitting of byte-level BPE (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: About so many texts of one length are ranked in one task; a length that more texts share is salted.
GROUP = 50_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level BPE whose ranks lie at ``path``."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of each text that isn't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return spread(docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, n_tokens long")


def buckets(lengths: np.ndarray, counts: np.ndarray, capacities: list[int]) -> list[tuple[int, int, int]]:
    """(shortest, longest, capacity) of the buckets of least padding, longest bucket first.

    A bucket's batches hold floor(capacity / longest) texts each; its padding is what they leave free.
    """
    n = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    best = np.full(len(lengths) + 1, np.inf)
    best[0] = 0
    came = [(0, 0)] * (len(lengths) + 1)
    for j in range(1, len(lengths) + 1):
        for c in capacities:
            k = c // lengths[j - 1]
            if k:
                cost = best[:j] + -(-(n[j] - n[:j]) // k) * float(c) - (tokens[j] - tokens[:j])
                i = int(np.argmin(cost))
                if cost[i] < best[j]:
                    best[j], came[j] = cost[i], (i, c)
    out, j = [], len(lengths)
    while j:
        i, c = came[j]
        out.append((int(lengths[i]), int(lengths[j - 1]), c))
        j = i
    return out


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(capacity, containers, [(length, how many in each container)]) for all texts of a histogram."""
    left = {k: v for k, v in histogram.items() if v > 0}
    if not left:
        return []
    lengths = np.array(sorted(left))
    counts = np.array([left[k] for k in lengths])
    alive = list(map(int, lengths))  # lengths with texts left, ascending
    out: list[tuple[int, int, list[tuple[int, int]]]] = []

    def gone(length: int) -> None:
        if not left[length]:
            alive.pop(bisect_right(alive, length) - 1)

    for low, high, capacity in buckets(lengths, counts, capacities):
        while True:
            at = bisect_right(alive, high) - 1
            if at < 0 or alive[at] < low:
                break
            # one batch: the longest texts of the bucket, then whatever longest fits the free tokens
            batch: list[tuple[int, int]] = []
            room, bound = capacity, high
            while room > 0:
                at = bisect_right(alive, min(room, bound)) - 1
                if at < 0:
                    break
                length = alive[at]
                used = dict(batch).get(length, 0)
                take = min(room // length, left[length] - used)
                if take:
                    batch.append((length, take))
                    room -= take * length
                bound = length - 1
            # the same batch again, as often as there are texts for it
            times = min(left[length] // k for length, k in batch)
            for length, k in batch:
                left[length] -= times * k
                gone(length)
            out.append((capacity, times, batch))
    return out


def places(pattern: list[tuple[int, int, list[tuple[int, int]]]]) -> dict[int, tuple[list[int], list[tuple[int, int, int, int, int]]]]:
    """For each length: first ranks, and (first rank, capacity, first container, position, per container) from them on."""
    out: dict[int, tuple[list[int], list]] = {}
    seen: dict[int, int] = {}
    container = 0
    for capacity, times, batch in pattern:
        position = 0
        for length, k in batch:
            first = seen.get(length, 0)
            ranks, rows = out.setdefault(length, ([], []))
            ranks.append(first)
            rows.append((first, capacity, container, position, k))
            seen[length] = first + times * k
            position += k
        container += times
    return out


def packed(docs: DataFrame, containers: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(container_kind, container_id, position, doc_id, piece, token_from, token_to) of every text or piece."""
    spark = docs.sparkSession
    kinds = {r["c"]: r["k"] for r in containers.where("capacity_tokens >= 1").groupBy(F.col("capacity_tokens").alias("c")).agg(F.min("container_kind").alias("k")).collect()}
    schema = "container_kind string, container_id long, position int, doc_id long, piece int, token_from long, token_to long"
    if not kinds:
        return spark.createDataFrame([], schema)
    largest = max(kinds)
    counted = cut(token_counts(docs, path).where("n_tokens > 0"))
    pieces = counted.select("doc_id", "n_tokens", F.explode(F.expr(f"sequence(0, cast((n_tokens - 1) div {largest} as int))")).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.lit(largest).cast("long"), F.col("n_tokens") - F.col("piece") * largest).alias("length"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `largest` rows
    where = spark.sparkContext.broadcast((places(plan(histogram, sorted(kinds))), kinds, largest))
    parts = spark.createDataFrame([(int(k), -(-int(n) // GROUP)) for k, n in histogram.items()] or [(0, 1)], "length long, parts int")
    pieces = pieces.join(F.broadcast(parts), "length")  # one row a length, at most `largest`
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")).cast("int")
    ranked = pieces.withColumn("salt", salt).withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    groups = pieces.groupBy("length", salt.alias("salt")).count()
    offsets = groups.withColumn("shift", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).select("length", "salt", "shift")
    rows = ranked.join(offsets, ["length", "salt"]).select("doc_id", "piece", "length", (F.col("r") + F.col("shift")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds, largest = where.value
        for batch in batches:
            kind, container, position, begin, end = [], [], [], [], []
            for piece, length, rank in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                ranks, spans = table[length]
                first, capacity, number, at, k = spans[bisect_right(ranks, rank) - 1]
                kind.append(kinds[capacity])
                container.append(number + (rank - first) // k)
                position.append(at + (rank - first) % k)
                begin.append(piece * largest)
                end.append(piece * largest + length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.string()), pa.array(container, pa.int64()), pa.array(position, pa.int32()), batch.column(0), batch.column(1), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                ["container_kind", "container_id", "position", "doc_id", "piece", "token_from", "token_to"],
            )

    return rows.mapInArrow(run, schema)
