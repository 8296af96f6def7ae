"""Packing texts into containers (p6)."""

import random
from collections import defaultdict

import numpy as np
import pytest

from siltweave.llm import packing as P


def uniform_padding(hist, cuts, capacity):
    """Padding of buckets that end at ``cuts``, the plain way."""
    total, low = 0, 0
    for high in cuts:
        inside = {k: v for k, v in hist.items() if low < k <= high}
        if inside:
            top = max(inside)
            n = sum(inside.values())
            total += -(-n // (capacity // top)) * capacity - sum(k * v for k, v in inside.items())
        low = high
    return total


def test_buckets_are_optimal():
    import itertools

    r = random.Random(1)
    for _ in range(20):
        hist = {r.randint(1, 40): r.randint(1, 9) for _ in range(6)}
        ls = np.array(sorted(hist))
        got = P.buckets(ls, np.array([hist[k] for k in ls]), [40])
        cuts = sorted(h for _, h, _ in got)
        best = min(uniform_padding(hist, sorted({*c, max(hist)}), 40) for n in range(6) for c in itertools.combinations(sorted(hist), n))
        assert uniform_padding(hist, cuts, 40) == best


@pytest.mark.parametrize("capacities", [[64], [16, 64], [7, 64]])
def test_plan_places_all(capacities):
    r = random.Random(2)
    hist = {k: r.randint(0, 400) for k in range(1, 65)}
    plan = P.plan(hist, capacities)
    placed = defaultdict(int)
    for capacity, times, batch in plan:
        assert sum(k * n for k, n in batch) <= capacity and times > 0
        for k, n in batch:
            placed[k] += n * times
    assert dict(placed) == {k: v for k, v in hist.items() if v}
    tokens = sum(k * v for k, v in hist.items())
    assert tokens / sum(c * t for c, t, _ in plan) > 0.97


def test_packed(spark):
    r = random.Random(3)
    rows = [(i, " ".join("word" for _ in range(r.randint(1, 700)))) for i in range(400)] + [(1000 + i, "the same text " * 20) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, "x " * 3000), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    sizes = spark.createDataFrame([("s", 128), ("l", 1024), ("bad", 0), ("none", None)], "container_kind string, capacity_tokens int")
    got = P.packed(docs, sizes).collect()
    capacity, inside = {"s": 128, "l": 1024}, defaultdict(list)
    for x in got:
        inside[x["container_kind"], x["container_id"]].append(x)
    for (kind, _), xs in inside.items():
        assert sum(x["token_to"] - x["token_from"] for x in xs) <= capacity[kind]
        assert sorted(x["position"] for x in xs) == list(range(len(xs)))
    assert len({i for _, i in inside}) == len(inside)
    per = defaultdict(list)
    for x in got:
        per[x["doc_id"]].append((x["piece"], x["token_from"], x["token_to"]))
    encode = P.tokenizer(P.TOKENIZER).encode_ordinary
    for i, t in dict(rows).items():
        n = len(encode(t)) if t else 0
        if not n:
            assert i not in per
        elif i != 5:
            pieces = sorted(per[i])
            assert pieces[0][1] == 0 and pieces[-1][2] == n and all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
            assert len(pieces) == -(-n // 1024)
    assert len(per[5]) == 2
    filled = sum(x["token_to"] - x["token_from"] for x in got) / sum(capacity[k] for k, _ in inside)
    assert filled > 0.97


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    sizes = spark.createDataFrame([("s", 128)], "container_kind string, capacity_tokens int")
    assert P.packed(docs, sizes).count() == 0 and P.packed(docs, sizes.where("false")).count() == 0
