"""Reading levels (p8): held-out accuracy and odd cases."""

import random

from siltweave.llm import reading_level as L


def made(n, seed):
    r = random.Random(seed)
    pools = [[f"w{k}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(60)] for k in range(5)]
    rows = []
    for i in range(n):
        level = r.randint(1, 5)
        words = [r.choice(pools[min(4, max(0, level - 1 + r.choice((-1, 0, 0, 0, 1))))]) for _ in range(120)]
        rows.append((i, " ".join(words) + ".", level))
    return rows


def test_held_out(spark):
    rows = made(400, 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x"), (902, "zzz", "x")], "doc_id long, text string, level string")
    r = random.Random(2)
    labels = [(i, f"r{k}", min(5, max(1, y + r.choice((0, 0, 0, 1, -1))))) for i, _, y in rows[:200] for k in range(3)] + [(3, "q", None), (777, "q", 5)]
    got = {x["doc_id"]: x["level"] for x in L.levels(docs, spark.createDataFrame(labels, "doc_id long, rater string, level int")).collect()}
    assert sum(got[i] == y for i, _, y in rows[200:]) / 200 > 0.85
    assert len(got) == 403 and all(1 <= v <= 5 for v in got.values())


def test_odd_cases(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, rater string, level int")
    assert [r["level"] for r in L.levels(docs, none).collect()] == [None] * 3
    one = spark.createDataFrame([(1, "r", 5)], "doc_id long, rater string, level int")
    assert len(L.levels(docs, one).collect()) == 3
    assert L.levels(docs.where("false"), one).count() == 0
    assert L.expressions("Die Katze, 12 水火。") == ["die", "katze", ",", "。", "die katze", "katze ,", ", 水", "水 火", "火 。"]


def test_bound_on_rated(spark):
    rows = made(60, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "r", y) for i, _, y in rows], "doc_id long, rater string, level int")
    assert L.levels(docs, labels, max_rated=20).count() == 60
