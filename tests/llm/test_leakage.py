"""Evaluation texts in training texts (p7) against brute force."""

import random

from siltweave.llm import leakage as L
from siltweave.llm.words import HAN, words


def brute(docs, items):
    out = set()
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            for p in range(len(a) - 11):
                for q in range(len(b) - 11):
                    if a[p : p + 12] == b[q : q + 12]:
                        han = any(HAN.match(w) for w in a[p : p + 12])
                        if not han or len(a) >= p + 20 and len(b) >= q + 20 and a[p : p + 20] == b[q : q + 20]:
                            out.add((d, i))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["Cat", "dog", "ran", "the", "a", "B2", "火", "水", "山"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "one two three four five six seven eight nine ten eleven twelve"), (93, "ONE two, three four five six seven eight nine ten eleven twelve!")]
    docs = []
    for d in range(80):
        w = [r.choice(vocabulary) for _ in range(20)]
        u = (r.choice(items)[1] or "").split()
        k = r.randint(0, max(0, len(u) - 5))
        docs.append((d, ", ".join(w[:10] + u[k : k + r.randint(10, 30)] + w[10:])))
    docs += [(500, None), (501, ""), (502, "x " * 5000 + "one two three four five six seven eight nine ten eleven twelve"), (502, "one"), (503, "eleven twelve"), (504, "one two three four five six seven eight nine ten eleven")]
    a = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for shard in (L.SHARD_WORDS, 40):
        got = {(x["doc_id"], x["item_id"]): x for x in L.leaked(a, b, shard_words=shard).collect()}
        assert set(got) == brute([x for x in docs if x[1]], [x for x in items if x[1]])
    assert {(502, 92), (502, 93)} <= set(got) and got[502, 92]["n_words"] == 12 and got[502, 92]["doc_word"] == 5000
    blocks = {(x["doc_id"], x["item_id"]) for x in L.leaked(a, b, block_words=50).collect()}
    assert blocks == set(got)  # several blocks of test texts give the same
    left = {x["doc_id"] for x in L.without_leaks(a, L.leaked(a, b)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in got}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert L.leaked(none, items).count() == 0
    assert L.leaked(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
