"""Near duplicates (p3): pairs, classes and sketches against brute force."""

import random

from siltweave.llm import near_duplicates as N
from siltweave.llm.words import folded


def brute(rows, k, least=0, threshold=0.6):
    sets = {}
    for i, g, t in rows:
        f = folded(t)
        if i is not None and len(f) >= max(k, least):
            sets[i] = (g, {f[j : j + k] for j in range(len(f) - k + 1)})
    return {(a, b) for a in sets for b in sets if a < b and sets[a][0] == sets[b][0] and len(sets[a][1] & sets[b][1]) >= threshold * len(sets[a][1] | sets[b][1])}


def texts(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.6:
            w = rows[r.randrange(len(rows))][2].split()
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(60)]
        rows.append((i, r.choice(["x", "y", None]), " ".join(w)))
    return rows


def test_against_brute_force(spark):
    rows = texts(150, 1) + [(900, "x", None), (901, "x", ""), (902, "x", "a"), (None, "x", "b" * 400), (903, None, "é" * 400), (904, None, "É" * 400), (904, None, "É" * 400)]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    for group, k, least in ((None, 8, 0), ("g", 5, 0), (None, 12, 300)):
        links, members = N.near_duplicates(df, "id", "t", k, group, least)
        got = {tuple(r) for r in N.pairs_of(links, members).distinct().collect()}
        assert got == brute([(i, g if group else 0, t) for i, g, t in rows], k, least)


def test_hot_copies_and_classes(spark):
    rows = [(i, "same text " * 10) for i in range(300)] + [(1000 + i, t) for i, _, t in texts(60, 2)]
    links, members = N.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 8)
    assert members.where("rep = 0").count() == 300  # copies never meet in a band
    want = {}
    for a, b in brute([(i, 0, t) for i, t in rows], 8):
        ra, rb = a, b
        while ra in want and want[ra] != ra:
            ra = want[ra]
        while rb in want and want[rb] != rb:
            rb = want[rb]
        want[max(ra, rb)] = want.setdefault(min(ra, rb), min(ra, rb))
    def root(x):
        while want.get(x, x) != x:
            x = want[x]
        return x
    got = {r["id"]: r["class_id"] for r in N.classes(links, members).collect()}
    assert got == {i: root(i) for i, t in rows}


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "rep_a long, rep_b long")
    members = spark.createDataFrame([(i, i) for i in range(41)], "id long, rep long")
    assert {(r["class_id"]) for r in N.classes(links, members).collect()} == {0}


def test_empty(spark):
    df = spark.createDataFrame([], "id long, t string")
    links, members = N.near_duplicates(df, "id", "t", 12)
    assert N.pairs_of(links, members).count() == 0 and N.classes(links, members).count() == 0


def test_odd_sketch_estimates(spark):
    a = "".join(random.Random(1).choice("abcdefghij") for _ in range(900))
    rows = []
    for cut in (0, 40, 120):
        b = a[cut:] + "z" * cut
        sa, sb = N.shingles(a, 8), N.shingles(b, 8)
        true = len(set(sa) & set(sb)) / len(set(sa) | set(sb))
        rows.append((true, *([int(x) for x in row] for row in N.odd_sketches(N.samples([sa, sb])))))
    df = spark.createDataFrame(rows, "s double, a array<long>, b array<long>")
    for r in df.select("s", N.odd_similarity(df.a, df.b).alias("e")).collect():
        assert abs(r["s"] - r["e"]) < 0.12


def test_classes_without_all_pairs(spark, monkeypatch):
    """Star links and links between classes give the same classes as all links, whatever counts as hot."""
    monkeypatch.setattr(N, "HOT", 3)
    rows = [(i, g, t) for i, g, t in texts(120, 4)] + [(500 + i, "x", "same text " * 10) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, g string, t string")
    links, members = N.near_duplicates(df, "id", "t", 8)
    assert {tuple(r) for r in N.pairs_of(links, members).distinct().collect()} == brute([(i, 0, t) for i, _, t in rows], 8)
    want = {r["id"]: r["class_id"] for r in N.classes(links, members).collect()}
    assert {r["id"]: r["class_id"] for r in N.classes_of(df, "id", "t", 8).collect()} == want
