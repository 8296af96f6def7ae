"""Lines repeated within a source (p4) and the sequences behind them."""

import random
from collections import Counter
from itertools import combinations

import pytest

from siltweave.llm import repeated_lines as R
from siltweave.llm.queries import QUERIES


@pytest.fixture()
def docs(spark):
    rows = []
    for i in range(30):
        body = [f"Line number {'abcdefghijklmnopqrstuvwxyz'[i % 26] * 12} of {'xyzuvw'[i % 6] * (i + 3)}"]
        if i % 3:
            body += ["Share this page with friends!", "  SHARE this page, with friends  "]
        if i % 2:
            body += ["Written by the desk", "Legal notice applies here"]
        rows.append((i, "a", "\n".join(body + ["short"] * 3), "x"))
    rows += [(100 + i, "b", "Legal notice applies here", "x") for i in range(4)] + [(200 + i, None, "Nothing to see in this line\n", "x") for i in range(6)]
    rows += [(300, "a", None, "x"), (301, "a", "", "x"), (0, "a", rows[0][2], "x")]
    return spark.createDataFrame(rows, "id long, src string, t string, line_no string")


def letters(s):
    return "".join(c for c in s.lower() if c.isalpha())


def test_found(docs):
    p = R.sequential_patterns(docs, "id", "src", "t")
    got = {tuple(r) for r in R.occurrences(docs, p, "id", "src", "t").distinct().collect()}
    rows = {(r["id"], r["src"], r["t"]) for r in docs.collect() if r["t"]}
    n, seen = Counter(s for _, s, _ in rows), Counter()
    for _, s, t in rows:
        seen.update({(s, letters(x)) for x in t.split("\n") if len(letters(x)) >= 12})
    want = {(i, k) for i, s, t in rows for k, x in enumerate(t.split("\n"), 1) if len(letters(x)) >= 12 and seen[s, letters(x)] >= max(5, n[s] / 10)}
    assert got == want and want
    again, sequences = R.mine(docs, "id", "src", "t")
    assert {tuple(r) for r in R.marked(sequences, again).collect()} == want


def test_sequences(docs):
    p = R.sequential_patterns(docs, "id", "src", "t")
    sizes = Counter(len(r["keys"]) for r in p.collect())
    assert sizes[1] == 4 and sizes[2] >= 3
    pair = [r for r in p.collect() if len(r["keys"]) == 2 and r["keys"][0] == r["keys"][1]]
    assert len(pair) == 1 and pair[0]["n_docs"] == 20  # the line that follows itself


def test_clean(docs):
    p = R.sequential_patterns(docs, "id", "src", "t")
    out = {r["id"]: r["t"] for r in R.without_repeated(docs, p, "id", "src", "t").collect()}
    assert "friends" not in out[1] and "desk" not in out[1] and "short" in out[1]
    assert out[100] == "Legal notice applies here" and out[300] is None and out[301] == ""


def test_empty(spark):
    df = spark.createDataFrame([], "id long, src string, t string")
    p = R.sequential_patterns(df, "id", "src", "t")
    assert p.count() == 0 and R.occurrences(df, p, "id", "src", "t").count() == 0


def test_exactly_a_tenth(spark):
    """70 documents, 7 of them with the line: 70 * 0.1 is a little over 7 in floating point."""
    rows = [(i, "a", "A line of many letters" if i < 7 else "x") for i in range(70)]
    df = spark.createDataFrame(rows, "id long, src string, t string")
    assert R.sequential_patterns(df, "id", "src", "t", max_length=1).first()["n_docs"] == 7


def test_long_sequences(spark):
    """Sequences are mined to their full length."""
    notice = "\n".join(f"Part {w * 12} of the notice" for w in "abcdefgh")
    rows = [(i, "a", f"Own line {'xyz'[i % 3] * (12 + i)}\n{notice}") for i in range(8)]
    p, sequences = R.mine(spark.createDataFrame(rows, "id long, src string, t string"), "id", "src", "t")
    sizes = Counter(len(r["keys"]) for r in p.collect())
    assert sizes == {k: 9 - k for k in range(1, 9)}
    assert R.marked(sequences, p).count() == 64


def test_first_level_marks_the_same_lines(docs):
    p, sequences = R.mine(docs, "id", "src", "t")
    _, marks, _ = R.frequent_lines(docs, "id", "src", "t")
    assert {tuple(r) for r in marks.select("doc", "line_no").collect()} == {tuple(r) for r in R.marked(sequences, p).collect()}


def lengths(df):
    edges, _, needs = R.prefix_span(df, "id", "src", "t")
    return {(r["source"], r["n_lines"]): (r["n_sequences"], r["most_docs"]) for r in R.sequence_lengths(edges, needs).collect()}


def all_lengths(rows):
    """Every sequence of lines in order, whatever lies between, counted one by one."""
    docs, seen = {}, Counter()
    for i, s, t in rows:
        docs[i, s] = [letters(x) for x in t.split("\n") if len(letters(x)) >= 12]
    n, out = Counter(s for _, s in docs), {}
    for (_, s), keys in docs.items():
        seen.update({(s, c) for k in range(1, len(keys) + 1) for c in combinations(keys, k)})
    for (s, c), m in seen.items():
        if m >= max(5, n[s] / 10):
            k, most = out.get((s, len(c)), (0, 0))
            out[s, len(c)] = k + 1, max(most, m)
    return out


def test_all_sequences(spark):
    """Lines that come and go, change places, repeat, or have other frequent lines between them."""
    rng, rows = random.Random(4), []
    for i in range(90):
        some = [x for x in "abcdef" if rng.random() < 0.7]
        if i % 3 == 0:
            rng.shuffle(some)
        if i % 4 == 0:
            some += some[:2]
        rows.append((i, "xyz"[i % 3 and i % 2], "\n".join(f"Part {w * 12}" for w in some) + f"\nOwn {'opqrst'[i % 6] * (12 + i)}"))
    df = spark.createDataFrame(rows, "id long, src string, t string")
    want = all_lengths(rows)
    assert lengths(df) == want and max(k for _, k in want) >= 4
    assert lengths(spark.createDataFrame([], df.schema)) == {}


def test_template_of_many_lines(spark):
    """40 lines in every document have 2^40 - 1 frequent sequences, yet few states."""
    notice = "\n".join(f"Part {chr(97 + k // 26) * 6}{chr(97 + k % 26) * 6} of the notice" for k in range(40))
    edges, _, _ = R.prefix_span(spark.createDataFrame([(i, "a", notice) for i in range(6)], "id long, src string, t string"), "id", "src", "t")
    assert R.sequence_lines(edges).count() == 40
    n = Counter({tuple(R.ROOT): 1})
    steps = sorted(((tuple(r["state"]), tuple(r["to"])) for r in edges.select("state", "to").collect()))
    assert len({s for s, _ in steps}) == 40 and len(steps) == 40 * 41 // 2
    paths = 0
    while n:
        n, old = Counter(), n
        for s, to in steps:
            n[to] += old[s]
        n = +n
        paths += n.total()
    assert paths == 2**40 - 1


def test_queries_take_all_sequences(spark, tmp_path):
    """Two lines with a third between them that only some documents hold, in the table of the queries."""
    a, b, c = (f"Part {w * 12} of the notice" for w in "abc")
    rows = [(i, "a", "\n".join([a, b, c] if i % 2 else [a, c])) for i in range(12)] + [(None, "a", a), (50, None, a), (51, "b", None)]
    spark.createDataFrame(rows, "result_id long, domain string, content string").write.parquet(str(tmp_path / "results.parquet"))
    got = {(r["domain"], r["n_lines"]): (r["n_sequences"], r["most_docs"]) for r in QUERIES["p4_sequences"](spark, str(tmp_path)).collect()}
    assert got == {("a", 1): (3, 12), ("a", 2): (3, 12), ("a", 3): (1, 6)}
    found = {tuple(r) for r in QUERIES["p4_found"](spark, str(tmp_path)).collect()}
    assert found == {(i, k) for i in range(12) for k in range(1, 4 if i % 2 else 3)} | {(None, 1)}
    assert {r["content"] for r in QUERIES["p4_clean"](spark, str(tmp_path)).where("result_id < 12").collect()} == {""}
