"""Problem 3: nearly equal records, by MinHash bands verified with odd sketches.

Texts are folded (lower case, letters and digits only) and seen as sets of k-character shingles.
Equal folded texts fall together first, by a 128-bit hash: only one representative of each goes
on, so copies never meet in a band. For each representative one Arrow pass gives

* ``bands``: hashes of ROWS-row bands of a MinHash signature, and
* ``odd``: an odd sketch, a bitmap in which every (sample number, sample) pair flips one bit.

Representatives that share a band are candidates. The population count of the XOR of two odd
sketches estimates their similarity with a standard error of at most 0.042 (measured; less the more
alike they are). It decides all pairs further than MARGIN, four standard errors, from the threshold,
in the JVM and without their texts; only the pairs between are verified on their shingle sets.

With BANDS bands of ROWS rows a pair of similarity s is missed with probability
(1 - s**ROWS)**BANDS: 0.6 gives 1.4e-4, 0.65 gives 3e-6. Pairs that only share site furniture
(similarity 0.1) meet with probability 0.006, so candidates stay few in a large site.

Classes need no pairs within a class: each member of a band is first compared with the band's least
representative alone; then only members of one band that are in different classes yet meet.

Texts with many shingles take all samples from one hash of each shingle (one permutation, split
into bins; an empty bin borrows from a bin drawn by its number), short ones from one hash function
a sample.

There is no cap on bands, candidates or partners. A band shared by more than HOT representatives is
joined in parts: one side is split by a salt, the other repeated for each part, so that no task
holds more than HOT times the band's size.

Defined results: null texts, texts folded to fewer than ``max(k, min_chars)`` characters and
null ids have no partner; a null group is a group of its own; repeated rows of one id count
once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltweave.llm.words import folded
from siltweave.session import cut, small_side, spread

BANDS, ROWS, ODD_LONGS = 64, 4, 16
SAMPLES = BANDS * ROWS
#: From this least length on all samples come from one permutation.
BINNED_CHARS = 200
#: Odd-sketch estimates this far from the threshold decide (four standard errors).
MARGIN = 0.17
#: Members of a band from which on its pairs are made in parts.
HOT = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the k-character sequences of a folded text."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(code) < k:
        return np.empty(0, np.uint64)
    n = len(code) - k + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + code[j : j + n] + np.uint64(1)
    h = _mixed(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


_SEEDS = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _MIX)


_EDGES = (np.arange(SAMPLES, dtype=np.float64) * (2.0**64 / SAMPLES)).astype(np.uint64)
with np.errstate(over="ignore"):
    #: Where an empty bin looks for a sample, in this order.
    _DONORS = (_mixed(np.arange(SAMPLES * 24, dtype=np.uint64) * _MIX + np.uint64(7)) % np.uint64(SAMPLES)).astype(np.int64).reshape(SAMPLES, 24)


def binned_samples(sh: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash samples of a sorted, non-empty shingle set from one permutation."""
    at = np.searchsorted(sh, _EDGES)
    filled = at < np.append(at[1:], len(sh))
    value = sh[np.minimum(at, len(sh) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        tries = filled[_DONORS[empty]]
        some = np.flatnonzero(filled)
        donor = np.where(tries.any(1), _DONORS[empty, tries.argmax(1)], some[np.searchsorted(some, empty) % len(some)])
        value[empty] = value[donor]
    return value


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES MinHash samples a row of non-empty shingle sets, one hash function a sample."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    a = 0
    while a < len(sets):
        b, n = a + 1, len(sets[a])
        while b < len(sets) and n + len(sets[b]) <= 4096:  # blocks of a few megabytes
            n += len(sets[b])
            b += 1
        low = np.full((b - a, SAMPLES), np.iinfo(np.uint64).max, np.uint64)
        flat = np.concatenate(sets[a:b])
        starts = np.cumsum([0, *map(len, sets[a : b - 1])])
        with np.errstate(over="ignore"):
            if b - a == 1:
                for k in range(0, len(flat), 4096):
                    x = (flat[k : k + 4096, None] ^ _SEEDS) * _MIX
                    x ^= x >> np.uint64(32)
                    np.minimum(low[0], x.min(0), out=low[0])
            else:
                x = (flat[:, None] ^ _SEEDS) * _MIX
                x ^= x >> np.uint64(32)
                low = np.minimum.reduceat(x, starts, axis=0)
        out[a:b] = low
        a = b
    return out


def band_keys(sample: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of samples; the salts keep groups apart."""
    rows = sample.reshape(len(sample), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = (np.arange(BANDS, dtype=np.uint64) + salts.astype(np.uint64)[:, None]) * _MIX
        for r in range(ROWS):
            h = _mixed(h ^ rows[:, :, r]) * np.uint64(0x100000001B3)
    return _mixed(h).view(np.int64)


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """For each row ODD_LONGS words of a bitmap in which each (number, sample) pair flips a bit."""
    n, width = len(sample), 64 * ODD_LONGS
    with np.errstate(over="ignore"):
        bit = (_mixed(sample + np.arange(SAMPLES, dtype=np.uint64) * _MIX) % np.uint64(width)).astype(np.int64)
    parity = (np.bincount((bit + np.arange(n)[:, None] * width).ravel(), minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64).reshape(n, ODD_LONGS)


def _sketches(k: int, binned: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                batch = big.slice(at, 1000)
                sets = [shingles(folded(t.as_py()), k) for t in batch.column(1)]
                sample = np.array([binned_samples(x) for x in sets]) if binned else samples(sets)
                found = (band_keys(sample, np.array(batch.column(2).to_pylist(), np.int64)), odd_sketches(sample))
                cols = [pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel()) for x in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["rep", "bands", "odd"])

    return run


def _hashes(k: int, min_chars: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, groups, keys = [], [], []
            for i, g, text in zip(*(c.to_pylist() for c in batch.columns)):
                f = folded(text)
                if len(f) >= max(k, min_chars):
                    ids.append(i)
                    groups.append(g)
                    keys.append(xxhash.xxh3_128_digest(f.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.int64()), pa.array(keys, pa.binary())], ["id", "grp", "same"])

    return run


def _exact(k: int, threshold: float):
    num, den = int(round(threshold * 1000)), 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep, last, sa = [], None, None
            for i in range(len(a)):
                if a[i] != last:
                    last, sa = a[i], shingles(folded(ta[i]), k)
                sb = shingles(folded(tb[i]), k)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if both * den >= num * (len(sa) + len(sb) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["rep_a", "rep_b"])

    return run


def sketched(df: DataFrame, record_id: str, text: str, k: int, group: str | None = None, min_chars: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, members, texts): bands and odd sketch of each representative, (id, rep) of every record
    that takes part (copies share a representative), and the texts (id, text) of all records.

    The texts of representatives are shuffled once, as they are smaller than sketches.
    """
    grp = F.lit(0).cast("long") if group is None else F.xxhash64(F.lit("g"), group)
    base = df.where(F.col(record_id).isNotNull() & F.col(text).isNotNull()).select(F.col(record_id).cast("long").alias("id"), grp.alias("grp"), F.col(text).alias("text"))
    hashed = cut(spread(base).mapInArrow(_hashes(k, min_chars), "id long, grp long, same binary"))
    firsts = hashed.groupBy("grp", "same").agg(F.min("id").alias("rep"))
    members = cut(hashed.join(firsts.hint("merge"), ["grp", "same"]).select("id", "rep").distinct())
    own = base.join(members.where("id = rep").select(F.col("rep").alias("_r")).hint("shuffle_hash"), F.col("id") == F.col("_r"), "left_semi")
    bands = own.select("id", "text", "grp").mapInArrow(_sketches(k, min_chars >= BINNED_CHARS), "rep long, bands array<long>, odd array<long>")
    return cut(bands), members, base.select("id", "text")


def _cells(sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shared, cells): the bands (key, n, least, most) of n > 1 representatives, and the members (key, n, rep)
    of those of more than two. A key tells its band. Cells are shuffled once; only shared ones are kept."""
    cells = sketches.select("rep", F.explode("bands").alias("key")).repartition("key")
    kept = cut(cells.join(cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "key"))
    return kept.groupBy("key").agg(F.max("n").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("most")), kept.where("n > 2")


def _met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (rep_a, rep_b) of rows (rep, n, on) of two tables that agree on ``on``, hot ones in parts."""
    parts = F.ceil(F.col("n") / HOT).cast("int")
    left = a.select(*on, F.col("rep").alias("rep_a"), F.pmod(F.hash("rep"), parts).alias("part"))
    right = b.select(*on, F.col("rep").alias("rep_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(right, [*on, "part"]).select("rep_a", "rep_b")


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The distinct pairs of similarity >= threshold."""
    odd = sketches.select("rep", "odd")
    pairs = pairs.where("rep_a <> rep_b").select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()
    pairs = pairs.join(odd.select(F.col("rep").alias("rep_a"), F.col("odd").alias("odd_a")).hint("merge"), "rep_a").join(odd.select(F.col("rep").alias("rep_b"), F.col("odd").alias("odd_b")).hint("merge"), "rep_b")
    # a row that was repeated has its sketch twice
    near = cut(pairs.select("rep_a", "rep_b", odd_similarity(F.col("odd_a"), F.col("odd_b")).alias("s")).where(F.col("s") >= threshold - MARGIN).distinct())
    doubt = near.where(F.col("s") < threshold + MARGIN).select("rep_a", "rep_b")
    named = small_side(cut(doubt.select(F.explode(F.array("rep_a", "rep_b")).alias("_r")).distinct()))
    texts = texts.join(named, F.col("id") == F.col("_r"), "left_semi").dropDuplicates(["id"])
    doubt = doubt.join(texts.select(F.col("id").alias("rep_a"), F.col("text").alias("text_a")).hint("merge"), "rep_a").join(texts.select(F.col("id").alias("rep_b"), F.col("text").alias("text_b")).hint("merge"), "rep_b")
    exact = doubt.select("rep_a", "rep_b", "text_a", "text_b").mapInArrow(_exact(k, threshold), "rep_a long, rep_b long")
    return cut(near.where(F.col("s") >= threshold + MARGIN).select("rep_a", "rep_b").unionByName(exact))


def near_duplicates(df: DataFrame, record_id: str, text: str, k: int, group: str | None = None, min_chars: int = 0, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(links, members): ``links`` (rep_a, rep_b) between representatives of similarity >= threshold,
    ``members`` (id, rep) of every record that takes part; copies share a representative."""
    sketches, members, texts = sketched(df, record_id, text, k, group, min_chars)
    shared, cells = _cells(sketches)
    pairs = shared.where("n = 2").select(F.col("least").alias("rep_a"), F.col("most").alias("rep_b")).unionByName(_met(cells, cells, ["key"]).where("rep_a < rep_b"))
    return verified(pairs, sketches, texts, k, threshold), members


def odd_similarity(a, b):
    """The similarity of two MinHash signatures estimated from their odd sketches."""
    n = 64 * ODD_LONGS
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 + n / (4.0 * SAMPLES) * F.log(F.greatest(1 - 2.0 * differ / n, F.lit(1e-6)))


def pairs_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """All (id_a, id_b), id_a < id_b, of records that are nearly equal, copies included."""
    a, b = members.select(F.col("id").alias("x"), F.col("rep").alias("rep_a")), members.select(F.col("id").alias("y"), F.col("rep").alias("rep_b"))
    linked = links.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    copies = a.join(b, F.col("rep_a") == F.col("rep_b")).where("x < y").select("x", "y")
    both = linked.unionByName(copies)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def _components(edges: DataFrame) -> DataFrame:
    """(rep, label): the least representative that can be reached over links (rep_a, rep_b), of each that has one.

    Minimum labels spread over the links and are then looked up through one another (pointer
    jumping), so long chains close in logarithmically many rounds.
    """
    edges = cut(edges.select("rep_a", "rep_b").unionByName(edges.select(F.col("rep_b").alias("rep_a"), F.col("rep_a").alias("rep_b"))).distinct())
    label = cut(edges.groupBy("rep_a").agg(F.least(F.min("rep_b"), F.col("rep_a")).alias("label")).withColumnRenamed("rep_a", "rep"))
    while True:
        spread = edges.join(label.withColumnRenamed("rep", "rep_b").withColumnRenamed("label", "other"), "rep_b").groupBy("rep_a").agg(F.min("other").alias("other"))
        lower = label.join(spread, F.col("rep") == F.col("rep_a"), "left").select("rep", "label", F.least("label", "other").alias("low"))
        jump = label.select(F.col("rep").alias("low"), F.col("label").alias("far"))
        after = cut(lower.join(jump, "low", "left").select("rep", F.least("low", F.coalesce("far", "low")).alias("new"), "label"))
        label = after.select("rep", F.col("new").alias("label"))
        if after.where("new < label").isEmpty():
            return label


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class_id, n_links): one row a record; its class by all links, and the number of texts it is linked to."""
    ends = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    out = members.join(_components(links), "rep", "left").join(ends.groupBy("rep").agg(F.count("*").alias("n_links")), "rep", "left")
    return out.select("id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def classes_of(df: DataFrame, record_id: str, text: str, k: int, group: str | None = None, min_chars: int = 0, threshold: float = 0.6) -> DataFrame:
    """(id, class_id): one row a record; a class is what links of similarity >= threshold connect, named
    by its smallest id. Records without a partner are a class of their own.

    First every member of a band is compared with the band's least one. That settles most classes; of
    what is left only members of one band in different classes are compared, so a site of n pages of one
    template makes n pairs a band and not n * n, and no link between classes is lost.
    """
    sketches, members, texts = sketched(df, record_id, text, k, group, min_chars)
    shared, cells = _cells(sketches)
    stars = shared.where("n = 2").select(F.col("least").alias("rep_a"), F.col("most").alias("rep_b"))
    stars = stars.unionByName(cells.select("key", F.col("rep").alias("rep_a")).join(shared.select("key", F.col("least").alias("rep_b")), "key").select("rep_a", "rep_b"))
    stars = verified(stars, sketches, texts, k, threshold)
    named = cut(cells.join(_components(stars), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")))
    groups = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    meet = groups.select("key", F.col("label").alias("la")).join(groups.select("key", F.col("label").alias("lb"), F.col("m").alias("n")), "key").where("la < lb")
    across = meet.join(named.select("key", F.col("rep").alias("rep_a"), F.col("label").alias("la")), ["key", "la"])
    across = across.select(F.col("rep_a").alias("rep"), "n", "key", F.col("lb").alias("label"))
    rest = named.join(groups.withColumnRenamed("m", "n"), ["key", "label"])
    links = verified(_met(across, rest, ["key", "label"]), sketches, texts, k, threshold)
    label = _components(stars.unionByName(links))
    return members.join(label, "rep", "left").select("id", F.coalesce("label", "rep").alias("class_id"))
