"""Near-duplicate texts by anchor points of a covering code.

Every text gets some fingerprints, each a word of LENGTH symbols of 16 bits, made of min-hashes of its word shingles. The anchors are the words of the
parity code over these symbols, those whose sum is 0 modulo 2^16: a code with q^(LENGTH - 1) words, covering radius 1, and the radius is reached in every place, as
changing any one symbol by the sum gives a code word. The threshold on fingerprints is 1. Two fingerprints that differ in one place alone have a code word in common within
the radius of both, the one that differs from them there; so copies to all code words within the radius are enough, and the further ones within radius plus
threshold, some 400,000, would add no meeting. An anchor is named by its table and code word, whatever place was changed to come there.

Texts of similarity s agree in at least LENGTH - 1 places of a fingerprint with probability s^4 + 4 s^3 (1 - s); there are as many fingerprints as bring the chance that a pair
at the threshold of similarity meets nowhere below MISS (9 for 0.55, 3 for 0.8).

Fingerprints that meet at an anchor are compared there by size and by a sketch of 60 symbols of two bits, which also stands for the text. What
passes is verified by the exact similarity of the shingle sets. An anchor with very many texts is split into fragments, of which every two meet in a task of
their own, so no task compares more than two fragments. Texts with the same shingle set are one representative throughout; their copies come back at the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from concordat.functions import bloom
from concordat.functions.lineage import cut

#: Symbols of a fingerprint, and the chance that a pair at the threshold has no fingerprint in reach of another.
LENGTH, MISS = 4, 0.0125
#: Symbols of the sketch; the first 32 fill one 64-bit word, the others share the second with the size.
SYMBOLS = 60
#: Standard deviations by which the sketches of a pair at the threshold may lie apart; one such pair in 4,300 lies further.
DEVIATIONS = 3.5
#: Shingles hashed at a time, so that they stay in the processor's cache.
CHUNK = 1 << 16
#: Texts of an anchor from which on it is split into fragments of that many, and the share of texts on which anchors are weighed for that.
HOT, WEIGHED = 4_000, 16
_WORD = re.compile(r"[^\W_]+")
_WORD_HASH: dict[str, int] = {}


def fingerprints(threshold: float) -> int:
    """How many fingerprints a text needs for this threshold of similarity."""
    meets = threshold**LENGTH + LENGTH * threshold ** (LENGTH - 1) * (1 - threshold)
    return max(1, math.ceil(math.log(MISS) / math.log(max(1 - meets, 1e-9))))


@lru_cache(maxsize=4)
def _mixers(symbols: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng(20)
    return g.integers(0, 2**32, symbols, dtype=np.uint64).astype(np.uint32), (g.integers(0, 2**31, symbols, dtype=np.uint64) * 2 + 1).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; the worker remembers those of frequent words."""
    known, fresh = _WORD_HASH, []
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        import xxhash

        if len(known) > 1_000_000:
            known.clear()
        fresh = set(words).difference(known)
        for w in fresh:
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[str], k: int, least: int) -> list[np.ndarray | None]:
    """The sorted distinct 64-bit hashes of the k-word sequences of each text; None below `least` words. Words are runs of letters and digits, lower-cased."""
    tokens = [_WORD.findall(t.lower()) if t else [] for t in texts]
    fit = [n for n, t in enumerate(tokens) if len(t) >= max(least, k)]
    out: list[np.ndarray | None] = [None] * len(texts)
    if not fit:
        return out
    sizes = np.array([len(tokens[n]) for n in fit])
    h = word_hashes([w for n in fit for w in tokens[n]])
    s = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        s = _mix(s + np.uint64(0x9E3779B97F4A7C15)) ^ h[j : len(h) - k + 1 + j]
    s = _mix(s)
    begin = np.cumsum(sizes) - sizes
    for n, a, z in zip(fit, begin.tolist(), sizes.tolist()):
        out[n] = np.unique(s[a : a + z - k + 1])
    return out


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of 32-bit min-hashes for each non-empty shingle set."""
    xor, mul = _mixers(symbols)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    out = np.empty((symbols, len(sets)), np.uint32)
    first = 0
    while first < len(sets):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + CHUNK)))
        begin = ends[first:last] - sizes[first:last] - done
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        for i in range(symbols):
            y = (x ^ xor[i]) * mul[i]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y ^= y >> np.uint32(13)
            out[i, first:last] = np.minimum.reduceat(y, begin)
        first = last
    return out.T.copy()


def words(sig: np.ndarray, tables: int) -> np.ndarray:
    """The fingerprints, a column each: LENGTH symbols of 16 bits in a 64-bit word."""
    symbol = _mix(sig[:, : tables * LENGTH].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return np.bitwise_or.reduce(symbol.reshape(len(sig), tables, LENGTH) << (np.arange(LENGTH, dtype=np.uint64) * np.uint64(16)), axis=2)


def code_words(word: Column) -> list[Column]:
    """The words of the parity code that differ from a fingerprint in one place at most, place by place."""
    symbols = [F.shiftrightunsigned(word, 16 * n).bitwiseAND(0xFFFF) for n in range(LENGTH)]
    total = reduce(lambda a, b: a + b, symbols)
    return [word.bitwiseXOR(F.shiftleft(s.bitwiseXOR((s - total).bitwiseAND(0xFFFF)), 16 * n)) for n, s in enumerate(symbols)]


def _salt(table: int) -> int:
    return int(np.uint64((table + 1) * 0x9E3779B97F4A7C15 % 2**64).astype(np.int64))


def _digest(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes())


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def sketches(sig: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words with two bits of each of SYMBOLS symbols; the upper 8 bits of the second are the size in eighths of a power of two."""
    bits = (sig[:, -SYMBOLS:] & np.uint32(3)).astype(np.uint64) << (np.arange(SYMBOLS, dtype=np.uint64) % np.uint64(32) * np.uint64(2))
    level = np.floor(8 * np.log2(size)).astype(np.uint64) << np.uint64(56)
    return np.bitwise_or.reduce(bits[:, :32], axis=1), np.bitwise_or.reduce(bits[:, 32:], axis=1) | level


def _fitting(batch: pa.RecordBatch, k: int, least: int) -> tuple[list[int], list[np.ndarray]]:
    sets = shingle_sets(batch.column(1).to_pylist(), k, least)
    rows = [n for n, s in enumerate(sets) if s is not None]
    return rows, [sets[n] for n in rows]


def _prints(batches: Iterator[pa.RecordBatch], k: int, least: int, tables: int) -> Iterator[pa.RecordBatch]:
    """(key, content, s1, s2, first, w0, w1 ...) of the texts with enough words: content names the shingle set, first is true once per set and batch."""
    for batch in batches:
        rows, sets = _fitting(batch, k, least)
        if not rows:
            continue
        content = np.array([_digest(s) for s in sets], np.uint64)
        _, at, where = np.unique(content, return_index=True, return_inverse=True)
        kept = [sets[n] for n in at]
        sig = signatures(kept, tables * LENGTH + SYMBOLS)  # the sketch has symbols of its own, as those of the fingerprints agree where texts meet
        s1, s2 = sketches(sig, np.array([len(s) for s in kept]))
        first = np.zeros(len(rows), bool)
        first[at] = True
        columns = {"content": _signed(content), "s1": _signed(s1[where]), "s2": _signed(s2[where]), "first": pa.array(first)}
        columns |= {f"w{t}": _signed(w[where]) for t, w in enumerate(words(sig, tables).T)}
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns.values()], ["key", *columns])


def _sets(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """(content, shingles) of the texts whose shingle set is the one asked for in the third column."""
    for batch in batches:
        rows, sets = _fitting(batch, k, least)
        asked = batch.column(2).to_pylist()
        got = [(asked[n], s.tobytes()) for n, s in zip(rows, sets) if np.uint64(_digest(s)).astype(np.int64) == asked[n]]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["content", "shingles"])


def _exact(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, similarity) of the pairs of shingle sets that have at least `threshold` of their union in common."""
    for batch in batches:
        rows, sims = [], []
        for n, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            union = len(x) + len(y) - both
            if both >= threshold * union - 1e-9:
                rows.append(n)
                sims.append(both / union)
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def most_unlike(threshold: float) -> int:
    """Symbols of the sketch that may differ between texts of this similarity."""
    differ = (1 - threshold) * 3 / 4
    return math.ceil(SYMBOLS * differ + DEVIATIONS * math.sqrt(SYMBOLS * differ * (1 - differ)))


def _unlike(a: Column, b: Column, mask: int) -> Column:
    """Two-bit symbols that differ between two sketch words."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(mask)))


def _fits(threshold: float) -> Column:
    """Whether x and y may have the threshold's similarity, by size and sketch."""
    level = lambda n: F.shiftrightunsigned(f"{n}.s2", 56)
    differ = _unlike(F.col("x.s1"), F.col("y.s1"), 0x5555555555555555) + _unlike(F.col("x.s2"), F.col("y.s2"), 0x0055555555555555)
    return (F.abs(level("x") - level("y")) <= math.ceil(8 * math.log2(1 / threshold))) & (differ <= most_unlike(threshold))


_BEFORE = "x.s1 < y.s1 or x.s1 = y.s1 and x.s2 < y.s2"
_ENDS = ("x.s1 as a1", "x.s2 as a2", "y.s1 as b1", "y.s2 as b2")


def meetings(prints: DataFrame, tables: int, threshold: float) -> DataFrame:
    """(a1, a2, b1, b2): the pairs of different sketches that fit each other and have an anchor in common."""
    names = [c.bitwiseXOR(F.lit(_salt(t))) for t in range(tables) for c in code_words(F.col(f"w{t}"))]
    at = prints.filter("first").select(F.explode(F.array(*names)).alias("anchor"), "s1", "s2")
    few = prints.filter("first").filter(F.pmod(F.xxhash64("s1", "s2"), F.lit(WEIGHED)) == 0).select(F.explode(F.array(*names)).alias("anchor"))
    hot = few.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * WEIGHED > HOT)
    hot = cut(hot.select("anchor", F.ceil(F.col("n") * WEIGHED / HOT).cast("int").alias("parts")))
    n_hot = hot.count()
    is_hot = bloom.might_contain(hot, bloom.build(hot, "anchor", items=n_hot), bloom.key_hash(F.col("anchor"))) if n_hot else F.lit(False)
    even = at.filter(~is_hot).repartition("anchor").distinct()  # one exchange: copies fall together before they are compared
    met = even.alias("x").join(even.alias("y"), (F.col("x.anchor") == F.col("y.anchor")) & F.expr(_BEFORE) & _fits(threshold)).selectExpr(*_ENDS)
    if n_hot:
        part = at.filter(is_hot).distinct().join(hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("parts")))
        part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1).cast("array<bigint>"))).select("anchor", "s1", "s2", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
        same = reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("anchor", "low", "high")])
        once = F.expr(f"x.own < y.own or x.low = x.high and ({_BEFORE})")
        found = part.alias("x").join(part.alias("y"), same & once & _fits(threshold))
        first = F.expr(_BEFORE)
        met = met.unionByName(found.select(*[F.when(first, F.col(f"{a}.{c}")).otherwise(F.col(f"{b}.{c}")).alias(f"{n}{c[1]}") for n, a, b in (("a", "x", "y"), ("b", "y", "x")) for c in ("s1", "s2")]))
    return met.distinct()


class NearDuplicates:
    """The linked texts of a table: `links` between representatives and `members` of each representative.

    links: (a, b, similarity), a < b names of shingle sets with similarity at or above the threshold. members: (key, content) of every text with at least
    `least_words` words. Null, empty and shorter texts are in neither, nor are rows with a null key. Texts with the same shingle set are one representative, whose copies are its
    members; keys repeated whole count once, a key with two texts is a member of both. Texts of any length are compared whole. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str, text: str, shingle: int = 5, threshold: float = 0.8, least_words: int = 0):
        kind = dict(df.dtypes)[key]
        slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t")).na.drop()
        tables = fingerprints(threshold)
        schema = f"key {kind}, content bigint, s1 bigint, s2 bigint, first boolean, " + ", ".join(f"w{t} bigint" for t in range(tables))
        prints = cut(slim.mapInArrow(lambda b: _prints(b, shingle, least_words, tables), schema))
        met = cut(meetings(prints, tables, threshold))
        self.members = prints.select("key", "content").distinct()
        reps = prints.groupBy("content", "s1", "s2").agg(F.min("key").alias("key"))
        end = lambda n: reps.select(F.col("s1").alias(f"{n}1"), F.col("s2").alias(f"{n}2"), F.col("content").alias(n), F.col("key").alias(f"k{n}"))
        close = met.join(end("a"), ["a1", "a2"]).join(end("b"), ["b1", "b2"]).select("a", "b", "ka", "kb")
        twin = end("a").join(end("b"), (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("a") < F.col("b"))).select("a", "b", "ka", "kb")
        close = cut(close.unionByName(twin))
        wanted = cut(close.select(F.col("a").alias("content"), F.col("ka").alias("key")).unionByName(close.select(F.col("b").alias("content"), F.col("kb").alias("key"))).distinct())
        # a filter of bounded size thins the second reading of the texts; the join does the rest
        held = bloom.build(wanted, "key")
        near = slim.filter(bloom.might_contain(slim, held, bloom.key_hash(F.col("key")))).join(wanted, "key").select("key", "t", "content")
        sets = near.mapInArrow(lambda b: _sets(b, shingle, least_words), "content bigint, shingles binary").dropDuplicates(["content"])
        pair = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        full = pair.join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("content").alias("b"), F.col("shingles").alias("sb")), "b")
        self.links = cut(full.select("a", "b", "sa", "sb").mapInArrow(lambda b: _exact(b, threshold), "a bigint, b bigint, similarity double"))

    def pairs(self) -> DataFrame:
        """(id_a, id_b) with id_a < id_b of all linked rows, copies included; for tables whose groups of copies are small, as each gives all its pairs."""
        m = self.members
        linked = self.links.join(m.withColumnRenamed("content", "a").withColumnRenamed("key", "k1"), "a").join(m.withColumnRenamed("content", "b").withColumnRenamed("key", "k2"), "b")
        apart = linked.select(F.least("k1", "k2").alias("id_a"), F.greatest("k1", "k2").alias("id_b"))
        copies = m.alias("m").join(m.alias("n"), (F.col("m.content") == F.col("n.content")) & (F.col("m.key") < F.col("n.key"))).select(F.col("m.key").alias("id_a"), F.col("n.key").alias("id_b"))
        return apart.filter("id_a < id_b").unionByName(copies).distinct()

    def groups(self, most_rounds: int = 30) -> DataFrame:
        """(key, group_id, n_links): one row per text in a group of at least two, the group named by its least representative, with the links of its representative."""
        both = cut(self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")))
        for _ in range(most_rounds):
            # hooking to the least neighbouring label, then to that label's own label, halves long chains
            near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            step = label.join(near, "a").select("a", F.least("label", "near").alias("label"), F.col("label").alias("was"))
            jump = step.select("a", "label", "was").join(step.select(F.col("a").alias("label"), F.col("label").alias("next")), "label", "left").select("a", F.least("label", F.coalesce("next", "label")).alias("label"), "was")
            jump = cut(jump)
            label = jump.select("a", "label")
            if jump.filter("label <> was").limit(1).count() == 0:
                break
        else:
            raise RuntimeError("components did not settle; raise most_rounds")
        degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
        copies = self.members.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
        named = self.members.join(label.join(degree, "a").withColumnRenamed("a", "content"), "content", "left").join(copies, "content")
        return named.filter(F.col("label").isNotNull() | (F.col("n") > 1)).select("key", F.coalesce("label", "content").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
