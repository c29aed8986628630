"""Groups of texts that share most of their content (problem 5).

1. Equal normalized texts form classes; one representative of each goes on.
2. A representative gets 128 min-hashes of its windows of 20 characters.  One bit of each makes a
   128-bit sketch whose Hamming distance falls with the similarity.
3. Bands of three min-hashes name the *shards* a text belongs to, and in its shards a text is compared with the
   others by sketch.  A shard of more than ``LEAF`` texts is a *BK-tree* (children keyed by their integer Hamming
   distance to the parent, only edges within the radius are followed); smaller ones are compared flat.  One tree over
   all texts prunes nothing at the radius of these similarities (figures in the README), so the bands are
   what keeps the work small.  Shards that hold very many texts are split: every part indexes its share and all queries
   of the shard visit all parts.
4. Pairs within the radius are verified by the exact similarity of their window sets.

With three rows and 42 bands a pair of similarity 0.6 shares no shard with a chance of 4e-5.  For other
thresholds or far larger collections more rows a band keep shards small; both are parameters.

Defined results for odd input: null texts, and texts with fewer than *least* characters left, take no part;
repeated rows of one id count once; equal texts have similarity 1; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.skew import partitions, split_hot

WINDOW, HASHES, ROWS, BANDS = 20, 128, 3, 42
LEAF = 192
HOT_SHARD = 20_000
TASK_ROWS = 500_000  # shard rows a task holds
COPIES = 4096
_DROP = {ord(c): None for c in " \t\n\r"}
_B = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def normalized(text: str) -> str:
    return text.translate(_DROP).lower()


def window_hashes(text: str, n: int = WINDOW) -> np.ndarray:
    """64-bit hashes of all windows of n characters, by doubling: 1, 2, 4, 8, 16 and 16 + 4."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(c) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power, levels = _U(_B), {1: c + _U(1)}
        k, h = 1, levels[1]
        powers = {1: power}
        while 2 * k <= n:
            h = h[: len(h) - k] * powers[k] + h[k:]
            powers[2 * k] = powers[k] * powers[k]
            k *= 2
            levels[k] = h
        at, rest = k, n - k
        while rest:
            k = 1 << (rest.bit_length() - 1)
            m = len(c) - at - k + 1
            h = h[:m] * powers[k] + levels[k][at : at + m]
            at, rest = at + k, rest - k
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        return h ^ (h >> _U(32))


@lru_cache(maxsize=1)
def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return (rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def min_hashes(windows: np.ndarray) -> np.ndarray:
    a, b = _coefficients()
    x = np.unique((windows >> _U(32)).astype(np.uint32)) if len(windows) > 4096 else (windows >> _U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        v = a * x[k : k + 2048]
        v += b
        np.minimum(out, v.min(axis=1), out=out)
    return out


def _mix(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = v.astype(np.uint64) * _U(0xFF51AFD7ED558CCD)
        v ^= v >> _U(33)
        v *= _U(0xC4CEB9FE1A85EC53)
        return v ^ (v >> _U(29))


def sketch_and_bands(mh: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> tuple[int, int, np.ndarray]:
    bits = np.packbits((_mix(mh) >> _U(40)).astype(np.uint8) & 1).view(np.int64)
    m = mh[: rows * bands].reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.arange(bands, dtype=np.uint64) + _U(77)
        for k in range(rows):
            h = _mix(h ^ (m[:, k] + _U(0x9E3779B9)))
    return int(bits[0]), int(bits[1]), h.view(np.int64)


def radius_for(similarity: float, sigmas: float = 3.7) -> int:
    """Hamming distance that a pair of this similarity stays within."""
    p = (1 - similarity) / 2
    return int(np.ceil(HASHES * p + sigmas * np.sqrt(HASHES * p * (1 - p))))


def _far(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.bitwise_count(s[:, 0] ^ q[0]).astype(np.int16) + np.bitwise_count(s[:, 1] ^ q[1])


class BKTree:
    """BK-tree on 128-bit sketches (n x 2 uint64): a pivot, children by integer distance, flat leaves."""

    def __init__(self, sketches: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF):
        self.s = sketches
        self.members = np.arange(len(sketches)) if members is None else members
        self.children: dict[int, BKTree] = {}
        self.pivot = -1
        if len(self.members) > leaf:
            self.pivot = int(self.members[0])
            rest = self.members[1:]
            d = _far(sketches[rest], sketches[self.pivot])
            if d.max() == d.min():  # nothing to tell apart: a flat leaf
                self.pivot = -1
            else:
                order = np.argsort(d, kind="stable")
                keys, starts = np.unique(d[order], return_index=True)
                for k, part in zip(keys.tolist(), np.split(rest[order], starts[1:])):
                    self.children[k] = BKTree(sketches, part, leaf)

    def within(self, queries: np.ndarray, among: np.ndarray, radius: int):
        """Yields arrays (query index, member index) of the pairs within the radius."""
        if not len(among) or not len(self.members):
            return
        if self.pivot < 0:
            for k in range(0, len(among), 512):
                q = among[k : k + 512]
                d = np.bitwise_count(queries[q, 0][:, None] ^ self.s[self.members, 0]).astype(np.int16) + np.bitwise_count(queries[q, 1][:, None] ^ self.s[self.members, 1])
                a, b = np.nonzero(d <= radius)
                yield q[a], self.members[b]
            return
        d = _far(queries[among], self.s[self.pivot])
        hit = among[d <= radius]
        if len(hit):
            yield hit, np.full(len(hit), self.pivot)
        for k, child in self.children.items():
            yield from child.within(queries, among[np.abs(d - k) <= radius], radius)


def class_sketches(texts: DataFrame, id_col: str, text_col: str, least: int, rows: int, bands: int) -> DataFrame:
    """(id, same, s0, s1, bands): sketches of texts that take part; *same* is the hash of the normalized text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            ids, same, s0, s1, bs = [], [], [], [], []
            for cid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if cid is None or t is None:
                    continue
                t = normalized(t)
                if len(t) < max(least, WINDOW):
                    continue
                x, y, h = sketch_and_bands(min_hashes(window_hashes(t)), rows, bands)
                ids.append(cid)
                same.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                s0.append(x)
                s1.append(y)
                bs.append(h)
            flat = pa.array(np.concatenate(bs) if bs else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(same, pa.binary()), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), lists], names=["id", "same", "s0", "s1", "bands"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, same binary, s0 long, s1 long, bands array<long>")


def _shard_pairs(radius: int):
    def run(batches):
        import pyarrow as pa

        cols = [[], [], [], [], []]
        for b in batches:
            for k in range(5):
                cols[k].append(b.column(k).to_numpy(zero_copy_only=False))
        if not cols[0]:
            return
        key, ids, s0, s1, asks = (np.concatenate(c) for c in cols)
        order = np.argsort(key, kind="stable")
        key, ids, asks = key[order], ids[order], asks[order]
        s = np.stack([s0[order].view(np.uint64), s1[order].view(np.uint64)], axis=1)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        size = ends - starts
        if (a := starts[size == 2]).size:  # shards of two, all at once
            d = np.bitwise_count(s[a, 0] ^ s[a + 1, 0]).astype(np.int16) + np.bitwise_count(s[a, 1] ^ s[a + 1, 1])
            a = a[d <= radius]
            yield _batch(pa, ids, a, a + 1)
        for k in np.flatnonzero(size > 2).tolist():
            p, q = int(starts[k]), int(ends[k])
            part = s[p:q]
            ask = asks[p:q]
            tree = BKTree(part, np.flatnonzero(~ask))
            for a, b in tree.within(part, np.flatnonzero(ask) if ask.any() else np.arange(q - p), radius):
                yield _batch(pa, ids, p + a, p + b)

    return run


def _batch(pa, ids, a, b):
    x, y = ids[a], ids[b]
    keep = x != y
    lo, hi = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
    return pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["id_a", "id_b"])


def shard_rows(reps: DataFrame, n: int = 0, hot: int = HOT_SHARD) -> DataFrame:
    """(shard, id, s0, s1, asks): a row for each band; shards of more than *hot* texts are split by pairs of parts."""
    rows = reps.select(F.explode("bands").alias("shard"), "id", "s0", "s1")
    return split_hot(rows, "shard", "id", hot, n)


def similar_classes(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.6, least: int = 120, rows: int = ROWS, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).  pairs: id_a < id_b and similarity, between class representatives.  members: id and
    its class id (the least id with the same normalized text)."""
    sk = cut(class_sketches(texts, id_col, text_col, least, rows, bands).dropDuplicates(["id"]))
    members = sk.groupBy("same").agg(F.min("id").alias("class_id")).join(sk.select("id", "same"), "same").select("id", "class_id")
    reps = sk.join(members.where("id = class_id").select("id"), "id", "left_semi")
    n = sk.count() * bands
    parts = partitions(sk.sparkSession, n, TASK_ROWS)
    near = shard_rows(reps, n).repartition(parts, "shard").mapInArrow(_shard_pairs(radius_for(similarity)), "id_a long, id_b long").dropDuplicates(["id_a", "id_b"])
    body = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t is not null").dropDuplicates(["id"])
    with_a = near.join(body.select(F.col("id").alias("id_a"), F.col("t").alias("ta")), "id_a")
    both = with_a.join(body.select(F.col("id").alias("id_b"), F.col("t").alias("tb")), "id_b").select("id_a", "id_b", "ta", "tb")

    def verify(batches):
        import pyarrow as pa

        for b in batches:
            xs, ys, sims = [], [], []
            for i, j, ta, tb in zip(*(b.column(k).to_pylist() for k in range(4))):
                wa, wb = np.unique(window_hashes(normalized(ta))), np.unique(window_hashes(normalized(tb)))
                both_n = len(np.intersect1d(wa, wb, assume_unique=True))
                sim = both_n / (len(wa) + len(wb) - both_n)
                if sim >= similarity:
                    xs.append(i)
                    ys.append(j)
                    sims.append(sim)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(sims, pa.float64())], names=["id_a", "id_b", "similarity"])

    return both.mapInArrow(verify, "id_a long, id_b long, similarity double"), members


def similar_pairs(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.6, least: int = 120) -> DataFrame:
    """Columns id_a < id_b: all pairs of ids, copies expanded."""
    pairs, members = similar_classes(texts, id_col, text_col, similarity, least)
    # the result asked for has all pairs of copies; a class of very many is split by pairs of parts of COPIES rows
    copies = members.join(members.groupBy("class_id").count().where("count > 1").select("class_id", F.ceil(F.col("count") / COPIES).cast("int").alias("n")), "class_id")
    copies = copies.withColumn("home", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    copies = copies.select("class_id", "id", "home", F.least("home", "part").alias("lo"), F.greatest("home", "part").alias("hi"))
    same = copies.alias("x").join(copies.alias("y"), ["class_id", "lo", "hi"]).where("x.id < y.id and (lo = hi or x.home <> y.home)").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    left, right = members.select(F.col("class_id").alias("id_a"), F.col("id").alias("a")), members.select(F.col("class_id").alias("id_b"), F.col("id").alias("b"))
    across = pairs.join(left, "id_a").join(right, "id_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    return across.unionByName(same)


def similar_groups(texts: DataFrame, id_col: str, text_col: str, similarity: float = 0.6, least: int = 120) -> DataFrame:
    """One row per text: id, class_id and links, the number of other classes its class is similar to."""
    pairs, members = similar_classes(texts, id_col, text_col, similarity, least)
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
