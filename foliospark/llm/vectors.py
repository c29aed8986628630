"""The most similar vectors of every vector (problem 1).

*Collision-counting hashing*: a vector is projected on single random lines; on each line the values are a
sorted array, in which a window centred at the query is expanded step by step (virtual rehashing).  A
vector that falls into the windows of at least ``THRESHOLD`` of the ``LINES`` lines is verified.  Expansion
stops for a query once it has k verified neighbours inside the current radius, and for all at the radius of
*least_cosine*.

Windows of single lines hold a fixed share of all vectors, so counting over the whole collection is
quadratic.  Vectors are therefore routed first: in each of ``TABLES`` tables a vector goes to its
``PROBES`` best cells of a product of two random direction codes, whose number of cells follows the number
of vectors.  The arrays are kept per cell.  Measured recall: README.

Vectors travel as 8-bit codes; the final cosines are taken from the vectors themselves.  All candidates that the codes'
error lets be among the k most similar go on to that.  Where these are many (groups of very close vectors), the vectors
themselves travel to the cells in question, and the k most similar are chosen there exactly.

Defined results for odd input: null, all-zero, non-finite vectors and vectors of another than the most
common length take no part; repeated rows of one id count once; equal vectors form classes, of which one
representative is searched (so a large group of copies is no hot cell); ties go to the smaller id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.skew import partitions, split_hot

TABLES, PROBES, PER_CELL = 6, 3, 72
LINES, THRESHOLD, WIDTH = 24, 16, 1.5
HOT_CELL = 6_000  # a pair of parts stays below the 2^16 ranks of the counting arrays
TASK_ROWS = 250_000  # routed rows a task holds
BASE_ERROR, ERROR = 1e-4, 0.006  # of a cosine by 8-bit codes: a part, and a part that falls with the distance
PLACES = 16  # candidates of a query that are passed on; with more a query is crowded
MARK = 2.0
_EDGE = "a long, b long, cosine double"


def _matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): usable vectors of an Arrow list column."""
    import pyarrow as pa
    import pyarrow.compute as pc

    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.filter(ok)) if len(rows) else pa.array([], pa.float32())
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], v[good] / norm[good, None]


def _codes(table: int, side: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(1000 + table))
    out = []
    for _ in range(2):
        g = rng.standard_normal((dim, side)).astype(np.float32)
        out.append(g / np.linalg.norm(g, axis=0))
    return out[0], out[1]


def cells(v: np.ndarray, table: int, side: int, probes: int = PROBES) -> np.ndarray:
    """The *probes* best cells of each vector, as numbers below side x side."""
    a, b = _codes(table, side, v.shape[1])
    sa, sb = v @ a, v @ b
    k = min(3, side)
    ta, tb = np.argpartition(-sa, k - 1, axis=1)[:, :k], np.argpartition(-sb, k - 1, axis=1)[:, :k]
    score = (np.take_along_axis(sa, ta, 1)[:, :, None] + np.take_along_axis(sb, tb, 1)[:, None, :]).reshape(len(v), -1)
    cell = (ta[:, :, None] * side + tb[:, None, :]).reshape(len(v), -1)
    p = min(probes, cell.shape[1])
    best = np.argpartition(-score, p - 1, axis=1)[:, :p]
    return np.take_along_axis(cell, best, 1)


def _router(dim: int, side: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, v = _matrix(b.column(1), dim)
            if not len(rows):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)[rows]
            v32 = v.astype(np.float32)
            scale = np.abs(v32).max(axis=1, keepdims=True) / 127
            code = np.ascontiguousarray(np.rint(v32 / scale).astype(np.int8))
            for t in range(TABLES):
                c = cells(v32, t, side)
                key = (c.astype(np.int64) * TABLES + t).ravel()
                who = np.repeat(np.arange(len(ids)), c.shape[1])
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(who), [None, pa.py_buffer(code[who].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[who]), data], names=["cell", "id", "code"])

    return run


def collision_neighbours(x: np.ndarray, ask: np.ndarray, k: int, least_cosine: float, lines: np.ndarray, block: int = 1024):
    """Yields (query rows, member rows, cosines): up to k neighbours of each query of one cell.

    *ask* marks queries that meet the other rows only; without any, all rows meet all rows.
    """
    mixed = bool(ask.any())
    queries, members = (np.flatnonzero(ask), np.flatnonzero(~ask)) if mixed else (np.arange(len(x)),) * 2
    if mixed:  # both directions
        yield from _directed(x, queries, members, k, least_cosine, lines, block)
        yield from _directed(x, members, queries, k, least_cosine, lines, block)
    elif len(x) > 1:
        yield from _directed(x, queries, members, k, least_cosine, lines, block)


def _directed(x, queries, members, k, least_cosine, lines, block):
    if not len(queries) or not len(members):
        return
    m = x[members]
    proj = m @ lines  # members x LINES
    order = np.argsort(proj, axis=0, kind="stable")
    rank = np.empty(order.shape, np.uint16)
    np.put_along_axis(rank, order, np.arange(len(m), dtype=np.uint16)[:, None], axis=0)
    rank = np.ascontiguousarray(rank.T)
    arrays = np.ascontiguousarray(np.take_along_axis(proj, order, axis=0).T)
    last = float(np.sqrt(max(0.0, 2 - 2 * least_cosine)))
    radii = [last / 3, last] if last > 0 else [1e-6]
    crowded = len(members) > k + 2  # whether small radii can settle queries here; learned from the first block
    size = min(64, block)
    p = 0
    while p < len(queries):
        open_q = queries[p : p + size]
        p, size = p + size, block
        settled = 0
        for r in radii if crowded else radii[-1:]:  # virtual rehashing: the same arrays, wider windows
            at = x[open_q] @ lines
            w = WIDTH * r
            count = np.zeros((len(open_q), len(m)), np.int8)
            place, inside = np.empty(count.shape, np.uint16), np.empty(count.shape, bool)
            for j in range(lines.shape[1]):
                lo = np.searchsorted(arrays[j], at[:, j] - w)
                hi = np.searchsorted(arrays[j], at[:, j] + w, side="right")
                # rank in [lo, hi): the difference is taken modulo 2^16, so one comparison does
                np.subtract(rank[j][None, :], lo.astype(np.uint16)[:, None], out=place)
                np.less(place, (hi - lo).astype(np.uint16)[:, None], out=inside)
                np.add(count, inside.view(np.int8), out=count)
            a, b = np.nonzero(count >= THRESHOLD)
            other = open_q[a] != members[b]
            a, b = a[other], b[other]
            cos = np.einsum("ij,ij->i", x[open_q[a]], m[b]) if len(a) else np.empty(0, np.float32)
            near = cos >= (1 - r * r / 2) - 0.01  # 0.01: the codes' error, the exact cosine is taken later
            a, b, cos = a[near], b[near], cos[near]
            found = np.bincount(a, minlength=len(open_q))
            done = (found > k + 2) | (r == last)
            take = done[a]
            if take.any():
                yield _in_reach(open_q, members, a[take], b[take], cos[take], k)
            settled += int(done.sum()) if r < last else 0
            open_q = open_q[~done]
            if not len(open_q):
                break
        crowded = crowded and settled > 0


def _in_reach(queries, members, a, b, cos, k):
    """(queries, members, cosines, crowded) of the candidates that the codes' error lets be among the k most similar: the
    k best by code, and all whose code cosine is below the k-th by no more than the error.  Queries with more
    than ``PLACES`` of them are crowded: codes cannot tell these apart."""
    order = np.lexsort((b, -cos, a))
    a, b, cos = a[order], b[order], cos[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.append(first, len(a)))
    kth = cos[first + np.minimum(size, k) - 1]
    reach = np.repeat(kth - BASE_ERROR - ERROR * np.sqrt(np.maximum(0, 2 - 2 * kth)), size)
    keep = cos >= reach
    n = np.add.reduceat(keep.astype(int), first)
    crowded = np.repeat(n > PLACES, size)[keep]
    return queries[a[keep]], members[b[keep]], cos[keep], crowded


def _cell_search(dim: int, k: int, least_cosine: float):
    def run(batches):
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(pa.concat_arrays([b.column(2)]).buffers()[2], np.int8)[: b.num_rows * dim].reshape(-1, dim).copy(), b.column(3).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not got:
            return
        cell, ids, code, asks = (np.concatenate(c) for c in zip(*got))
        del got
        lines = np.random.Generator(np.random.PCG64(7)).standard_normal((dim, LINES)).astype(np.float32)
        order = np.lexsort((ids, cell))
        cell, ids = cell[order], ids[order]
        fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (ids[1:] != ids[:-1])])  # redelivered rows once
        order, cell, ids = order[fresh], cell[fresh], ids[fresh]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        outs, size = [], 0
        for p, q in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
            if q - p < 2:
                continue
            x = code[order[p:q]].astype(np.float32)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            many: list[np.ndarray] = []
            for a, b, cos, crowded in collision_neighbours(x, asks[order[p:q]], k, least_cosine, lines):
                if crowded.any():
                    many.append(np.unique(np.concatenate([a[crowded], b[crowded]])))
                    a, b, cos = a[~crowded], b[~crowded], cos[~crowded]
                outs.append((ids[p + a], ids[p + b], cos.astype(np.float64)))
                size += len(a)
            if many:  # marked by the cosine 2: they meet again as they are
                who = ids[p + np.unique(np.concatenate(many))]
                outs.append((np.full(len(who), cell[p]), who, np.full(len(who), MARK)))
                size += len(who)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*outs)], names=["a", "b", "cosine"])
                outs, size = [], 0
        if outs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*outs)], names=["a", "b", "cosine"])

    return run


def _crowd_search(dim: int, k: int, least_cosine: float):
    """The k most similar of each other among the marked rows (cell, id, vector) of every cell, by their vectors."""

    def run(batches):
        import pyarrow as pa

        got = [(b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows], v) for b in batches if b.num_rows for rows, v in [_matrix(b.column(2), dim)]]
        if not got:
            return
        cell, ids, v = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((ids, cell))
        cell, ids, v = cell[order], ids[order], v[order]
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        for p, q in zip(starts.tolist(), np.append(starts[1:], len(cell)).tolist()):
            x, who = v[p:q], ids[p:q]
            m = min(k, len(who) - 1)
            for i in range(0, len(who), 512) if m > 0 else ():
                s = x[i : i + 512] @ x.T
                s[np.arange(len(s)), np.arange(i, i + len(s))] = -2.0
                kth = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                a, b = np.nonzero((s >= np.maximum(kth, least_cosine)[:, None] - 1e-9) & (s > -2.0))
                order = np.lexsort((b, -s[a, b], a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
                best = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < m
                a, b = a[best], b[best]
                yield pa.RecordBatch.from_arrays([pa.array(who[i + a]), pa.array(who[b]), pa.array(s[a, b])], names=["a", "b", "cosine"])

    return run


def _exact(dim: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            ra, va = _matrix(b.column(2), dim)
            rb, vb = _matrix(b.column(3), dim)  # both sides are usable: they were routed
            cos = np.einsum("ij,ij->i", va, vb)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(cos, 1.0))], names=["a", "b", "cosine"])

    return run


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(rows id, v), number of rows and the most common length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.exists("v", lambda x: x != 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows, lengths[1] if lengths else 0, lengths[0] if lengths else 0


def similar_vectors(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, least_cosine: float = 0.85) -> DataFrame:
    """Columns id, neighbour, cosine, place: of each vector its up to *k* most similar others with at least
    *least_cosine*, place 1 the most similar."""
    rows, n, dim = _usable(vectors, id_col, vec_col)
    if not n:
        return rows.select("id", F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"), F.lit(1).alias("place")).limit(0)
    side = int(max(4, round((n / PER_CELL) ** 0.5)))
    by_vector = rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).groupBy("h1", "h2")
    # copies: classes of equal vectors; the representative is the least id
    many = by_vector.agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep <> top").select("h1", "h2", "rep")
    member_of = cut(rows.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).join(many, ["h1", "h2"]).select("id", "rep").dropDuplicates(["id"]))
    reps = rows.join(member_of.where("id <> rep").select("id"), "id", "left_anti")
    routed = split_hot(reps.mapInArrow(_router(dim, side), "cell long, id long, code binary"), "cell", "id", HOT_CELL, n * TABLES * PROBES)
    parts = partitions(reps.sparkSession, n * TABLES * PROBES, TASK_ROWS)
    rough = cut(routed.repartition(parts, "cell").mapInArrow(_cell_search(dim, k, least_cosine), _EDGE))
    # vectors that codes cannot tell apart meet in their cells once more, as they are; each cell names a row once
    marked = rough.where(F.col("cosine") == MARK).select(F.col("a").alias("cell"), F.col("b").alias("id")).distinct()
    vectors_of = marked.join(reps.groupBy("id").agg(F.first("v").alias("v")), "id").select("cell", "id", "v")
    close = vectors_of.repartition("cell").mapInArrow(_crowd_search(dim, k, least_cosine), _EDGE)
    near = rough.where(F.col("cosine") < MARK).unionByName(close)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).dropDuplicates(["a", "b"])
    once = reps.groupBy("id").agg(F.first("v").alias("v"))
    both = pairs.join(once.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(once.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb")
    exact = both.mapInArrow(_exact(dim), _EDGE).where(F.col("cosine") >= least_cosine)
    edges = exact.select("a", "b", "cosine").unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    edges = _expanded(edges, member_of, k)
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return edges.where("a <> b").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "place")


def _expanded(edges: DataFrame, member_of: DataFrame, k: int) -> DataFrame:
    """Edges between representatives, carried over to the members of their classes: every member meets at most
    the k + 1 first members of a class, found by salted ranking."""
    if member_of.isEmpty():
        return edges
    salted = Window.partitionBy("rep", "salt").orderBy("id")
    firsts = member_of.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    firsts = firsts.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("rep", "id")
    inside = member_of.select("rep", F.col("id").alias("a")).join(firsts.select("rep", F.col("id").alias("b")), "rep").where("a <> b").select("a", "b", F.lit(1.0).alias("cosine"))
    to_b = edges.join(firsts.select(F.col("rep").alias("b"), F.col("id").alias("b2")), "b", "left").select("a", F.coalesce("b2", "b").alias("b"), "cosine")
    to_a = to_b.join(member_of.select(F.col("rep").alias("a"), F.col("id").alias("a2")), "a", "left").select(F.coalesce("a2", "a").alias("a"), "b", "cosine")
    return to_a.unionByName(inside)


def similar_vector_pairs(vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, least_cosine: float = 0.85) -> DataFrame:
    """Columns id_a < id_b: pairs in which one is among the k most similar of the other."""
    near = similar_vectors(vectors, id_col, vec_col, k, least_cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).dropDuplicates(["id_a", "id_b"])


QUERY_BLOCK = 2048


def nearest_of_queries(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 5) -> DataFrame:
    """Columns query_id, neighbour, cosine, place: the *k* most similar rows of a stated set of queries, at any cosine.

    Below a cosine of about 0.6 the windows of single lines hold nearly all vectors, so counting tells nothing; here
    blocks of queries meet all rows by matrix products, exactly.  A block of at most about QUERY_BLOCK queries is
    broadcast, and every batch of rows passes on its k best for each query only.
    """
    spark = vectors.sparkSession
    rows, n, dim = _usable(vectors, id_col, vec_col)
    schema = "query_id long, neighbour long, cosine double"
    asked, total, _ = _usable(queries, id_col, vec_col)
    if not n or not total:
        return spark.createDataFrame([], schema + ", place int")
    parts = -(-total // QUERY_BLOCK)
    out = None
    for p in range(parts):
        got = asked.where((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == p)).dropDuplicates(["id"]).collect()
        if not got:
            continue
        got.sort(key=lambda r: r["id"])
        q = np.array([r["v"] for r in got], np.float64)
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in got], np.int64), q / np.sqrt((q * q).sum(axis=1, keepdims=True))))

        def run(batches, shared=shared):
            import pyarrow as pa

            qid, q = shared.value
            for b in batches:
                at, v = _matrix(b.column(1), dim)
                if not len(at):
                    continue
                rid = b.column(0).to_numpy(zero_copy_only=False)[at]
                keep = np.sort(np.unique(rid, return_index=True)[1])  # redelivered rows once
                rid, v = rid[keep], v[keep]
                s = np.minimum(q @ v.T, 1.0)
                s[qid[:, None] == rid[None, :]] = -2.0
                m = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                a, c = np.nonzero((s >= (least - 1e-9)[:, None]) & (s > -2.0))
                order = np.lexsort((rid[c], -s[a, c], a))
                a, c = a[order], c[order]
                if not len(a):
                    continue
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                best = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < m
                a, c = a[best], c[best]
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(rid[c]), pa.array(s[a, c])], names=["query_id", "neighbour", "cosine"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour")
    return out.dropDuplicates(["query_id", "neighbour"]).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
