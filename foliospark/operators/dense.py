"""Nearest vectors: exact scans with pushed-down filters, batches of queries, and a partitioned index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, d: s + d)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is all zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(rows: DataFrame, query: DataFrame, k: int, metric: str = "l2", id_col: str = "chunk_id", vec_col: str = "embeddings", fetch: int = 3) -> DataFrame:
    """The *k* nearest rows of one query vector (a one-row frame with column q), columns of *rows* and distance.

    *fetch* x k are taken before k are kept, as in two-stage retrieval; ties go to the smaller id.  Rows with
    vectors of another length or none drop out.
    """
    one = F.broadcast(query.limit(1))
    near = rows.where(F.col(vec_col).isNotNull()).crossJoin(one).where(F.size(vec_col) == F.size("q"))
    measure = l2 if metric == "l2" else cosine_distance
    scored = near.withColumn("distance", measure(F.col(vec_col), F.col("q"))).drop("q", vec_col).where("distance is not null")
    return scored.orderBy("distance", id_col).limit(fetch * k).orderBy("distance", id_col).limit(k)


QUERY_BLOCK = 4096


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "chunk_id", vec_col: str = "embeddings", query_id: str = "query_id") -> DataFrame:
    """The *k* nearest rows (L2) for every query (query_id, q): columns query_id, id, distance, place.

    Queries are a stated set, taken in blocks of QUERY_BLOCK that are broadcast; every block is a scan of the rows in
    which each batch keeps its k best ids by one matrix product, so about k rows per query and batch are shuffled.
    An id on several rows counts once, with the nearest of them.
    """
    spark = rows.sparkSession
    qs = queries.select(F.col(query_id).cast("long").alias("i"), "q").where("q is not null").dropDuplicates(["i"])
    n = qs.count()
    schema = "query_id long, id long, distance double"
    out = None
    parts = -(-n // QUERY_BLOCK)
    for p in range(parts):
        block = qs.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect() if parts > 1 else qs.collect()
        block.sort(key=lambda r: r["i"])
        if not block:
            continue
        ids = np.array([r["i"] for r in block], np.int64)
        mat = np.array([r["q"] for r in block], np.float64)
        shared = spark.sparkContext.broadcast((ids, mat))

        def run(batches, shared=shared):
            import pyarrow as pa
            import pyarrow.compute as pc

            qi, q = shared.value
            qq = (q * q).sum(axis=1)
            for b in batches:
                col = b.column(1)
                ok = pc.fill_null(pc.equal(pc.list_value_length(col), q.shape[1]), False)
                at = np.flatnonzero(ok.to_numpy(zero_copy_only=False))
                if not len(at):
                    continue
                v = pc.list_flatten(col.filter(ok)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
                rid = b.column(0).to_numpy(zero_copy_only=False)[at]
                by_id = np.argsort(rid, kind="stable")
                rid, v = rid[by_id], v[by_id]
                d = np.maximum(qq[:, None] - 2 * q @ v.T + (v * v).sum(axis=1)[None, :], 0)
                starts = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
                of_id = d if len(starts) == len(rid) else np.minimum.reduceat(d, starts, axis=1)
                m = min(k, of_id.shape[1])
                limit = np.partition(of_id, m - 1, axis=1)[:, m - 1]
                near = d <= (limit + 1e-6 * (1 + limit))[:, None]  # with ties and the rounding of the product
                iq, iv = np.nonzero(near)
                exact = np.sqrt(((q[iq] - v[iv]) ** 2).sum(axis=1))
                if len(starts) < len(rid):  # repeated ids: the nearest row of each
                    order = np.lexsort((exact, rid[iv], iq))
                    iq, iv, exact = iq[order], iv[order], exact[order]
                    once = np.concatenate([[True], (iq[1:] != iq[:-1]) | (rid[iv[1:]] != rid[iv[:-1]])])
                    iq, iv, exact = iq[once], iv[once], exact[once]
                order = np.lexsort((rid[iv], exact, iq))
                iq, iv, exact = iq[order], iv[order], exact[order]
                first = np.flatnonzero(np.concatenate([[True], iq[1:] != iq[:-1]]))
                keep = np.arange(len(iq)) - np.repeat(first, np.diff(np.append(first, len(iq)))) < m + 2
                yield pa.RecordBatch.from_arrays([pa.array(qi[iq[keep]]), pa.array(rid[iv[keep]]), pa.array(exact[keep])], names=["query_id", "id", "distance"])

        part = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema + ", place int")
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.groupBy("query_id", "id").agg(F.min("distance").alias("distance")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


class PartitionedIndex:
    """Vectors by their nearest centre: a probe reads only the partitions of the centres nearest to the query.

    Centres are fitted on a bounded sample (k-means, at most *sample* rows); every row is indexed.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    @classmethod
    def fit(cls, rows: DataFrame, vec_col: str, k: int = 128, sample: int = 20_000, rounds: int = 12, seed: int = 1) -> PartitionedIndex:
        got = rows.where(F.col(vec_col).isNotNull()).orderBy(F.xxhash64(vec_col)).select(vec_col).limit(sample).collect()
        x = np.array([r[0] for r in got], np.float32)
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
            for j in range(len(centres)):
                if (near == j).any():
                    centres[j] = x[near == j].mean(axis=0)
        return cls(centres)

    def assign(self, rows: DataFrame, vec_col: str) -> DataFrame:
        """Adds the centroid of each row."""
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()).astype(np.float32)
            return pd.Series(((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1).astype(np.int32))

        return rows.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == self.centres.shape[1])).withColumn("centroid", nearest(vec_col))

    def write(self, rows: DataFrame, vec_col: str, path: str) -> None:
        self.assign(rows, vec_col).repartition("centroid").write.mode("overwrite").partitionBy("centroid").parquet(path)

    def probes(self, query: list[float], n: int = 10) -> list[int]:
        q = np.array(query, np.float32)
        return ((self.centres - q) ** 2).sum(axis=1).argsort(kind="stable")[:n].tolist()

    def search(self, indexed: DataFrame, query: list[float], k: int, n_probe: int = 10, id_col: str = "chunk_id", vec_col: str = "embeddings") -> DataFrame:
        """Approximate top k: only partitions of the nearest centres are read."""
        spark = indexed.sparkSession
        part = indexed.where(F.col("centroid").isin(self.probes(query, n_probe)))
        return top_k(part, spark.createDataFrame([(list(map(float, query)),)], "q array<double>"), k, "l2", id_col, vec_col)
