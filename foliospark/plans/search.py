"""One search call over an ingested table: mode, filters, number of hits, reranking and threshold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.models import embed_udf, hashed_embedding, overlap_score
from ..functions.text import word_tokens
from ..operators import dense, hybrid, sparse
from ..operators.selection import exact_filter, loose_filter, threshold_or_zero
from ..sources.sinks import read_table, upsert_table


@dataclass(frozen=True)
class Store:
    """A table of chunks with vectors, and its stored sparse index."""

    path: str

    def ingest(self, chunks: DataFrame, embed: Callable = hashed_embedding, order: str | None = None) -> DataFrame:
        """Embeds and upserts chunks (chunk_id, page_content, ...), then fits the sparse index anew; returns the table."""
        spark = chunks.sparkSession
        upsert_table(chunks.withColumn("embeddings", embed_udf(embed)(F.col("page_content"))), f"{self.path}/chunks", "chunk_id", order)
        rows = self.chunks(spark)
        sparse.save_index(sparse.tokenized(rows, "chunk_id", "page_content"), f"{self.path}/sparse")
        return rows

    def chunks(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, f"{self.path}/chunks")

    def search(
        self, spark: SparkSession, question: str, mode: str = "hybrid", filters: dict[str, str | None] | None = None, k: int = 10, r: int = 3,
        use_reranker: bool = True, threshold: float = 0.0, embed: Callable = hashed_embedding, rerank: Callable = overlap_score, scorer: str = "bm25",
    ) -> DataFrame:
        """The hits of a question, best first (column place), with their score.

        Dense hits are filtered exactly before the k nearest are taken; sparse ones loosely after the first 3k are.
        Then the r best by the reranker stay (without one the first r), and of these those of at least the threshold.
        """
        if mode not in hybrid.MODES:
            raise ValueError(f"search mode must be one of {', '.join(hybrid.MODES)}")
        rows, filters = self.chunks(spark), filters or {}
        asked = spark.createDataFrame([(question,)], "question string")
        near = words = None
        if mode != "sparse":
            query = asked.select(embed_udf(embed)(F.col("question")).alias("q"))
            near = dense.top_k(rows.where(exact_filter(filters)), query, k).select(F.col("chunk_id").alias("id"), F.col("distance").alias("score"))
            near = near.withColumn("place", F.row_number().over(Window.orderBy("score", "id")))
        if mode != "dense":
            index = sparse.SparseIndex.load(spark, f"{self.path}/sparse")
            tokens = asked.select(word_tokens(F.col("question")).alias("tokens"))
            scores = sparse.indexed_bm25(index, tokens) if scorer == "bm25" else sparse.indexed_tfidf(index, tokens)
            best = sparse.top_k(scores, k)
            labels = rows.select(F.col("chunk_id").alias("id"), *[c for c in filters])
            left = sparse.after_filter(labels.join(F.broadcast(best), "id"), loose_filter(filters), k)
            words = left.select("id", "score", F.row_number().over(Window.orderBy("place")).alias("place"))
        found = hybrid.search(mode, near, words, k)
        hits = rows.drop("embeddings").join(F.broadcast(found), rows["chunk_id"] == found["id"]).drop("id")
        if use_reranker:
            top = hybrid.reranked(hits.drop("score", "place"), F.lit(question), "page_content", r, rerank, "chunk_id").withColumnRenamed("rerank_score", "score")
            top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
        else:
            top = hits.orderBy("place").limit(r)
        return hybrid.cut_below(top, "score", threshold_or_zero(threshold)).orderBy("place")
