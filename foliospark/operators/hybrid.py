"""Fusion of ranked lists, reranking, thresholds and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.models import rerank_udf

MODES = ("dense", "sparse", "hybrid")


def fused(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, place): columns id, rrf_score, place.

    A list that holds an id twice adds twice.  Ties go to the id first met, dense list first.
    """
    both = dense.select("id", "place", F.lit(0).alias("list")).unionByName(sparse.select("id", "place", F.lit(1).alias("list")))
    score = both.groupBy("id").agg(F.sum(1.0 / (constant + F.col("place"))).alias("rrf_score"), F.min(F.struct("list", "place")).alias("first"))
    best = score.orderBy(F.desc("rrf_score"), "first").limit(k)
    return best.select("id", "rrf_score", F.row_number().over(Window.orderBy(F.desc("rrf_score"), "first")).alias("place"))


def search(mode: str, dense: DataFrame | None, sparse: DataFrame | None, k: int) -> DataFrame:
    """(id, place, score) of one of the modes; another mode is an error."""
    if mode not in MODES:
        raise ValueError(f"search mode must be one of {', '.join(MODES)}")
    if mode == "dense":
        return dense.where(F.col("place") <= k).select("id", "place", "score")
    if mode == "sparse":
        return sparse.where(F.col("place") <= k).select("id", "place", "score")
    return fused(dense, sparse, k).select("id", "place", F.col("rrf_score").alias("score"))


def hit_score(rrf: Column, score: Column, distance: Column) -> Column:
    """The first of the three that is neither null nor 0, else 0."""
    return F.coalesce(F.nullif(rrf, F.lit(0.0)), F.nullif(score, F.lit(0.0)), F.nullif(distance, F.lit(0.0)), F.lit(0.0))


def hit_columns(rows: DataFrame) -> DataFrame:
    """The fields of a found document, missing ones empty."""
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("page_content", "filename", "type", "source", "page_numbers")], *[c for c in rows.columns if c in ("chunk_id", "score", "distance")])


def reranked(hits: DataFrame, query: Column, text_col: str, r: int, model=None, id_col: str = "id") -> DataFrame:
    """The *r* best hits by the reranker, ties to the smaller id; r = 0 returns all of them."""
    scored = hits.withColumn("rerank_score", (rerank_udf(model) if model else rerank_udf())(query, F.col(text_col)))
    ordered = scored.orderBy(F.desc("rerank_score"), id_col)
    return ordered.limit(r) if r else ordered


def cut_below(hits: DataFrame, score_col: str, threshold: float) -> DataFrame:
    """Hits of at least the threshold; applied to a list that is already cut to its length."""
    return hits.where(F.col(score_col) >= threshold)


def context(texts: Column, question_tokens: Column, budget: int = 6000, template: int = 250) -> Column:
    """Texts joined by blank lines and cut to the tokens the prompt leaves; a negative rest counts from the end, as a
    slice does."""
    tokens = F.split(F.array_join(texts, "\n\n"), " ")
    rest = F.lit(budget) - (F.lit(template) + question_tokens)
    size = F.size(tokens)
    n = F.when(rest >= 0, F.least(rest, size)).otherwise(F.greatest(size + rest, F.lit(0)))
    return F.array_join(F.slice(tokens, 1, n), " ")
