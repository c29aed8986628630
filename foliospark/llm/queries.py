"""Queries of the corpus operators, by problem number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import languages, leakage, lookalikes, near_duplicates, packing, scans, sentences, splitting, subjects, twins, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vectors.similar_vector_pairs(_table(spark, sf_dir, "chunks"), "chunk_id", "embeddings", 5, 0.85)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk whose id is divisible by 100, at any cosine."""
    rows = _table(spark, sf_dir, "chunks").select("chunk_id", "embeddings")
    near = vectors.nearest_of_queries(rows, rows.where("chunk_id % 100 = 0"), "chunk_id", "embeddings", 5)
    return near.select("query_id", "neighbour", F.round("cosine", 6).alias("cosine"), "place")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_units(_table(spark, sf_dir, "chunks"))


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, content) of the clean text chunks."""
    return sentences.clean_text(_table(spark, sf_dir, "chunks")).select("chunk_id", lookalikes.content_column().alias("content"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_segments(spark, sf_dir).drop("confidence")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments with their confidence."""
    return languages.language_segments(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "languages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.piece_rows(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "settings"), 1)
    return pieces.select("chunk_id", "piece_start", "piece_end")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with the pages of their chunk, overlapping as their collection is set."""
    return splitting.piece_rows(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "settings"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.similar_pairs(_contents(spark, sf_dir), "chunk_id", "content", 0.6, 120)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its class of copies and its number of links to other classes, at similarity 0.8."""
    return near_duplicates.similar_groups(_contents(spark, sf_dir), "chunk_id", "content", 0.8, 120)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_repairs(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "toc"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned chunks as continuous paragraphs."""
    return scans.scan_texts(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "toc"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalikes.lookalike_pairs(_contents(spark, sf_dir), "chunk_id", "content")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_containers(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "containers"))


def p8_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the room that each container type leaves unused."""
    per = p8_containers(spark, sf_dir).groupBy("container_type", "container_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("used"))
    total = per.groupBy("container_type").agg(F.count("*").alias("n_containers"), F.sum("used").alias("used_tokens"), F.max("used").alias("fullest"))
    both = total.join(_table(spark, sf_dir, "containers"), "container_type")
    return both.select("container_type", "n_containers", "used_tokens", "fullest", (1 - F.col("used_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question with other numbers and names in its slots: the first item of every template."""
    return leakage.reparameterised(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a question with other numbers and names in its slots: every item."""
    return leakage.reparameterised_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "subject_areas"), _table(spark, sf_dir, "doc_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_nearest": p1_nearest, "p2_found": p2_found, "p3_found": p3_found, "p3_segments": p3_segments, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_texts": p6_texts, "p7_found": p7_found, "p8_containers": p8_containers, "p8_room": p8_room, "p9_found": p9_found, "p9_templates": p9_templates, "p9_links": p9_links, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    """Twins on whole tables; the other queries are tested on fixtures against brute force or held-out cases."""
    units = str(sorted(leakage.UNITS))
    return {"p1_found": twins.P1_FOUND, "p1_nearest": twins.P1_NEAREST, "p5_found": twins.P5_FOUND, "p9_found": twins.P9_FOUND, "p9_templates": twins.P9_TEMPLATES.replace("UNITS", units), "p9_links": twins.P9_LINKS.replace("UNITS", units)}
