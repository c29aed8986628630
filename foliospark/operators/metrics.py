"""Ingest statistics, ratings, usage and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ingest_stats(chunks: DataFrame) -> DataFrame:
    """Counts per file, by type, with a total row (is_total 1)."""
    g = chunks.rollup("filename").agg(
        F.count("*").alias("n_chunks"),
        F.count_if(F.col("type") == "text").alias("n_text"),
        F.count_if(F.col("type") == "table").alias("n_tables"),
        F.count_if(F.col("type") == "image").alias("n_images"),
        F.grouping("filename").cast("int").alias("is_total"),
    )
    return g.select(F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.coalesce("filename", F.lit(""))).alias("filename"), "n_chunks", "n_text", "n_tables", "n_images", "is_total")


def stats_report(stats: DataFrame, width: int = 40) -> DataFrame:
    """Fixed-width lines of the statistics, the total last."""
    line = F.concat(F.rpad("filename", width, " "), *[F.lpad(F.col(c).cast("string"), 10, " ") for c in ("n_chunks", "n_text", "n_tables", "n_images")])
    return stats.select("filename", "is_total", line.alias("line"))


def samples(metrics: DataFrame) -> DataFrame:
    """Metric samples once each: redelivered rows (same metric_id) are dropped by keeping the latest scrape."""
    latest = Window.partitionBy("metric_id").orderBy(F.desc("scraped_at"))
    return metrics.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def ratings_by_star(metrics: DataFrame) -> DataFrame:
    """(stars, n): sum of the rating counter by star; NaN and missing values count nothing."""
    good = metrics.where((F.col("name") == "feedback_stars_total") & F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("stars").agg(F.round(F.sum("value"), 6).alias("n"))


def star_dimension(metrics: DataFrame) -> DataFrame:
    """(star, n) for stars 1 to 5, 0 where there is no rating."""
    by = ratings_by_star(metrics).where(F.col("stars").rlike(r"^\s*[1-5](\.0)?\s*$")).select(F.trim("stars").cast("double").cast("int").alias("star"), "n")
    by = by.groupBy("star").agg(F.sum("n").alias("n"))
    stars = metrics.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))
    return stars.join(F.broadcast(by), "star", "left").select("star", F.round(F.coalesce("n", F.lit(0.0)), 6).alias("n"))


def weighted_rating(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean rating weighted by counts; null without ratings."""
    valid = metrics.where((F.col("name") == "feedback_stars_total") & F.col("value").isNotNull() & ~F.isnan("value") & F.col("stars").rlike(r"^\s*[1-5](\.0)?\s*$"))
    star = F.trim("stars").cast("double")
    return valid.groupBy(*(by or [])).agg(F.round(F.sum(star * F.col("value")) / F.nullif(F.sum("value"), F.lit(0.0)), 6).alias("rating"))


def last_usage(metrics: DataFrame) -> DataFrame:
    """(model_id, value): the last value of the usage counter that is neither null nor NaN."""
    good = metrics.where((F.col("name") == "model_usage_total") & F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("model_id").agg(F.max_by("value", F.struct("ts", "metric_id")).alias("last_value"))


def latency_windows(metrics: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests and mean duration by event-time window and model; serves batch and stream alike."""
    good = metrics.where((F.col("name") == "request_duration_seconds") & F.col("value").isNotNull() & ~F.isnan("value") & F.col("ts").isNotNull())
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    agg = good.groupBy(w.alias("w"), "model_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_seconds"), F.round(F.max("value"), 6).alias("max_seconds"))
    return agg.select(F.col("w.start").alias("window_start"), "model_id", "n", "mean_seconds", "max_seconds")
