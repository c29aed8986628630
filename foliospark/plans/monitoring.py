"""Rating, usage and latency queries, in batch and as streams, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.sinks import read_table
from ..streaming import flows
from .common import table
from .lineage import scratch

_M = "m AS (SELECT * FROM usage_metrics QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY scraped_at DESC) = 1)"
_GOOD = "value IS NOT NULL AND NOT isnan(value)"
_STARS = r"regexp_matches(stars, '^\s*[1-5](\.0)?\s*$')"
_LATENCY = f"name = 'request_duration_seconds' AND {_GOOD} AND ts IS NOT NULL"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.samples(table(spark, sf_dir, "usage_metrics"))


def ratings_by_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratings_by_star(_samples(spark, sf_dir))


def star_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.star_dimension(_samples(spark, sf_dir))


def weighted_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_rating(_samples(spark, sf_dir))


def weighted_rating_by_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_rating(_samples(spark, sf_dir), ["namespace"])


def usage_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_usage(_samples(spark, sf_dir)).select("model_id", F.round("last_value", 6).alias("last_value"))


def latency_window_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_windows(_samples(spark, sf_dir))


def latency_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_windows(_samples(spark, sf_dir), "5 minutes", "1 minute")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def stream_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows as a stream over the files; the watermark is wide enough for all late rows, so that the result is
    that of the batch."""
    live = flows.live_latency(_stream(spark, sf_dir, "usage_metrics"), "3650 days", "5 minutes", "5 minutes")
    path = scratch(spark, "stream")
    return flows.run_to_table(live, f"{path}/windows", f"{path}/state")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks taken up as a stream and upserted into a table, counted by file."""
    path = scratch(spark, "stream")
    schema = table(spark, sf_dir, "chunks").schema
    q = flows.ingest_stream(spark, f"{sf_dir}/chunks.parquet*", schema, f"{path}/index", f"{path}/state", "chunk_id", "load_seq")
    q.awaitTermination()
    return read_table(spark, f"{path}/index").groupBy("filename").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("n_ids"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation items in turn for two providers, the first twice as often, and once more for both."""
    items = table(spark, sf_dir, "eval_items").select("item_id")
    turns = flows.provider_of(items, ["small", "large"], "round_robin", "item_id", [2, 1]).withColumn("strategy", F.lit("round_robin"))
    return turns.unionByName(flows.provider_of(items, ["small", "large"], "all", "item_id").withColumn("strategy", F.lit("all")))


def _window_sql(slide: int, name: str = "m") -> str:
    return f"""SELECT window_start, model_id, count(*) AS n, round(avg(value), 6) AS mean_seconds, round(max(value), 6) AS max_seconds FROM (
    SELECT model_id, value, make_timestamp(((epoch_us(ts) // {slide * 60_000_000}) - k) * {slide * 60_000_000}) AS window_start FROM {name}, range({5 // slide}) r(k) WHERE {_LATENCY}) GROUP BY ALL"""


QUERIES = {
    "ratings_by_star": (ratings_by_star, f"WITH {_M} SELECT stars, round(sum(value), 6) AS n FROM m WHERE name = 'feedback_stars_total' AND {_GOOD} GROUP BY stars"),
    "star_dimension": (
        star_dimension,
        f"WITH {_M}, b AS (SELECT trim(stars, ' ')::DOUBLE::INT AS star, sum(value) AS n FROM m WHERE name = 'feedback_stars_total' AND {_GOOD} AND {_STARS} GROUP BY 1) SELECT s::INT AS star, round(coalesce(n, 0), 6) AS n FROM range(1, 6) r(s) LEFT JOIN b ON s = star",
    ),
    "weighted_rating": (weighted_rating, f"WITH {_M} SELECT round(sum(trim(stars, ' ')::DOUBLE * value) / nullif(sum(value), 0), 6) AS rating FROM m WHERE name = 'feedback_stars_total' AND {_GOOD} AND {_STARS}"),
    "weighted_rating_by_namespace": (
        weighted_rating_by_namespace,
        f"WITH {_M} SELECT namespace, round(sum(trim(stars, ' ')::DOUBLE * value) / nullif(sum(value), 0), 6) AS rating FROM m WHERE name = 'feedback_stars_total' AND {_GOOD} AND {_STARS} GROUP BY namespace",
    ),
    "usage_last_value": (usage_last_value, f"WITH {_M} SELECT model_id, round(arg_max(value, (ts, metric_id)), 6) AS last_value FROM m WHERE name = 'model_usage_total' AND {_GOOD} GROUP BY model_id"),
    "latency_window_5m": (latency_window_5m, f"WITH {_M} {_window_sql(5)}"),
    "latency_sliding": (latency_sliding, f"WITH {_M} {_window_sql(1)}"),
    "stream_latency": (stream_latency, f"WITH m AS (SELECT DISTINCT ON (metric_id, ts) * FROM usage_metrics) {_window_sql(5)}"),
    "stream_upsert": (stream_upsert, "SELECT filename, count(DISTINCT chunk_id) AS n, count(DISTINCT chunk_id) AS n_ids FROM (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY load_seq DESC) = 1) GROUP BY filename"),
    "round_robin": (round_robin, "SELECT item_id, CASE item_id % 3 WHEN 2 THEN 'large' ELSE 'small' END AS provider, 'round_robin' AS strategy FROM eval_items UNION ALL SELECT item_id, provider, 'all' FROM eval_items, (VALUES ('small'), ('large')) p(provider)"),
}
