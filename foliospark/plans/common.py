"""Parts that queries and their SQL twins share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import last_wins
from ..operators.sparse import SparseIndex, save_index, tokenized
from .lineage import scratch

#: The index: of every chunk its last delivery.
INDEX_SQL = "idx AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY load_seq DESC) = 1)"
TOKENS_SQL = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')"
QUESTION_SQL = "SELECT min_by(question, item_id) AS question FROM eval_items WHERE lang = 'en'"
K = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The index with the named columns only, so that the others are not read."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "load_seq", *[c for c in columns if c not in ("chunk_id", "load_seq")])
    return last_wins(rows, "chunk_id", "load_seq")


def question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of all searches: the English evaluation item with the least id."""
    return table(spark, sf_dir, "eval_items").where("lang = 'en'").agg(F.min_by("question", "item_id").alias("question"))


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))


_STORED: dict[tuple, str] = {}


def sparse_index(spark: SparkSession, sf_dir: str) -> SparseIndex:
    """The stored sparse index of the chunks: fitted once a session, and again when the file has changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/chunks.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, status.getLen(), status.getModificationTime())
    if key not in _STORED:
        target = scratch(spark, "sparse")
        save_index(tokenized(index(spark, sf_dir, "page_content"), "chunk_id", "page_content"), target)
        _STORED[key] = target
    return SparseIndex.load(spark, _STORED[key])
