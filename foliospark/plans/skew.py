"""Splitting hot groups whose members must all meet each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = 65536
FEW = 512  # heavy cells that a filter names; more are joined


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Number of partitions in which a task holds about *per_task* rows, at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def split_hot(rows: DataFrame, key: str, id_col: str, hot: int, n: int = 0) -> DataFrame:
    """Adds ``asks`` and rewrites *key* (a long) for groups of more than *hot* rows.

    Such a group is cut into parts, and its rows go to one task for each pair of parts, so that no task holds
    more than two parts and yet any two rows meet exactly once.  In the task of two different parts the rows
    of one have ``asks`` set; elsewhere it is false and all rows meet all.
    Counting is a partial aggregate over hash cells, at least *CELLS* and eight times as many as *n* rows would
    fill, so that a cell is heavy only by hot keys; exact counts are taken in heavy cells only.
    """
    cells = max(CELLS, 8 * n // hot)
    cell = F.pmod(F.col(key), F.lit(cells))
    heavy_cells = [r[0] for r in rows.groupBy(cell.alias("c")).count().where(F.col("count") > hot).select("c").collect()]
    if not heavy_cells:
        return rows.withColumn("asks", F.lit(False))
    if len(heavy_cells) <= FEW:
        inside = rows.where(cell.isin(heavy_cells))
    else:
        inside = rows.withColumn("_c", cell).join(rows.sparkSession.createDataFrame([(c,) for c in heavy_cells], "_c long"), "_c", "left_semi")
    heavy = inside.groupBy(key).count().where(F.col("count") > hot)
    heavy = heavy.select(key, F.ceil(F.col("count") / hot).cast("int").alias("_parts"))
    split = rows.join(heavy, key, "left").withColumn("_home", F.pmod(F.xxhash64(id_col), F.coalesce("_parts", F.lit(1))))
    split = split.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    lo, hi = F.least("_home", "_part"), F.greatest("_home", "_part")
    new_key = F.when(F.col("_parts").isNull(), F.col(key)).otherwise(F.xxhash64(F.col(key), lo, hi))
    return split.select(*[new_key.alias(c) if c == key else F.col(c) for c in rows.columns], (F.col("_part") < F.col("_home")).alias("asks"))
