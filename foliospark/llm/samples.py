"""Bounded, repeatable samples for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, id_col: str, group, columns: list[str], per_group: int = 512) -> list[Row]:
    """At most *per_group* rows of each group, to the driver.

    Each id falls into one of *per_group* hash slots; the row with the least hash of each (group, slot) is
    taken.  The first pass is a partial aggregate of two integers a slot; the second reads the chosen rows.
    The size is bounded by per_group times the number of groups, whatever the table.
    """
    g = group if not isinstance(group, str) else F.col(group)
    keyed = df.select(F.col(id_col).alias("_id"), g.alias("_g"), *[F.col(c).alias("_c_" + c) for c in columns]).where(F.col("_g").isNotNull())
    h = F.xxhash64(F.col("_id"))
    keyed = keyed.withColumn("_h", h).withColumn("_slot", F.pmod(F.col("_h"), F.lit(per_group)))
    least = [r[0] for r in keyed.groupBy("_g", "_slot").agg(F.min("_h").alias("m")).select("m").collect()]
    if not least:
        return []
    spark = df.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(x,) for x in sorted(set(least))], "_h long"))
    seen, out = set(), []
    rows = keyed.join(chosen, "_h", "left_semi").dropDuplicates(["_id", "_g"])  # an id may be repeated any number of times
    for r in sorted(rows.select("_id", "_g", *["_c_" + c for c in columns]).collect(), key=lambda r: (str(r[1]), r[0])):
        if r[0] not in seen:
            seen.add(r[0])
            out.append(Row(group=r[1], **{c: r["_c_" + c] for c in columns}))
    return out
