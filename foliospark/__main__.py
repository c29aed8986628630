"""Command line: python -m foliospark ingest --path FOLDER --store TABLE; python -m foliospark clean-db --store TABLE."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.ids import chunk_key
from .operators import metrics
from .plans.search import Store
from .service import Timings
from .sources import files, sinks


def ingest(spark: SparkSession, folder: str, store: Store) -> list[str]:
    """Reads the chunk files below a folder into the store; lines of the statistics."""
    t = Timings()
    with t.stage("read"):
        rows = files.chunk_files(spark, folder).where("page_content is not null and trim(page_content) <> ''")
        rows = rows.withColumn("chunk_id", F.coalesce(F.col("chunk_id").cast("long"), chunk_key(F.col("page_content")))).drop("path")
    with t.stage("index"):
        table = store.ingest(rows)
    with t.stage("report"):
        report = metrics.stats_report(metrics.ingest_stats(table)).orderBy("is_total", "filename")
        lines = [r["line"] for r in report.toLocalIterator()]
    return lines + [f"{name}: {s:.1f} s" for name, s in t.seconds.items()]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="foliospark")
    parser.add_argument("command", choices=["ingest", "clean-db"])
    parser.add_argument("--path", help="folder with chunk files")
    parser.add_argument("--store", required=True, help="folder of the table and its indexes")
    parser.add_argument("--debug", action="store_true")
    got = parser.parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if got.debug else logging.INFO)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    try:
        if got.command == "clean-db":
            sinks.reset(spark, got.store)
        elif not got.path:
            parser.error("ingest needs --path")
        else:
            print("\n".join(ingest(spark, got.path, Store(got.store))))
    except Exception:
        logging.exception("%s failed", got.command)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
