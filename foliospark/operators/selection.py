"""Filters, keyed upserts, anti joins and other row selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized

#: Labels of blocks that are no body text, and labels that are cut into chunks.
DROPPED_LABELS = ("page_header", "page_footer", "caption", "reference", "footnote")
CHUNKED_LABELS = ("text", "list_item", "code", "formula")


def exact_filter(filters: dict[str, str | None]) -> Column:
    """Conjunction of equalities; null or empty values mean no filter.  Values are literals, never text of a query."""
    conds = [F.col(k) == F.lit(v) for k, v in filters.items() if v]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def loose_filter(filters: dict[str, str | None], empty_is_filter: bool = False) -> Column:
    """As exact_filter, without regard to case and surrounding space.  With *empty_is_filter* only None means none."""
    conds = [normalized(F.coalesce(F.col(k), F.lit(""))) == F.lit(v.strip().lower()) for k, v in filters.items() if v or (empty_is_filter and v is not None)]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def threshold_or_zero(value) -> float:
    """A score threshold: a number strictly between 0 and 1, else 0."""
    ok = isinstance(value, float) and 0.0 < value < 1.0
    return value if ok else 0.0


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert: of rows with one key the one with the greatest order stays (ties: any of equal rows)."""
    latest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old rows with their key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def unprocessed(originals: DataFrame, processed: DataFrame, key: str) -> DataFrame:
    """Originals whose key was not processed."""
    return originals.join(processed.select(key).distinct(), key, "left_anti")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Work list: files without a manifest entry of the same checksum that has all three outputs."""
    done = manifest.where(F.coalesce("has_text", F.lit(False)) & F.coalesce("has_tables", F.lit(False)) & F.coalesce("has_images", F.lit(False)))
    return files.join(done.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")


def kept(rows: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose flag is true; rows without a flag drop out (the zip stops at the shorter list)."""
    return rows.join(flags.where("keep").select(*keys), keys, "left_semi")


def joined_outputs(texts: DataFrame, tables: DataFrame, images: DataFrame, key: str = "doc_id") -> DataFrame:
    """The three outputs of every document side by side, joined by document (not by position, which shifts where one
    is missing); documents without all three drop out."""
    return texts.join(tables, key).join(images, key)


def non_empty(params: dict) -> dict:
    return {k: v for k, v in params.items() if v not in (None, "", [], {})}
