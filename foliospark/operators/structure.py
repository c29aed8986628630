"""Structure of converted documents: captions, lines, heading levels and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_match_udf, heading_level, heading_text, partial_ratio_udf


def routed_captions(captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table captions, picture captions) by what the parent reference names."""
    return captions.where(F.col("parent_ref").contains("tables")), captions.where(~F.col("parent_ref").contains("tables") & F.col("parent_ref").contains("pictures"))


def table_captions(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """Tables (doc_id, table_idx, ...) with the first caption (doc_id, caption_idx, parent_ref, text) that refers to them."""
    first = Window.partitionBy("doc_id", "parent_ref").orderBy("caption_idx")
    one = captions.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("doc_id", F.col("parent_ref").alias("_ref"), F.col("text").alias("caption"))
    keyed = tables.withColumn("_ref", F.concat(F.lit("#/tables/"), F.col("table_idx").cast("string")))
    return keyed.join(one, ["doc_id", "_ref"], "left").drop("_ref")


def image_captions(images: DataFrame, texts: DataFrame) -> DataFrame:
    """Images (doc_id, image_idx, children array) with all texts (doc_id, self_ref, text) their children refer to, in
    order, each followed by a blank; '' if there is none."""
    child = images.select("doc_id", "image_idx", F.posexplode("children").alias("_pos", "self_ref"))
    hit = child.join(texts, ["doc_id", "self_ref"]).groupBy("doc_id", "image_idx").agg(F.array_sort(F.collect_list(F.struct("_pos", "text"))).alias("_t"))
    joined = hit.select("doc_id", "image_idx", F.concat(F.array_join(F.transform("_t", lambda x: x["text"]), " "), F.lit(" ")).alias("caption"))
    return images.drop("children").join(joined, ["doc_id", "image_idx"], "left").withColumn("caption", F.coalesce("caption", F.lit("")))


def lines_of_words(words: DataFrame) -> DataFrame:
    """Words (doc_id, page, text, top, bottom, x0, x1, size, fontname) to lines: text in order of x0, bounding box, and
    the most frequent size and font (ties: the one that comes first on the line)."""
    whole = words.dropna(subset=["text", "top", "bottom", "x0", "x1", "size", "fontname"]).withColumn("line_top", F.round("top", 1))
    keys = ["doc_id", "page", "line_top"]
    box = whole.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("x0", "text", "size", "fontname"))).alias("_w"),
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"),
    )

    def most_frequent(field: str):
        values = F.transform("_w", lambda w: w[field])
        counted = F.transform(F.array_distinct(values), lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-F.array_position(values, v)).alias("p"), v.alias("v")))
        return F.array_max(counted)["v"]

    return box.select(*keys, F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"), most_frequent("size").alias("font_size"), most_frequent("fontname").alias("fontname"), "x0", "x1", "top", "bottom")


def toc_matches(headers: DataFrame, toc: DataFrame, least: float = 80.0) -> DataFrame:
    """Headers (doc_id, block_idx, text) with the level and place of the first title of their document's table of
    contents whose fuzzy ratio, without regard to case, reaches *least*; null without one.

    The titles of a document travel as one ordered array beside its headers, and a vectorized function stops at the
    first match, so no pairs are made.
    """
    entry = F.struct(F.col("pos"), F.col("title"), F.col("level").alias("lvl"))
    listed = toc.where("title is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("_toc"))
    with_toc = headers.join(listed, "doc_id", "left")
    at = first_match_udf(least)(F.lower("text"), F.transform("_toc", lambda e: F.lower(e["title"])))
    hit = with_toc.withColumn("_at", at)
    got = F.when(F.col("_at") > 0, F.element_at("_toc", F.col("_at")))
    return hit.withColumn("level", got["lvl"]).withColumn("toc_pos", got["pos"]).drop("_toc", "_at")


def header_font_sizes(headers: DataFrame, lines: DataFrame, least: float = 80.0) -> DataFrame:
    """Headers (doc_id, block_idx, page, text) with the mean font size of the lines of their page that match wholly
    (ratio 100, without regard to case), rounded to 2 digits; headers without any match of *least* drop out."""
    hit = headers.join(lines.select("doc_id", "page", F.col("text").alias("_line"), "font_size"), ["doc_id", "page"])
    hit = hit.withColumn("_r", partial_ratio_udf(F.lower("text"), F.lower("_line"))).where(F.col("_r") >= least)
    return hit.groupBy("doc_id", "block_idx", "page", "text").agg(F.round(F.avg(F.when(F.col("_r") >= 100, F.col("font_size"))), 2).alias("font_size"))


def font_levels(headers: DataFrame) -> DataFrame:
    """Adds level: leading hash marks if there are any, else the rank of the font size in its document, largest first
    (ties: the same level); an unknown size gets the number of sizes."""
    by_size = Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("font_size"))
    sizes = headers.groupBy("doc_id").agg(F.countDistinct("font_size").alias("_sizes"))
    ranked = headers.join(sizes, "doc_id").withColumn("_rank", F.dense_rank().over(by_size))
    marks = heading_level(F.col("text"))
    level = F.when(marks > 0, marks).when(F.col("font_size").isNull(), F.col("_sizes").cast("int")).otherwise(F.col("_rank"))
    return ranked.withColumn("level", level).withColumn("text", heading_text(F.col("text"))).drop("_rank", "_sizes")


def carried_levels(toc: DataFrame) -> DataFrame:
    """Adds full_level: an entry without a level gets the last known level of its document plus 1 (1 before any)."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return toc.withColumn("full_level", F.coalesce("level", F.last("level", ignorenulls=True).over(before) + 1, F.lit(1)))


def carried_titles(rows: DataFrame, level: str, title: str, order: str = "pos") -> DataFrame:
    """Adds title_1 to title_4: the titles a row stands under.

    A header of level n sets title n and clears the deeper ones; levels beyond 3, and 0, set title 4.  Rows without
    a level carry on.  Each level is the last set-or-cleared value, so one running frame serves all four.
    """
    deep = F.when(F.col(level).between(1, 3), F.col(level)).when(F.col(level).isNotNull(), F.lit(4))
    frame = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_deep", deep)
    for n in range(1, 5):
        change = F.when(F.col("_deep") <= n, F.struct(F.when(F.col("_deep") == n, F.col(title)).otherwise(F.lit("")).alias("t")))
        out = out.withColumn(f"title_{n}", F.coalesce(F.last(change, ignorenulls=True).over(frame)["t"], F.lit("")))
    return out.drop("_deep")


def sections(blocks: DataFrame) -> DataFrame:
    """Adds section_id: every section header of a document opens a section; blocks before the first are in section 0."""
    frame = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("section_id", F.sum((F.col("label") == "section_header").cast("int")).over(frame))


def section_contents(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, section_id, block_idx, label, text, page) to one row per section with content: the text in block
    order, the sorted distinct pages, and the ids of the blocks."""
    from .chunking import wrapped_by_label
    from .selection import CHUNKED_LABELS

    body = blocks.where(F.col("label").isin(*CHUNKED_LABELS))
    packed = body.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", wrapped_by_label(F.col("label"), F.col("text")).alias("t")))).alias("_b"), F.array_sort(F.collect_set("page")).alias("page_range"))
    out = packed.select("doc_id", "section_id", F.array_join(F.transform("_b", lambda x: x["t"]), "").alias("content"), "page_range", F.transform("_b", lambda x: F.concat(F.lit("#/texts/"), x["block_idx"].cast("string"))).alias("source_nodes"))
    return out.where(F.trim("content") != "")
