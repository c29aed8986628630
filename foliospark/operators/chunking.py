"""Chunks of text: token-bounded folding, parts, fixed windows, breadcrumbs and the union of document kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens


def fold_sentences(sentences: Column, limit: int, overlap: bool = True) -> Column:
    """array<string>: sentences folded greedily to at most *limit* tokens.

    A sentence that would exceed the limit closes the chunk; with *overlap* the next one opens with the last
    sentence of it.  Two consequences of the rule are kept: an oversized first sentence emits an empty chunk, and
    a chunk can exceed the limit through its overlap.  One aggregate expression, evaluated in the JVM.
    """
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), count_tokens(s).alias("t")))
    state = "struct<done:array<string>,cur:array<string>,n:int,last:int>"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"), F.lit(0).alias("last")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        over = acc["n"] + x["t"] > limit
        carry = F.lit(bool(overlap)) & (F.size(acc["cur"]) > 0)
        done = F.when(over, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])
        kept = F.when(~over, acc["cur"]).when(carry, F.slice(acc["cur"], -1, 1)).otherwise(F.array().cast("array<string>"))
        n = F.when(~over, acc["n"]).when(carry, acc["last"]).otherwise(F.lit(0))
        return F.struct(done.alias("done"), F.concat(kept, F.array(x["s"])).alias("cur"), (n + x["t"]).alias("n"), x["t"].alias("last"))

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])

    return F.aggregate(counted, zero, step, finish)


def parts(rows: DataFrame, chunks: str, out: str = "content") -> DataFrame:
    """One row per chunk; part_id from 1, null where there is a single part."""
    wide = rows.select(*[c for c in rows.columns if c != chunks], F.posexplode(chunks).alias("_pos", out), F.size(chunks).alias("_parts"))
    return wide.withColumn("part_id", F.when(F.col("_parts") > 1, F.col("_pos") + 1)).drop("_pos", "_parts")


def fixed_windows(tokens: Column, size: int = 1024, overlap: int = 40) -> Column:
    """array<array>: windows of *size* tokens, each opening with the last *overlap* of the one before."""
    stride = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - overlap - 1, F.lit(0)), F.lit(stride))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda s: F.slice(tokens, s + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def breadcrumb(chapter: Column, section: Column, subsection: Column, subsubsection: Column) -> Column:
    """'Chapter: x Section: y ' of the titles that are not empty."""
    named = zip(("Chapter", "Section", "Subsection", "Subsubsection"), (chapter, section, subsection, subsubsection))
    return F.concat_ws("", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c, F.lit(" "))) for n, c in named])


def with_breadcrumb(crumb: Column, content: Column) -> Column:
    return F.when(crumb != "", F.concat(crumb, F.lit("\n"), content)).otherwise(content)


def wrapped_by_label(label: Column, text: Column) -> Column:
    """Code in fences, formulas in dollars, other text as it is; each followed by a blank."""
    return F.concat(F.when(label == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(label == "formula", F.concat(F.lit("$"), text, F.lit("$"))).otherwise(text), F.lit(" "))


def combined_documents(texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """Text, table and image documents in this order, with their ordinal."""
    branches = [d.withColumn("branch", F.lit(i)) for i, d in enumerate((texts, tables, images))]
    return branches[0].unionByName(branches[1]).unionByName(branches[2])


def page_ranges(pages: Column, unit: int = 15) -> Column:
    """array<struct<first,last>>: ranges of at most *unit* pages."""
    return F.when(pages > 0, F.transform(F.sequence(F.lit(1), pages, F.lit(unit)), lambda p: F.struct(p.alias("first"), F.least(p + unit - 1, pages).alias("last"))))


def distinct_pages(text: Column) -> Column:
    """Sorted distinct pages of a JSON list."""
    return F.array_sort(F.array_distinct(F.filter(F.from_json(text, "array<int>"), lambda x: x.isNotNull())))
