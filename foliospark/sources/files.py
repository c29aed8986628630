"""Readers: chunk files, converted documents, PDFs, archives, web pages, word lists and settings."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "INTS": T.ArrayType(T.IntegerType())}


def _schema(text: str) -> T.StructType:
    """A flat schema from "name TYPE, ..."; unlike DDL parsing it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


CHUNK_FILE = _schema("chunk_id STRING, page_content STRING, filename STRING, type STRING, source STRING, language STRING, subject STRING, class_level STRING, page_numbers INTS")
BLOCKS = _schema("doc_id STRING, block_idx INT, label STRING, text STRING, page INT, font_size DOUBLE")
WORDS = _schema("doc_id STRING, page INT, text STRING, top DOUBLE, bottom DOUBLE, x0 DOUBLE, x1 DOUBLE, size DOUBLE, fontname STRING")
TOC = _schema("doc_id STRING, pos INT, title STRING, level INT")
#: A converted document, for spark.read.schema.
CONVERTED = (
    "texts ARRAY<STRUCT<self_ref: STRING, label: STRING, text: STRING, parent: STRUCT<`$ref`: STRING>, prov: ARRAY<STRUCT<page_no: INT>>>>, "
    "tables ARRAY<STRUCT<self_ref: STRING, html: STRING>>, pictures ARRAY<STRUCT<self_ref: STRING, children: ARRAY<STRUCT<`$ref`: STRING>>, image: STRUCT<uri: STRING>>>"
)


def chunk_files(spark: SparkSession, path: str, name: str = "chunks.json") -> DataFrame:
    """All chunk files below a folder; missing fields are empty, the chunk id is not."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).schema(CHUNK_FILE).json(path)
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("filename", "type", "source", "language", "subject", "class_level")]
    return raw.select("chunk_id", "page_content", *text, F.coalesce(F.to_json("page_numbers"), F.lit("[]")).alias("page_numbers"), F.col("_metadata.file_path").alias("path"))


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Elements of JSON arrays with their position, which files read in parallel would lose."""
    s = schema if isinstance(schema, str) else schema.simpleString()
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<{s}>").alias("a"))
    return whole.select("path", F.posexplode("a").alias("pos", "item")).select("path", "pos", "item.*")


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Files of a pattern below a folder, with content and checksum."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "modificationTime", "length", "content").withColumn("sha256", F.sha2("content", 256))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    return binary_files(spark, path, "*.pdf")


def parsed(files: DataFrame, parser: Callable[[bytes], list[dict]], schema: T.StructType) -> DataFrame:
    """One row per record a parser finds in a file (words, outline or converted pages); a file that cannot be parsed
    gives none.  The parser is a plug-in: a library on the executors, or a remote converter."""
    columns = [f.name for f in schema.fields if f.name != "doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = parser(bytes(content))
                except Exception:  # noqa: BLE001 - a broken file is no reason to lose the others
                    continue
                rows += [{"doc_id": os.path.basename(path), **{c: r.get(c) for c in columns}} for r in found]
            yield pd.DataFrame(rows, columns=["doc_id", *columns])

    return files.select("path", "content").mapInPandas(run, schema)


def converted_in_ranges(ranges: list[tuple[int, int]], submit: Callable[[int, int], str], poll: Callable[[str], dict | None], wait: float = 300.0, delay: float = 2.0, tries: int = 3, parallel: int = 8) -> list[dict]:
    """Converted page ranges of one document, in page order, for use as a parser with ``parsed``.

    Every range is submitted (tried again with doubled pauses on failure) and its task polled until there is a result;
    after *wait* seconds it is a TimeoutError.  At most *parallel* ranges are under way at once.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    def one(span: tuple[int, int]) -> dict:
        for n in range(1, tries + 1):
            try:
                task = submit(*span)
                break
            except Exception:
                if n == tries:
                    raise
                time.sleep(delay * 2 ** (n - 1))
        begin = time.monotonic()
        while (got := poll(task)) is None:
            if time.monotonic() - begin > wait:
                raise TimeoutError(f"conversion task {task} took more than {wait} s")
            time.sleep(delay)
        return got

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        return list(pool.map(one, sorted(ranges)))  # map keeps the order of the pages


def converted_texts(converted: DataFrame) -> DataFrame:
    """Blocks of converted documents (doc_id, texts): label, text, first page and parent reference, in list order."""
    b = converted.select("doc_id", F.posexplode("texts").alias("block_idx", "t"))
    return b.select("doc_id", "block_idx", F.col("t.self_ref").alias("self_ref"), F.col("t.label").alias("label"), F.col("t.text").alias("text"), F.expr("t.prov[0].page_no").alias("page"), F.col("t.parent.`$ref`").alias("parent_ref"))


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, member, content) of ZIP files; folders, resource forks and names that leave the target are skipped."""

    def safe(name: str) -> bool:
        parts = name.replace("\\", "/").split("/")
        return not name.endswith("/") and "__MACOSX" not in parts and ".." not in parts and not name.startswith(("/", "\\")) and not re.match(r"^[A-Za-z]:", name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for name in z.namelist():
                            if safe(name):
                                yield pd.DataFrame({"archive": [path], "member": [name], "content": [z.read(name)]})
                except zipfile.BadZipFile:
                    continue

    return files.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def html_text(html: Column) -> Column:
    """Visible text of a page: without scripts, styles and tags, entities resolved, white space folded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?is)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", " ")
    for entity, ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(ch))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def cached(keys: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Rows of the cache for known keys and computed rows for the others, which alone are computed."""
    hits = cache.join(keys.select(key).distinct(), key, "left_semi")
    misses = compute(keys.join(cache.select(key), key, "left_anti"))
    return hits.unionByName(misses.select(*hits.columns))


def word_list(spark: SparkSession, path: str) -> frozenset[str]:
    """Words of a list file, one a line (a bounded resource)."""
    return frozenset(w for r in spark.read.text(path).collect() if (w := r[0].strip()))


def jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational store; with a numeric column and its bounds it is read in parallel ranges."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


@dataclass(frozen=True)
class Settings:
    """Driver-side settings; environment variables FOLIO_<NAME> and session settings folio.<name> override defaults."""

    k: int = 10
    top_r: int = 3
    use_reranker: bool = True
    mode: str = "hybrid"
    score_threshold: float = 0.0
    prompt_tokens: int = 6000
    template_tokens: int = 250
    emb_max_tokens: int = 512
    rrf_constant: int = 60

    @classmethod
    def load(cls, spark: SparkSession | None = None, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        values = {}
        for f in fields(cls):
            raw = env.get(f"FOLIO_{f.name.upper()}")
            if spark is not None:
                raw = spark.conf.get(f"folio.{f.name}", raw) if raw is not None else spark.conf.get(f"folio.{f.name}", None)
            if raw is not None:
                kind = type(f.default)
                try:
                    values[f.name] = raw.strip().lower() in ("1", "true", "yes") if kind is bool else kind(raw)
                except ValueError:
                    continue
        got = cls(**values)
        if not 0.0 < got.score_threshold < 1.0:
            got = cls(**{**values, "score_threshold": 0.0})
        return got
