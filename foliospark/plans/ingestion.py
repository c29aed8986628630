"""Ingest queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, render
from ..functions.text import count_tokens, heading_level, heading_markup, heading_text, normalized, simple_sentences, whitespace_tokens
from ..operators import chunking, metrics, selection, structure
from ..sources.files import html_text
from .common import INDEX_SQL, index, table

LIMIT = 40
_SENT_SQL = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?।])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')"
_NTOK_SQL = r"CASE WHEN trim({c}, ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}, ' '), '\s+')) END"
_FOLD_SQL = f"""f AS (SELECT *, list_reduce(list_transform({_SENT_SQL}, lambda s: {{'done': []::VARCHAR[], 'cur': [s], 'n': {_NTOK_SQL.format(c="s")}, 'last': {_NTOK_SQL.format(c="s")}}}),
 lambda a, x: {{'done': CASE WHEN a.n + x.last > {LIMIT} THEN list_append(a.done, array_to_string(a.cur, ' ')) ELSE a.done END,
 'cur': CASE WHEN a.n + x.last <= {LIMIT} THEN list_concat(a.cur, x.cur) WHEN len(a.cur) > 0 THEN list_concat(a.cur[-1:], x.cur) ELSE x.cur END,
 'n': CASE WHEN a.n + x.last <= {LIMIT} THEN a.n + x.last WHEN len(a.cur) > 0 THEN a.last + x.last ELSE x.last END, 'last': x.last}},
 {{'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0, 'last': 0}}) AS st FROM documents),
folded AS (SELECT * EXCLUDE st, CASE WHEN len(st.cur) > 0 THEN list_append(st.done, array_to_string(st.cur, ' ')) ELSE st.done END AS chunks FROM f)"""


def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "filename", "type", "source", "language", "subject", "class_level", "page_numbers", "page_content")
    keep = [F.coalesce(c, F.lit("")).alias(c) for c in ("filename", "type", "language", "subject", "class_level", "page_numbers")]
    return rows.select("chunk_id", "load_seq", *keep, F.md5(F.coalesce("page_content", F.lit(""))).alias("content_md5"))


def upsert_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the first half of the arrivals, updated by the second half."""
    rows = table(spark, sf_dir, "chunks").select("chunk_id", "load_seq", "class_level")
    half = rows.agg((F.max("load_seq") / 2).alias("h"))
    both = rows.crossJoin(F.broadcast(half))
    old = selection.last_wins(both.where("load_seq <= h").drop("h"), "chunk_id", "load_seq")
    new = selection.last_wins(both.where("load_seq > h").drop("h"), "chunk_id", "load_seq")
    return selection.upsert(old, new, "chunk_id").groupBy(F.coalesce("class_level", F.lit("")).alias("class_level")).agg(F.count("*").alias("n"), F.sum("load_seq").alias("seq_sum"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return docs.select("doc_id", ids.chunk_key(F.coalesce("text", F.lit(""))).alias("text_key"), ids.positional_chunk_key(F.coalesce("source", F.lit("")), n, F.coalesce("text", F.lit(""))).alias("positional_key"))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ids.checksum(F.coalesce("text", F.lit(""))).alias("sha256"))


def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "settings").select("collection", ids.collection_name(F.col("milvus_db_prefix"), F.col("collection")).alias("store_name"))


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of exported images: a UUID of the image's path in the UUID of its collection."""
    rows = index(spark, sf_dir, "type", "source", "collection").where("type = 'image' and source is not null and collection is not null")
    return rows.select("chunk_id", ids.name_uuid(F.lit(ids.DNS_NAMESPACE), F.col("collection")).alias("space"), ids.image_uuid(F.col("collection"), F.col("source")).alias("name"))


def ingest_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ingest_stats(index(spark, sf_dir, "filename", "type"))


def stats_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stats_report(ingest_stats_rollup(spark, sf_dir))


def unprocessed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the manifest that have no chunk yet, and files with chunks that no manifest entry names."""
    files = table(spark, sf_dir, "chunks").select("filename").where("filename is not null").distinct()
    listed = table(spark, sf_dir, "manifest").select("filename").where("filename is not null").distinct()
    missing = selection.unprocessed(listed, files, "filename").withColumn("lacks", F.lit("chunks"))
    return missing.unionByName(selection.unprocessed(files, listed, "filename").withColumn("lacks", F.lit("manifest")))


def unprocessed_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a difference of sets, by file stem."""
    stem = render.file_stem(F.col("filename")).alias("stem")
    listed = table(spark, sf_dir, "manifest").where("filename is not null and coalesce(has_tables, false)").select(stem)
    done = table(spark, sf_dir, "chunks").where("type = 'table'").select(stem)
    return listed.subtract(done)


def checksum_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work list: of files as they are now (every fifth path has changed) those whose checksum or outputs are not there."""
    manifest = table(spark, sf_dir, "manifest")
    changed = F.pmod(F.length("path") + F.ascii(F.substring("sha256", 1, 1)), F.lit(5)) == 0
    files = manifest.select("path", F.when(changed, F.sha2(F.col("path"), 256)).otherwise(F.col("sha256")).alias("sha256")).distinct()
    return selection.changed_files(files, manifest)


def keep_filter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose summary the classifier keeps (here: it has an even number of characters), joined by key."""
    tables = index(spark, sf_dir, "type", "filename", "page_content").where("type = 'table'").select("chunk_id", "filename", "page_content")
    flags = tables.where("page_content is not null").select("chunk_id", (F.length("page_content") % 2 == 0).alias("keep"))
    return selection.kept(tables, flags, ["chunk_id"]).select("chunk_id", "filename")


def combine_docs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "type", "filename", "page_content", "source")
    docs = [rows.where(F.col("type") == t).select("chunk_id", "filename", "type", F.coalesce("source", F.lit("")).alias("source")) for t in ("text", "table", "image")]
    both = chunking.combined_documents(*docs)
    return both.select("chunk_id", "filename", "type", "branch", F.md5("source").alias("source_md5"))


def _titles(c: str) -> list[F.Column]:
    crumb = F.coalesce(F.col(c), F.lit(""))
    return [F.regexp_extract(crumb, "Chapter: (.*?) (?:Section: |$)", 1), F.regexp_extract(crumb, "Section: (.*?) $", 1)]


def breadcrumb_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadcrumbs taken apart and put together again, before the content they head."""
    rows = index(spark, sf_dir, "type", "source", "page_content").where("type = 'text'")
    chapter, section = _titles("source")
    empty = F.lit("")
    crumb = chunking.breadcrumb(chapter, section, empty, empty)
    body = F.coalesce("page_content", F.lit(""))
    return rows.select("chunk_id", chapter.alias("chapter"), section.alias("section"), F.md5(chunking.with_breadcrumb(crumb, body)).alias("document_md5"))


def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("chunks", chunking.fold_sentences(simple_sentences(F.coalesce("text", F.lit(""))), LIMIT))
    return docs.select("doc_id", F.size("chunks").alias("n_chunks"), F.size(F.filter("chunks", lambda c: c == "")).alias("n_empty"), F.md5(F.array_join("chunks", "|")).alias("chunks_md5"))


def chunk_fold_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", chunking.fold_sentences(simple_sentences(F.coalesce("text", F.lit(""))), LIMIT).alias("chunks"))
    return chunking.parts(docs, "chunks").select("doc_id", "part_id", F.md5("content").alias("content_md5"), count_tokens(F.col("content")).cast("int").alias("n_tokens"))


def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 64 tokens that overlap by 8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", chunking.fixed_windows(whitespace_tokens(F.coalesce("text", F.lit(""))), 64, 8).alias("w"))
    return docs.select("doc_id", F.posexplode("w").alias("n", "tokens")).select("doc_id", "n", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "page_numbers")
    pages = chunking.distinct_pages(F.coalesce("page_numbers", F.lit("[]")))
    return rows.select("chunk_id", F.to_json(pages).alias("pages"), F.size(pages).alias("n_pages"), F.array_min(pages).alias("first_page"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of 15 pages of every file, up to its last page."""
    rows = index(spark, sf_dir, "filename", "page_numbers")
    last = rows.groupBy("filename").agg(F.max(F.array_max(chunking.distinct_pages(F.coalesce("page_numbers", F.lit("[]"))))).alias("pages")).where("pages > 0")
    return last.select("filename", F.explode(chunking.page_ranges(F.col("pages"))).alias("r")).select("filename", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"))


def toc_carried_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.carried_levels(table(spark, sf_dir, "toc").select("doc_id", "pos", "title", "level")).select("doc_id", "pos", "full_level")


def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.carried_titles(table(spark, sf_dir, "toc"), "level", "title").select("doc_id", "pos", "title_1", "title_2", "title_3", "title_4")


def font_level_dense_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels from sizes: every entry's size follows from its level, every seventh entry carries hash marks instead."""
    toc = table(spark, sf_dir, "toc")
    text = F.when(F.col("pos") % 7 == 3, heading_markup(F.pmod("pos", F.lit(3)) + 1, F.col("title"))).otherwise(F.col("title"))
    headers = toc.select("doc_id", "pos", text.alias("text"), (24.0 - 2.5 * F.col("level")).alias("font_size"))
    return structure.font_levels(headers).select("doc_id", "pos", "text", "level")


def header_font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sizes of each document, largest first."""
    toc = table(spark, sf_dir, "toc").withColumn("font_size", 24.0 - 2.5 * F.col("level"))
    sizes = F.sort_array(F.collect_set("font_size"), asc=False)
    return toc.groupBy("doc_id").agg(F.array_join(F.transform(sizes, lambda x: x.cast("decimal(6,2)").cast("string")), ",").alias("sizes"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the documents: a sentence each, labelled by position."""
    sents = simple_sentences(F.coalesce("text", F.lit("")))
    b = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(sents).alias("block_idx", "text"))
    i = F.col("block_idx")
    label = F.when(i % 9 == 4, "section_header").when(i % 11 == 6, "page_footer").when(i % 13 == 8, "code").when(i % 17 == 5, "formula").when(i % 5 == 2, "list_item").otherwise("text")
    return b.select("doc_id", "block_idx", label.alias("label"), "text", F.floor(i / 6).cast("int").alias("page"))


_BLOCKS_SQL = f"""s AS (SELECT doc_id::VARCHAR AS doc_id, {_SENT_SQL} AS x FROM documents), e AS (SELECT doc_id, unnest(range(len(x))) AS block_idx, unnest(x) AS text FROM s),
blocks AS (SELECT doc_id, block_idx, CASE WHEN block_idx % 9 = 4 THEN 'section_header' WHEN block_idx % 11 = 6 THEN 'page_footer' WHEN block_idx % 13 = 8 THEN 'code' WHEN block_idx % 17 = 5 THEN 'formula' WHEN block_idx % 5 = 2 THEN 'list_item' ELSE 'text' END AS label,
text, (block_idx // 6)::INT AS page, sum((block_idx % 9 = 4)::INT) OVER (PARTITION BY doc_id ORDER BY block_idx) AS section_id FROM e)"""


def section_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.section_contents(structure.sections(_blocks(spark, sf_dir)))
    return rows.select("doc_id", "section_id", F.md5("content").alias("content_md5"), F.array_join(F.transform("page_range", lambda x: x.cast("string")), ",").alias("pages"), F.array_join("source_nodes", ",").alias("nodes"))


def dropped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _blocks(spark, sf_dir).where(~F.col("label").isin(*selection.DROPPED_LABELS))
    return kept.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


def header_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "toc").select("doc_id", "pos", heading_markup(F.coalesce("level", F.lit(0)), F.coalesce("title", F.lit(""))).alias("m"))
    return marked.select("doc_id", "pos", "m", heading_level(F.col("m")).alias("marks"), heading_text(F.col("m")).alias("title"))


def toc_fuzzy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers (titles in capitals without their first two letters) found again in the table of contents by fuzzy ratio."""
    toc = table(spark, sf_dir, "toc").where("title is not null")
    headers = toc.select("doc_id", F.col("pos").alias("block_idx"), F.upper(F.expr("substring(title, 3)")).alias("text"))
    return structure.toc_matches(headers, toc).select("doc_id", "block_idx", "level", "toc_pos")


def header_line_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers found again, in capitals, among the lines of their page, and the size of these lines."""
    toc = table(spark, sf_dir, "toc").where("title is not null").withColumn("page", F.floor(F.col("pos") / 5).cast("int"))
    headers = toc.select("doc_id", F.col("pos").alias("block_idx"), "page", F.col("title").alias("text"))
    lines = toc.select("doc_id", "page", F.upper("title").alias("text"), (10.0 + F.pmod("pos", F.lit(4))).alias("font_size"))
    return structure.header_font_sizes(headers, lines).select("doc_id", "block_idx", "font_size")


def _numbered(spark: SparkSession, sf_dir: str, kind: str, name: str) -> DataFrame:
    """Chunks of one type, numbered within their file in the order of their ids."""
    rows = index(spark, sf_dir, "type", "filename").where(F.col("type") == kind)
    n = F.row_number().over(Window.partitionBy("filename").orderBy("chunk_id")) - 1
    return rows.select(F.col("filename").alias("doc_id"), n.alias(name), "chunk_id")


def caption_join_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the files with their first caption; the titles of the files are the captions, some of them of pictures."""
    i = F.col("pos")
    ref = F.when(i % 4 == 3, F.concat(F.lit("#/pictures/"), (i % 5).cast("string"))).otherwise(F.concat(F.lit("#/tables/"), (i % 7).cast("string")))
    captions = table(spark, sf_dir, "toc").select("doc_id", i.alias("caption_idx"), ref.alias("parent_ref"), F.col("title").alias("text"))
    return structure.table_captions(_numbered(spark, sf_dir, "table", "table_idx"), structure.routed_captions(captions)[0]).select("chunk_id", "table_idx", "caption")


def caption_join_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the files with the texts they refer to: titles of the file, two for each image."""
    images = _numbered(spark, sf_dir, "image", "image_idx")
    child = [F.concat(F.lit("#/texts/"), (F.col("image_idx") + k).cast("string")) for k in (0, 3)]
    texts = table(spark, sf_dir, "toc").where("title is not null").select("doc_id", F.concat(F.lit("#/texts/"), F.col("pos").cast("string")).alias("self_ref"), F.col("title").alias("text"))
    return structure.image_captions(images.withColumn("children", F.array(*child)), texts).select("chunk_id", "image_idx", "caption")


def line_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, laid out eight a line and five lines a page, back to lines."""
    words = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("i", "text"))
    i, size = F.col("i"), F.length("text")
    top = F.floor(i % 40 / 8) * 12.0 + F.pmod(i, F.lit(3)) * 0.01
    laid = words.select(
        "doc_id", F.floor(i / 40).cast("int").alias("page"), "text", top.alias("top"), (top + 10).alias("bottom"), (700.0 - F.pmod(i, F.lit(8)) * 80).alias("x0"), (770.0 - F.pmod(i, F.lit(8)) * 80).alias("x1"),
        (9.0 + F.pmod(size, F.lit(3))).alias("size"), F.when(size % 2 == 0, "A").otherwise("B").alias("fontname"),
    )
    lines = structure.lines_of_words(laid)
    return lines.select("doc_id", "page", "line_top", F.md5("text").alias("text_md5"), "font_size", "fontname", "x0", "x1", "top", "bottom")


def label_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _blocks(spark, sf_dir)
    return b.select("doc_id", "block_idx", F.md5(chunking.wrapped_by_label(F.col("label"), F.col("text"))).alias("wrapped_md5"))


def metadata_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that each way of filtering lets through: exact, loose, and none."""
    rows = index(spark, sf_dir, "language", "subject", "class_level")
    want = {"language": "English", "subject": "Physics", "class_level": None}
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.agg(n(selection.exact_filter(want)).alias("n_exact"), n(selection.loose_filter(want)).alias("n_loose"), n(selection.loose_filter({"language": ""}, True)).alias("n_blank"), n(selection.exact_filter({"language": ""})).alias("n_all"))


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "subject", "class_level")
    return rows.groupBy(normalized(F.coalesce("subject", F.lit(""))).alias("subject"), normalized(F.coalesce("class_level", F.lit(""))).alias("class_level")).agg(F.count("*").alias("n"))


def document_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "type", "page_content", "source", "filename", "page_numbers")
    empty = F.lit("")
    source = F.coalesce("source", empty)
    image = F.regexp_replace(F.base64(F.encode(source, "UTF-8")), "[\r\n]", "")
    html = render.document_html(F.coalesce("type", empty), F.coalesce("page_content", empty), source, F.pmod("load_seq", F.lit(100)) / 100.0, F.pmod("load_seq", F.lit(10)) + 1, F.coalesce("filename", empty), F.coalesce("page_numbers", empty), image, F.col("chunk_id"))
    return rows.select("chunk_id", F.md5(html).alias("html_md5"))


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of the tables' HTML."""
    rows = index(spark, sf_dir, "type", "source").where("type = 'table' and source is not null")
    return rows.select("chunk_id", html_text(F.col("source")).alias("text"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, target name and language folder of the manifest's paths."""
    p = F.col("path")
    return table(spark, sf_dir, "manifest").where("path is not null").select("path", render.file_stem(p).alias("stem"), render.with_suffix(p, ".json").alias("target"), render.language_folder(p, 2).alias("folder")).distinct()


def data_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries as data URIs and back."""
    rows = index(spark, sf_dir, "type", "page_content").where("type = 'image' and page_content is not null")
    uri = render.data_uri(F.encode("page_content", "UTF-8"))
    return rows.select("chunk_id", F.md5(F.regexp_replace(uri, "[\r\n]", "")).alias("uri_md5"), F.md5(render.data_uri_bytes(uri)).alias("back_md5"))


def log_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress by the log lines of an ingest of the manifest's files: one of nine kinds of line each."""
    k = F.pmod(F.length("path") + F.ascii(F.substring("sha256", 1, 1)), F.lit(9))
    heads = ["Saving uploaded ZIP ", "Extracting into ", "Processing file ", "Converting ", "Creating chunks of ", "Embedding ", "Inserted ", "Finished with exit code 0: ", "Waiting for "]
    lines = table(spark, sf_dir, "manifest").where("path is not null and sha256 is not null").select("path", F.concat(F.element_at(F.array(*map(F.lit, heads)), (k + 1).cast("int")), F.col("path")).alias("line")).distinct()
    return lines.select("path", "line", render.progress(F.col("line")).alias("percent"))


def sse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of event lines that carry the evaluation items, in eight shapes."""
    q = F.coalesce("question", F.lit(""))
    k = F.pmod("item_id", F.lit(8))
    js = lambda *fields: F.to_json(F.struct(*fields))
    choice = lambda c: js(F.array(c).alias("choices"))
    body = (
        F.when(k == 0, choice(F.struct(F.struct(q.alias("content")).alias("delta")))).when(k == 1, choice(F.struct(q.alias("text")))).when(k == 2, js(F.lit(3).alias("n"), q.alias("text")))
        .when(k == 3, js(F.lit(3).alias("n"), F.lit(" ").alias("a"), q.alias("b"), F.lit("later").alias("c"))).when(k == 4, F.lit("[DONE]")).when(k == 5, F.concat(F.lit("plain "), q))
        .when(k == 6, choice(F.struct(F.struct(F.lit("assistant").alias("role")).alias("delta"))))
    )
    line = F.when(k == 7, F.concat(F.lit(": "), q)).otherwise(F.concat(F.lit("data: "), body))
    return table(spark, sf_dir, "eval_items").select("item_id", render.sse_text(line).alias("text"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth of replies that repeat the evaluation items behind one of four heads."""
    head = F.element_at(F.array(*map(F.lit, [" YES. ", "no, ", "Well, yes: ", ""])), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "eval_items").select("item_id", render.says_yes(F.concat(head, F.coalesce("question", F.lit("")))).alias("keep"))


_UUID_SQL = "substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||substr('89ab', (strpos('0123456789abcdef', substr({h},17,1)) - 1) % 4 + 1, 1)||substr({h},18,3)||'-'||substr({h},21,12)"

QUERIES = {
    "upsert_last_wins": (upsert_last_wins, f"WITH {INDEX_SQL} SELECT chunk_id, load_seq, coalesce(filename, '') AS filename, coalesce(type, '') AS type, coalesce(language, '') AS language, coalesce(subject, '') AS subject, coalesce(class_level, '') AS class_level, coalesce(page_numbers, '') AS page_numbers, md5(coalesce(page_content, '')) AS content_md5 FROM idx"),
    "upsert_two_batches": (upsert_two_batches, f"WITH {INDEX_SQL} SELECT coalesce(class_level, '') AS class_level, count(*) AS n, sum(load_seq)::BIGINT AS seq_sum FROM idx GROUP BY 1"),
    "chunk_ids": (
        chunk_ids,
        """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), h AS (SELECT doc_id, md5(t) AS a, md5(s || '-' || n || '-' || t) AS b FROM d)
        SELECT doc_id, (('0x' || a[1:16])::UBIGINT % 9223372036854775808)::BIGINT AS text_key, (('0x' || b[1:16])::UBIGINT % 9223372036854775808)::BIGINT AS positional_key FROM h""",
    ),
    "checksums": (checksums, "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents"),
    "collection_names": (collection_names, "SELECT collection, milvus_db_prefix || '_' || md5(collection) AS store_name FROM settings"),
    "image_names": (
        image_names,
        f"""WITH {INDEX_SQL}, a AS (SELECT chunk_id, source, sha1(unhex('{ids.DNS_NAMESPACE}') || collection::BLOB) AS h FROM idx WHERE type = 'image' AND source IS NOT NULL AND collection IS NOT NULL),
        b AS (SELECT chunk_id, source, {_UUID_SQL.format(h="h")} AS space FROM a), c AS (SELECT chunk_id, space, sha1(unhex(replace(space, '-', '')) || encode(source)) AS h FROM b) SELECT chunk_id, space, {_UUID_SQL.format(h="h")} AS name FROM c""",
    ),
    "ingest_stats_rollup": (
        ingest_stats_rollup,
        f"""WITH {INDEX_SQL} SELECT CASE WHEN grouping(filename) = 1 THEN 'TOTAL' ELSE coalesce(filename, '') END AS filename, count(*) AS n_chunks, count_if(type = 'text')::BIGINT AS n_text, count_if(type = 'table')::BIGINT AS n_tables, count_if(type = 'image')::BIGINT AS n_images, grouping(filename)::INT AS is_total FROM idx GROUP BY ROLLUP (filename)""",
    ),
    "stats_report": (
        stats_report,
        f"""WITH {INDEX_SQL}, s AS (SELECT CASE WHEN grouping(filename) = 1 THEN 'TOTAL' ELSE coalesce(filename, '') END AS filename, grouping(filename)::INT AS is_total, count(*) AS a, count_if(type = 'text') AS b, count_if(type = 'table') AS c, count_if(type = 'image') AS d FROM idx GROUP BY ROLLUP (filename))
        SELECT filename, is_total, rpad(filename, 40, ' ') || lpad(a::VARCHAR, 10, ' ') || lpad(b::VARCHAR, 10, ' ') || lpad(c::VARCHAR, 10, ' ') || lpad(d::VARCHAR, 10, ' ') AS line FROM s""",
    ),
    "unprocessed_anti_join": (
        unprocessed_anti_join,
        """SELECT DISTINCT filename, 'chunks' AS lacks FROM manifest m WHERE filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.filename = m.filename)
        UNION ALL SELECT DISTINCT filename, 'manifest' FROM chunks c WHERE filename IS NOT NULL AND NOT EXISTS (SELECT 1 FROM manifest m WHERE c.filename = m.filename)""",
    ),
    "unprocessed_difference": (
        unprocessed_difference,
        """SELECT regexp_replace(regexp_extract(filename, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM manifest WHERE filename IS NOT NULL AND coalesce(has_tables, false)
        EXCEPT SELECT regexp_replace(regexp_extract(filename, '([^/]+)$', 1), '\\.[^.]*$', '') FROM chunks WHERE type = 'table'""",
    ),
    "checksum_skip": (
        checksum_skip,
        """WITH f AS (SELECT DISTINCT path, CASE WHEN (length(path) + ascii(substr(sha256, 1, 1))) % 5 = 0 THEN sha256(path) ELSE sha256 END AS sha256 FROM manifest)
        SELECT path, sha256 FROM f WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.path = f.path AND m.sha256 = f.sha256 AND coalesce(has_text, false) AND coalesce(has_tables, false) AND coalesce(has_images, false))""",
    ),
    "keep_filter_join": (keep_filter_join, f"WITH {INDEX_SQL} SELECT chunk_id, filename FROM idx WHERE type = 'table' AND page_content IS NOT NULL AND length(page_content) % 2 = 0"),
    "combine_docs_union": (combine_docs_union, f"WITH {INDEX_SQL} SELECT chunk_id, filename, type, CASE type WHEN 'text' THEN 0 WHEN 'table' THEN 1 ELSE 2 END::INT AS branch, md5(coalesce(source, '')) AS source_md5 FROM idx WHERE type IN ('text', 'table', 'image')"),
    "breadcrumb_content": (
        breadcrumb_content,
        f"""WITH {INDEX_SQL}, p AS (SELECT chunk_id, coalesce(page_content, '') AS body, regexp_extract(coalesce(source, ''), 'Chapter: (.*?) (?:Section: |$)', 1) AS chapter, regexp_extract(coalesce(source, ''), 'Section: (.*?) $', 1) AS section FROM idx WHERE type = 'text'),
        c AS (SELECT *, CASE WHEN chapter <> '' THEN 'Chapter: ' || chapter || ' ' ELSE '' END || CASE WHEN section <> '' THEN 'Section: ' || section || ' ' ELSE '' END AS crumb FROM p)
        SELECT chunk_id, chapter, section, md5(CASE WHEN crumb <> '' THEN crumb || chr(10) || body ELSE body END) AS document_md5 FROM c""",
    ),
    "chunk_fold": (chunk_fold, f"WITH {_FOLD_SQL} SELECT doc_id, len(chunks)::INT AS n_chunks, len(list_filter(chunks, lambda c: c = ''))::INT AS n_empty, md5(array_to_string(chunks, '|')) AS chunks_md5 FROM folded"),
    "chunk_fold_parts": (
        chunk_fold_parts,
        f"WITH {_FOLD_SQL}, p AS (SELECT doc_id, unnest(chunks) AS content, unnest(range(len(chunks))) AS pos, len(chunks) AS n FROM folded) SELECT doc_id, CASE WHEN n > 1 THEN pos + 1 END::INT AS part_id, md5(content) AS content_md5, {_NTOK_SQL.format(c='content')}::INT AS n_tokens FROM p",
    ),
    "fixed_windows": (
        fixed_windows,
        r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(trim(coalesce(text, ''), ' ')), '\s+'), lambda x: x <> '') AS t FROM documents), w AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 8, 1), 56)) AS s FROM t WHERE len(t) > 0)
        SELECT doc_id, (s // 56)::INT AS n, len(t[s + 1 : s + 64])::INT AS n_tokens, md5(array_to_string(t[s + 1 : s + 64], ' ')) AS tokens_md5 FROM w""",
    ),
    "page_lists": (
        page_lists,
        f"""WITH {INDEX_SQL}, p AS (SELECT chunk_id, list_sort(list_distinct(list_filter(from_json(coalesce(nullif(page_numbers, ''), '[]'), '["INT"]'), lambda x: x IS NOT NULL))) AS p FROM idx) SELECT chunk_id, '[' || array_to_string(p, ',') || ']' AS pages, len(p)::INT AS n_pages, p[1]::INT AS first_page FROM p""",
    ),
    "page_ranges": (
        page_ranges,
        f"""WITH {INDEX_SQL}, p AS (SELECT filename, max(list_max(from_json(coalesce(nullif(page_numbers, ''), '[]'), '["INT"]'))) AS pages FROM idx GROUP BY filename), r AS (SELECT filename, pages, unnest(range(1, pages + 1, 15)) AS first_page FROM p WHERE pages > 0) SELECT filename, first_page::INT AS first_page, least(first_page + 14, pages)::INT AS last_page FROM r""",
    ),
    "toc_carried_levels": (toc_carried_levels, "SELECT doc_id, pos, coalesce(level, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1) AS full_level FROM toc"),
    "section_carry_forward": (
        section_carry_forward,
        "WITH d AS (SELECT *, CASE WHEN level BETWEEN 1 AND 3 THEN level WHEN level IS NOT NULL THEN 4 END AS deep FROM toc) SELECT doc_id, pos, "
        + ", ".join(f"coalesce(last_value(CASE WHEN deep <= {n} THEN CASE WHEN deep = {n} THEN coalesce(title, '') ELSE '' END END IGNORE NULLS) OVER w, '') AS title_{n}" for n in range(1, 5))
        + " FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)",
    ),
    "font_level_dense_rank": (
        font_level_dense_rank,
        """WITH h AS (SELECT doc_id, pos, title, 24.0 - 2.5 * level AS size, CASE WHEN pos % 7 = 3 THEN pos % 3 + 1 END AS marks FROM toc), s AS (SELECT doc_id, count(DISTINCT size) AS n FROM h GROUP BY doc_id)
        SELECT doc_id, pos, title AS text, coalesce(marks, CASE WHEN size IS NULL THEN n ELSE dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC NULLS LAST) END)::INT AS level FROM h JOIN s USING (doc_id)""",
    ),
    "header_font_sizes": (header_font_sizes, "SELECT doc_id, coalesce(string_agg(s, ',' ORDER BY v DESC), '') AS sizes FROM (SELECT DISTINCT doc_id, 24.0 - 2.5 * level AS v, (24.0 - 2.5 * level)::DECIMAL(6,2)::VARCHAR AS s FROM toc) GROUP BY doc_id"),
    "section_contents": (
        section_contents,
        f"""WITH {_BLOCKS_SQL}, w AS (SELECT doc_id, section_id, block_idx, page, CASE label WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'formula' THEN '$' || text || '$' ELSE text END || ' ' AS t FROM blocks WHERE label IN ('text', 'list_item', 'code', 'formula')),
        g AS (SELECT doc_id, section_id, string_agg(t, '' ORDER BY block_idx) AS content, list_sort(list_distinct(list(page))) AS p, string_agg('#/texts/' || block_idx, ',' ORDER BY block_idx) AS nodes FROM w GROUP BY ALL)
        SELECT doc_id, section_id::BIGINT AS section_id, md5(content) AS content_md5, array_to_string(p, ',') AS pages, nodes FROM g WHERE trim(content, ' ') <> ''""",
    ),
    "dropped_labels": (dropped_labels, f"WITH {_BLOCKS_SQL} SELECT label, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM blocks WHERE label NOT IN ('page_header', 'page_footer', 'caption', 'reference', 'footnote') GROUP BY label"),
    "header_marks": (header_marks, "SELECT doc_id, pos, repeat('#', coalesce(level, 0)) || ' ' || coalesce(title, '') AS m, coalesce(level, 0)::INT AS marks, trim(coalesce(title, ''), ' ') AS title FROM toc"),
    "toc_fuzzy_levels": (toc_fuzzy_levels, None),
    "header_line_sizes": (
        header_line_sizes,
        """WITH t AS (SELECT doc_id, pos, title, (pos // 5)::INT AS page, 10.0::DOUBLE + pos % 4 AS size FROM toc WHERE title IS NOT NULL)
        SELECT h.doc_id, h.pos AS block_idx, round(avg(l.size), 2) AS font_size FROM t h JOIN t l ON h.doc_id = l.doc_id AND h.page = l.page WHERE contains(lower(h.title), lower(l.title)) OR contains(lower(l.title), lower(h.title)) GROUP BY h.doc_id, h.pos, h.page, h.title""",
    ),
    "caption_join_tables": (
        caption_join_tables,
        f"""WITH {INDEX_SQL}, t AS (SELECT filename, chunk_id, row_number() OVER (PARTITION BY filename ORDER BY chunk_id) - 1 AS n FROM idx WHERE type = 'table'), c AS (SELECT doc_id, pos % 7 AS n, arg_min(title, pos) FILTER (title IS NOT NULL) AS any_title, min(pos) AS first FROM toc WHERE pos % 4 <> 3 GROUP BY ALL)
        SELECT chunk_id, t.n::INT AS table_idx, title AS caption FROM t LEFT JOIN c ON t.filename = c.doc_id AND t.n = c.n LEFT JOIN toc ON toc.doc_id = c.doc_id AND toc.pos = c.first""",
    ),
    "caption_join_images": (
        caption_join_images,
        f"""WITH {INDEX_SQL}, i AS (SELECT filename, chunk_id, row_number() OVER (PARTITION BY filename ORDER BY chunk_id) - 1 AS n FROM idx WHERE type = 'image')
        SELECT chunk_id, n::INT AS image_idx, coalesce(string_agg(title, ' ' ORDER BY pos) || ' ', '') AS caption FROM i LEFT JOIN toc ON toc.doc_id = i.filename AND toc.pos IN (i.n, i.n + 3) AND title IS NOT NULL GROUP BY chunk_id, n""",
    ),
    "line_assembly": (
        line_assembly,
        r"""WITH s AS (SELECT doc_id::VARCHAR AS doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' ') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, unnest(t) AS text, unnest(range(len(t))) AS i FROM s),
        v AS (SELECT doc_id, (i // 40)::INT AS page, text, (i % 40 // 8) * 12.0::DOUBLE AS line_top, (i % 40 // 8) * 12.0::DOUBLE + (i % 3) * 0.01::DOUBLE AS top, 700.0::DOUBLE - i % 8 * 80 AS x0, 9.0::DOUBLE + length(text) % 3 AS size, CASE WHEN length(text) % 2 = 0 THEN 'A' ELSE 'B' END AS font FROM w),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_top ORDER BY n DESC, p) AS r FROM (SELECT doc_id, page, line_top, size, count(*) AS n, min(x0) AS p FROM v GROUP BY ALL)), g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_top ORDER BY n DESC, p) AS r FROM (SELECT doc_id, page, line_top, font, count(*) AS n, min(x0) AS p FROM v GROUP BY ALL)),
        l AS (SELECT doc_id, page, line_top, md5(string_agg(text, ' ' ORDER BY x0)) AS text_md5, min(x0) AS x0, max(x0) + 70 AS x1, min(top) AS top, max(top) + 10 AS bottom FROM v GROUP BY ALL)
        SELECT l.*, size AS font_size, font AS fontname FROM l JOIN f USING (doc_id, page, line_top) JOIN g USING (doc_id, page, line_top) WHERE f.r = 1 AND g.r = 1""",
    ),
    "label_wrap": (label_wrap, f"WITH {_BLOCKS_SQL} SELECT doc_id, block_idx::INT AS block_idx, md5(CASE label WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'formula' THEN '$' || text || '$' ELSE text END || ' ') AS wrapped_md5 FROM blocks"),
    "metadata_filters": (
        metadata_filters,
        f"""WITH {INDEX_SQL} SELECT count_if(language = 'English' AND subject = 'Physics')::BIGINT AS n_exact, count_if(lower(trim(language, ' ')) = 'english' AND lower(trim(subject, ' ')) = 'physics')::BIGINT AS n_loose, count_if(trim(coalesce(language, ''), ' ') = '')::BIGINT AS n_blank, count(*) AS n_all FROM idx""",
    ),
    "label_values": (label_values, f"WITH {INDEX_SQL} SELECT lower(trim(coalesce(subject, ''), ' ')) AS subject, lower(trim(coalesce(class_level, ''), ' ')) AS class_level, count(*) AS n FROM idx GROUP BY 1, 2"),
    "document_html": (
        document_html,
        f"""WITH {INDEX_SQL}, h AS (SELECT chunk_id, load_seq, coalesce(type, '') AS t, coalesce(page_content, '') AS c, coalesce(source, '') AS s, coalesce(filename, '') AS f, coalesce(page_numbers, '') AS p FROM idx)
        SELECT chunk_id, md5('<h4>Document ' || (load_seq % 10 + 1) || ' (Score: ' || printf('%.4f', (load_seq % 100) / 100.0::DOUBLE) || '), (Doc: ' || f || ', Page: ' || p || ')</h4>' || CASE
        WHEN t = 'text' THEN '{render.TEXT_BOX}' || replace(c, chr(10), '<br>') || '</div>'
        WHEN t = 'table' AND s <> '' THEN '{render.TABLE_BOX}' || CASE WHEN lower(trim(s, ' ')) LIKE '<table%' THEN s ELSE '{render.TABLE_FRAME.replace("'", "''")}' || replace(replace(s, '<', '&lt;'), '>', '&gt;') || '</pre>' END || '<br><p><strong>Table Summary:</strong> ' || c || '</p></div>'
        WHEN t = 'image' THEN '{render.IMAGE_BOX}<img src="data:image/jpeg;base64,' || to_base64(encode(s)) || '" alt="Image ' || chunk_id || '" {render.IMAGE_STYLE} /><p><strong>Image Summary:</strong> ' || c || '</p></div>' ELSE '' END) AS html_md5 FROM h""",
    ),
    "table_text": (
        table_text,
        rf"""WITH {INDEX_SQL}, h AS (SELECT chunk_id, regexp_replace(source, '<[^>]+>', ' ', 'g') AS t FROM idx WHERE type = 'table' AND source IS NOT NULL)
        SELECT chunk_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS text FROM h""",
    ),
    "paths": (
        paths,
        r"""SELECT DISTINCT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') AS stem, regexp_replace(path, '\.[^./]*$', '') || '.json' AS target, CASE WHEN len(string_split(path, '/')) >= 2 THEN string_split(path, '/')[-2] END AS folder FROM manifest WHERE path IS NOT NULL""",
    ),
    "data_uris": (data_uris, f"WITH {INDEX_SQL} SELECT chunk_id, md5('data:image/png;base64,' || to_base64(encode(page_content))) AS uri_md5, md5(page_content) AS back_md5 FROM idx WHERE type = 'image' AND page_content IS NOT NULL"),
    "log_progress": (
        log_progress,
        """WITH k AS (SELECT DISTINCT path, (length(path) + ascii(sha256[1])) % 9 AS k FROM manifest WHERE path IS NOT NULL AND sha256 IS NOT NULL), l AS (SELECT path, ['Saving uploaded ZIP ', 'Extracting into ', 'Processing file ', 'Converting ', 'Creating chunks of ', 'Embedding ', 'Inserted ', 'Finished with exit code 0: ', 'Waiting for '][k + 1] || path AS line FROM k),
        w AS (SELECT * FROM (VALUES (1, 'saving uploaded zip', 5), (2, 'extracting into', 10), (3, 'processing file', 30), (4, 'converting', 30), (5, 'creating chunks', 55), (6, 'embedding', 75), (7, 'insert', 90), (8, 'finished with exit code 0', 100)) v(n, words, p))
        SELECT path, line, coalesce(arg_min(p, n), 15)::INT AS percent FROM l LEFT JOIN w ON contains(lower(line), words) GROUP BY path, line""",
    ),
    "sse_text": (sse_text, "SELECT item_id, nullif(CASE WHEN item_id % 8 IN (0, 1, 2, 3) THEN CASE WHEN item_id % 8 = 3 AND trim(coalesce(question, '')) = '' THEN 'later' ELSE question END WHEN item_id % 8 = 5 THEN trim('plain ' || coalesce(question, '')) END, '') AS text FROM eval_items"),
    "replies": (replies, "SELECT item_id, item_id % 4 IN (0, 2) OR contains(lower(coalesce(question, '')), 'yes') AS keep FROM eval_items"),
}
