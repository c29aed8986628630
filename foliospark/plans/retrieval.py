"""Search queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import render
from ..functions.models import embed_udf
from ..functions.text import count_tokens, language_tokens_udf, whitespace_tokens, word_tokens
from ..operators import dense, hybrid, sparse
from ..operators.selection import exact_filter, loose_filter
from .common import INDEX_SQL, K, QUESTION_SQL, TOKENS_SQL, index, query_vector, question, sparse_index, table

FILTERS = {"language": "English", "subject": "Physics", "class_level": ""}
PROMPT = "Answer from the text.\n\n{context}\n\nQuestion: {question}\nAnswer:"

_TOK = TOKENS_SQL.format(c="page_content")
_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DIST = "list_distance(embeddings::DOUBLE[], q)"
_DENSE_SQL = f"dense AS (SELECT chunk_id AS id, distance, row_number() OVER (ORDER BY distance, chunk_id) AS place FROM (SELECT chunk_id, {_DIST} AS distance FROM idx, q WHERE embeddings IS NOT NULL AND len(embeddings) = len(q)) ORDER BY place LIMIT {K})"
_DOCS_SQL = f"docs AS (SELECT chunk_id AS id, {_TOK} AS tokens FROM idx)"
_QT_SQL = f"qt AS (SELECT unnest({TOKENS_SQL.format(c='question')}) AS term FROM ({QUESTION_SQL})), qtf AS (SELECT term, count(*) AS qtf FROM qt GROUP BY term)"
_TFIDF_SQL = f"""{_DOCS_SQL}, n AS (SELECT count(*) AS n FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
idf AS (SELECT term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), n),
{_QT_SQL}, qw AS (SELECT term, qtf * idf AS qw FROM qtf JOIN idf USING (term)), qn AS (SELECT sqrt(sum(qw * qw)) AS qn FROM qw),
per AS (SELECT id, sqrt(sum(tf * idf * tf * idf)) AS norm, sum(tf * idf * qw) AS dot FROM post JOIN idf USING (term) LEFT JOIN qw USING (term) GROUP BY id),
scores AS (SELECT docs.id, coalesce(dot / (norm * qn), 0) AS score FROM docs LEFT JOIN per USING (id), qn)"""
_BM25_SQL = f"""{_DOCS_SQL}, n AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM docs),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL),
raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), n),
{_QT_SQL}, m AS (SELECT avg(idf) AS m FROM raw), qw AS (SELECT term, qtf * CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS qw FROM qtf JOIN raw USING (term), m),
per AS (SELECT id, sum(qw * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len(tokens) / avgdl))) AS score FROM post JOIN qw USING (term) JOIN docs USING (id), n GROUP BY id),
scores AS (SELECT docs.id, coalesce(per.score, 0) AS score FROM docs LEFT JOIN per USING (id))"""
_SPARSE_SQL = "sparse AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM scores ORDER BY place LIMIT {n})"
_FUSED_SQL = f"""both_lists AS (SELECT id, place, 0 AS list FROM dense UNION ALL SELECT id, place, 1 FROM sparse),
fused AS (SELECT id, sum(1.0::DOUBLE / (60 + place)) AS rrf, min(list * 1000000 + place) AS first FROM both_lists GROUP BY id),
best AS (SELECT id, rrf, row_number() OVER (ORDER BY rrf DESC, first) AS place FROM fused ORDER BY place LIMIT {K})"""


def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dense.top_k(index(spark, sf_dir, "embeddings", "filename"), query_vector(spark, sf_dir), K)
    return near.select("chunk_id", "filename", F.round("distance", 6).alias("distance"))


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dense.top_k(index(spark, sf_dir, "embeddings", "filename"), query_vector(spark, sf_dir), K, "cosine")
    return near.select("chunk_id", "filename", F.round("distance", 6).alias("distance"))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index(spark, sf_dir, "embeddings", "language", "subject", "class_level").where(exact_filter(FILTERS))
    return dense.top_k(rows, query_vector(spark, sf_dir), K).select("chunk_id", "language", "subject", F.round("distance", 6).alias("distance"))


def dense_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whose id is divisible by 100, against the index."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = dense.batch_top_k(index(spark, sf_dir, "embeddings"), queries, K)
    return near.select("query_id", F.col("id").alias("chunk_id"), F.round("distance", 6).alias("distance"), "place")


def dense_ann_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partitioned index in memory of the plan: centres from a bounded sample, probes of 24 of 64 partitions."""
    rows = index(spark, sf_dir, "embeddings")
    q = query_vector(spark, sf_dir).first()
    ivf = dense.PartitionedIndex.fit(rows, "embeddings", k=64)
    return ivf.search(ivf.assign(rows, "embeddings"), list(q[0]), K, 24).select("chunk_id", F.round("distance", 6).alias("distance"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.tokenized(index(spark, sf_dir, "page_content"), "chunk_id", "page_content")


def _query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question(spark, sf_dir).select(word_tokens(F.col("question")).alias("tokens"))


def _stable(scores: DataFrame) -> DataFrame:
    """Scores that two engines sum up in another order rank alike when compared to nine digits."""
    return scores.withColumn("score", F.round("score", 9))


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sparse.top_k(_stable(sparse.indexed_tfidf(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K)
    return best.where(F.col("place") <= K).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "place")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = sparse.top_k(_stable(sparse.indexed_bm25(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K)
    return best.where(F.col("place") <= K).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "place")


def bm25_language_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with the tokenizer of each chunk's language (stems and stop words)."""
    tok = language_tokens_udf()
    docs = sparse.tokenized(index(spark, sf_dir, "page_content", "language"), "chunk_id", "page_content", tok(F.col("page_content"), F.col("language")))
    query = question(spark, sf_dir).select(tok(F.col("question"), F.lit("English")).alias("tokens"))
    best = sparse.top_k(_stable(sparse.bm25_scores(docs, query)), K)
    return best.where(F.col("place") <= K).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "place")


def sparse_topk_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter meets the first 3k of the ranking only, without regard to case; fewer than k can be left."""
    best = sparse.top_k(_stable(sparse.indexed_bm25(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K)
    rows = index(spark, sf_dir, "language", "subject").withColumnRenamed("chunk_id", "id")
    left = sparse.after_filter(rows.join(F.broadcast(best), "id"), loose_filter({"language": "english"}), K)
    return left.select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "place", "language")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dense.top_k(index(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), K)
    near = near.select(F.col("chunk_id").alias("id"), F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("place"))
    words = sparse.top_k(_stable(sparse.indexed_tfidf(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K).where(F.col("place") <= K).select("id", "place")
    return hybrid.fused(near, words, K)


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _fused(spark, sf_dir)
    rows = index(spark, sf_dir, "filename", "type", "page_numbers").withColumnRenamed("chunk_id", "id")
    return rows.join(F.broadcast(best), "id").select(F.col("id").alias("chunk_id"), "filename", "type", "page_numbers", F.round("rrf_score", 6).alias("rrf_score"), "place")


def hybrid_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of the fused list, then those of at least 0.016."""
    first = _fused(spark, sf_dir).orderBy("place").limit(5)
    return hybrid.cut_below(first, "rrf_score", 0.016).select(F.col("id").alias("chunk_id"), F.round("rrf_score", 6).alias("rrf_score"), "place")


def hit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found documents with empty defaults and the chain of scores."""
    rows = index(spark, sf_dir, "page_content", "filename", "type", "source", "page_numbers")
    part = F.pmod("load_seq", F.lit(4))
    scored = rows.withColumn("score", hybrid.hit_score(F.when(part == 0, 0.5), F.when(part <= 1, F.when(part == 1, 0.25).otherwise(0.0)), F.when(part <= 2, 0.125)))
    return hybrid.hit_columns(scored)


def rerank_topr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best of the BM25 candidates by the stand-in reranker: share of the question's words they have."""
    best = sparse.top_k(_stable(sparse.indexed_bm25(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K).where(F.col("place") <= K)
    rows = index(spark, sf_dir, "page_content").withColumnRenamed("chunk_id", "id").join(F.broadcast(best), "id").crossJoin(F.broadcast(question(spark, sf_dir)))
    top = hybrid.reranked(rows, F.col("question"), "page_content", 3)
    return top.select(F.col("id").alias("chunk_id"), F.round("rerank_score", 6).alias("rerank_score"))


def search_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with the stand-in models: embed, dense and sparse top ten, fuse, rerank to three, cut by score."""
    embed = embed_udf()
    rows = index(spark, sf_dir, "page_content").where("page_content is not null")
    vectors = rows.select("chunk_id", embed(F.col("page_content")).alias("embeddings"))
    q = question(spark, sf_dir)
    near = dense.top_k(vectors, q.select(embed(F.col("question")).alias("q")), K)
    near = near.select(F.col("chunk_id").alias("id"), F.row_number().over(Window.orderBy("distance", "chunk_id")).alias("place"))
    words = sparse.top_k(_stable(sparse.indexed_bm25(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K).where(F.col("place") <= K).select("id", "place")
    found = hybrid.fused(near, words, K).drop("place")
    texts = rows.select(F.col("chunk_id").alias("id"), "page_content").join(F.broadcast(found), "id").crossJoin(F.broadcast(q))
    top = hybrid.cut_below(hybrid.reranked(texts, F.col("question"), "page_content", 3), "rerank_score", 0.05)
    return top.select(F.col("id").alias("chunk_id"), F.round("rrf_score", 6).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of the question: the texts of its ten best chunks, cut to what the prompt leaves."""
    best = sparse.top_k(_stable(sparse.indexed_bm25(sparse_index(spark, sf_dir), _query_tokens(spark, sf_dir))), K).where(F.col("place") <= K)
    rows = index(spark, sf_dir, "page_content").withColumnRenamed("chunk_id", "id").join(F.broadcast(best), "id").where("page_content is not null")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("place", "page_content"))).alias("c"))  # at most K rows
    q = question(spark, sf_dir).select(count_tokens(F.col("question")).alias("qt"))
    text = hybrid.context(F.transform("c", lambda x: x["page_content"]), F.col("qt"), 400, 50)
    return packed.crossJoin(F.broadcast(q)).select(text.alias("context"), F.length(text).alias("n_chars"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of every evaluation item over the empty context."""
    p = render.filled(PROMPT, question=F.col("question"), context=F.lit(""))
    return table(spark, sf_dir, "eval_items").select("item_id", p.alias("prompt"))


def term_df_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    n = docs.agg(F.count("*").alias("n"))
    stats = sparse.term_stats(docs).crossJoin(F.broadcast(n))
    return stats.select("term", "df", F.round(sparse.smooth_idf(F.col("df"), F.col("n")), 6).alias("idf"), F.round(sparse.okapi_idf(F.col("df"), F.col("n")), 6).alias("okapi"))


def postings_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms, occurrences and the commonest term of every chunk."""
    p = sparse.postings(_docs(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"), F.max("tf").alias("max_tf"))
    return p.withColumnRenamed("id", "chunk_id")


def doc_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("tokens")
    return _docs(spark, sf_dir).agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avgdl"), F.max(n).alias("max_len"), F.min(n).alias("min_len"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", count_tokens(t).cast("int").alias("n_whitespace"), F.size(word_tokens(t)).alias("n_words"), F.size(whitespace_tokens(t)).alias("n_lower"))


QUERIES = {
    "dense_topk_l2": (dense_topk_l2, f"WITH {INDEX_SQL}, {_Q}, {_DENSE_SQL} SELECT chunk_id, filename, round(distance, 6) AS distance FROM dense JOIN idx ON chunk_id = id"),
    "dense_topk_cosine": (
        dense_topk_cosine,
        f"""WITH {INDEX_SQL}, {_Q}, v AS (SELECT chunk_id, filename, embeddings::DOUBLE[] AS e, q FROM idx, q WHERE embeddings IS NOT NULL)
        SELECT chunk_id, filename, round(distance, 6) AS distance FROM (SELECT chunk_id, filename, 1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))) AS distance FROM v WHERE list_dot_product(e, e) > 0) ORDER BY distance, chunk_id LIMIT {K}""",
    ),
    "dense_topk_filtered": (
        dense_topk_filtered,
        f"WITH {INDEX_SQL}, {_Q} SELECT chunk_id, language, subject, round({_DIST}, 6) AS distance FROM idx, q WHERE embeddings IS NOT NULL AND language = 'English' AND subject = 'Physics' ORDER BY {_DIST}, chunk_id LIMIT {K}",
    ),
    "dense_batch_topk": (
        dense_batch_topk,
        f"""WITH {INDEX_SQL}, qs AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
        d AS (SELECT query_id, chunk_id, {_DIST} AS distance FROM idx, qs WHERE embeddings IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS place FROM d)
        SELECT query_id, chunk_id, round(distance, 6) AS distance, place FROM r WHERE place <= {K}""",
    ),
    "dense_ann_probe": (dense_ann_probe, None),
    "tfidf_topk": (tfidf_topk, f"WITH {INDEX_SQL}, {_TFIDF_SQL}, {_SPARSE_SQL.format(n=K)} SELECT id AS chunk_id, round(score, 6) AS score, place FROM sparse"),
    "bm25_topk": (bm25_topk, f"WITH {INDEX_SQL}, {_BM25_SQL}, {_SPARSE_SQL.format(n=K)} SELECT id AS chunk_id, round(score, 6) AS score, place FROM sparse"),
    "bm25_language_topk": (bm25_language_topk, None),
    "sparse_topk_postfilter": (
        sparse_topk_postfilter,
        f"WITH {INDEX_SQL}, {_BM25_SQL}, {_SPARSE_SQL.format(n=3 * K)} SELECT id AS chunk_id, round(score, 6) AS score, place, language FROM sparse JOIN idx ON chunk_id = id WHERE lower(trim(coalesce(language, ''), ' ')) = 'english' ORDER BY place LIMIT {K}",
    ),
    "rrf_hybrid": (
        rrf_hybrid,
        f"WITH {INDEX_SQL}, {_Q}, {_DENSE_SQL}, {_TFIDF_SQL}, {_SPARSE_SQL.format(n=K)}, {_FUSED_SQL} SELECT chunk_id, filename, type, page_numbers, round(rrf, 6) AS rrf_score, place FROM best JOIN idx ON chunk_id = id",
    ),
    "hybrid_threshold": (
        hybrid_threshold,
        f"WITH {INDEX_SQL}, {_Q}, {_DENSE_SQL}, {_TFIDF_SQL}, {_SPARSE_SQL.format(n=K)}, {_FUSED_SQL} SELECT id AS chunk_id, round(rrf, 6) AS rrf_score, place FROM (SELECT * FROM best ORDER BY place LIMIT 5) WHERE rrf >= 0.016",
    ),
    "hit_projection": (
        hit_projection,
        f"""WITH {INDEX_SQL} SELECT coalesce(page_content, '') AS page_content, coalesce(filename, '') AS filename, coalesce(type, '') AS type, coalesce(source, '') AS source, coalesce(page_numbers, '') AS page_numbers, chunk_id,
        CASE load_seq % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 2 THEN 0.125 ELSE 0 END::DOUBLE AS score FROM idx""",
    ),
    "rerank_topr": (
        rerank_topr,
        f"""WITH {INDEX_SQL}, {_BM25_SQL}, {_SPARSE_SQL.format(n=K)}, w AS (SELECT list_distinct(regexp_split_to_array(lower(question), '\\s+')) AS qw FROM ({QUESTION_SQL}))
        SELECT chunk_id, round(len(list_intersect(qw, regexp_split_to_array(lower(page_content), '\\s+'))) / len(qw)::DOUBLE, 6) AS rerank_score FROM sparse JOIN idx ON chunk_id = id, w ORDER BY rerank_score DESC, chunk_id LIMIT 3""",
    ),
    "search_pipeline": (search_pipeline, None),
    "context_budget": (
        context_budget,
        f"""WITH {INDEX_SQL}, {_BM25_SQL}, {_SPARSE_SQL.format(n=K)}, ql AS (SELECT len(regexp_split_to_array(trim(question, ' '), '\\s+')) AS n FROM ({QUESTION_SQL})),
        c AS (SELECT string_split(string_agg(page_content, chr(10) || chr(10) ORDER BY place), ' ') AS t FROM sparse JOIN idx ON chunk_id = id WHERE page_content IS NOT NULL),
        x AS (SELECT array_to_string(t[1:(400 - 50 - n)], ' ') AS s FROM c, ql) SELECT s AS context, length(s)::INT AS n_chars FROM x""",
    ),
    "prompts": (prompts, "SELECT item_id, 'Answer from the text.' || chr(10) || chr(10) || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Answer:' AS prompt FROM eval_items"),
    "term_df_idf": (
        term_df_idf,
        f"""WITH {INDEX_SQL}, {_DOCS_SQL}, n AS (SELECT count(*) AS n FROM docs), s AS (SELECT term, count(*) AS df FROM (SELECT id, unnest(list_distinct(tokens)) AS term FROM docs) GROUP BY term)
        SELECT term, df, round(ln((1 + n) / (1 + df)::DOUBLE) + 1, 6) AS idf, round(ln(n - df + 0.5) - ln(df + 0.5), 6) AS okapi FROM s, n""",
    ),
    "postings_by_chunk": (
        postings_by_chunk,
        f"""WITH {INDEX_SQL}, {_DOCS_SQL}, p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(tokens) AS term FROM docs) GROUP BY ALL)
        SELECT id AS chunk_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_tokens, max(tf) AS max_tf FROM p GROUP BY id""",
    ),
    "doc_length_stats": (
        doc_length_stats,
        f"WITH {INDEX_SQL}, {_DOCS_SQL} SELECT count(*) AS n_docs, sum(len(tokens))::BIGINT AS n_tokens, round(avg(len(tokens)), 6) AS avgdl, max(len(tokens))::INT AS max_len, min(len(tokens))::INT AS min_len FROM docs",
    ),
    "token_counts": (
        token_counts,
        f"""SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' '), '\\s+')) END::INT AS n_whitespace, len({TOKENS_SQL.format(c="text")})::INT AS n_words,
        len(list_filter(regexp_split_to_array(lower(trim(coalesce(text, ''), ' ')), '\\s+'), lambda x: x <> ''))::INT AS n_lower FROM documents""",
    ),
}
