"""Sparse search as relations: postings, document frequencies, TF-IDF and BM25 scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_tokens


def tokenized(docs: DataFrame, id_col: str, text_col: str, tokens: Column | None = None) -> DataFrame:
    """(id, tokens); documents without text have none."""
    t = word_tokens(F.coalesce(F.col(text_col), F.lit(""))) if tokens is None else tokens
    return docs.select(F.col(id_col).alias("id"), t.alias("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf)."""
    return docs.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df): the number of documents that have a term.  Terms are made distinct per document before they are
    shuffled, and counted on the map side."""
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def okapi_idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def _terms_of(query: DataFrame) -> DataFrame:
    """(term, qtf) of a one-row frame with column tokens."""
    return query.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))


def tfidf_scores(docs: DataFrame, query: DataFrame) -> DataFrame:
    """(id, score) of all documents: cosine of TF-IDF vectors, 0 where no term is shared.

    The norm of a document needs the idf of all its terms; the postings meet the term statistics once, on the term.
    """
    n = docs.agg(F.count("*").alias("n"))
    idf = term_stats(docs).crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("df"), F.col("n")).alias("idf"))
    q = _terms_of(query).join(idf, "term").select("term", (F.col("qtf") * F.col("idf")).alias("qw"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    weighted = postings(docs).join(idf, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    per = weighted.join(F.broadcast(q), "term", "left").groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = per.crossJoin(F.broadcast(qnorm)).select("id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))
    return docs.select("id").join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def bm25_scores(docs: DataFrame, query: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of all documents: Okapi BM25.  Negative idfs are replaced by epsilon times the mean of all raw ones;
    query terms count as often as they occur.

    Only the query's terms are counted in the documents, by an array filter before anything is shuffled.
    """
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))
    raw = term_stats(docs).crossJoin(F.broadcast(stats)).select("term", okapi_idf(F.col("df"), F.col("n")).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    q = _terms_of(query).join(raw, "term").crossJoin(F.broadcast(mean))
    q = q.select("term", (F.col("qtf") * F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf"))).alias("qw"))
    terms = query.select(F.array_distinct("tokens").alias("qt"))
    narrowed = docs.crossJoin(F.broadcast(terms)).select("id", F.size("tokens").alias("dl"), F.filter("tokens", lambda x: F.array_contains("qt", x)).alias("hits"))
    tf = narrowed.select("id", "dl", F.explode("hits").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    part = tf.join(F.broadcast(q), "term").crossJoin(F.broadcast(stats.select("avgdl")))
    part = part.withColumn("s", F.col("qw") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    scored = part.groupBy("id").agg(F.sum("s").alias("score"))
    return docs.select("id").join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


@dataclass(frozen=True)
class SparseIndex:
    """A stored index.  postings: term, id, tf, in the order of terms, so that a search reads the row groups of its terms
    only.  terms: term, df.  docs: id, dl (length), norm of the TF-IDF vector (null without terms).  stats: one row
    with n, avgdl and the mean Okapi idf."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SparseIndex:
        return cls(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "docs", "stats")))


def save_index(docs: DataFrame, path: str) -> SparseIndex:
    """Fits an index on (id, tokens) and stores it.

    The postings of a common term are spread over partitions by range of (term, id), so no task holds a whole term;
    the join with the document frequencies is left to the optimizer (it broadcasts a small vocabulary).
    """
    spark = docs.sparkSession
    postings(docs).repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id", "tf").write.mode("overwrite").parquet(f"{path}/postings")
    post = spark.read.parquet(f"{path}/postings")
    post.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    terms = spark.read.parquet(f"{path}/terms")
    n = docs.agg(F.count("*").alias("n"))
    idf = terms.crossJoin(F.broadcast(n)).select("term", smooth_idf(F.col("df"), F.col("n")).alias("idf"))
    w = F.col("tf") * F.col("idf")
    per = post.join(idf, "term").groupBy("id").agg(F.sum("tf").alias("dl"), F.sqrt(F.sum(w * w)).alias("norm"))
    docs.select("id").join(per, "id", "left").select("id", F.coalesce("dl", F.lit(0)).alias("dl"), "norm").write.mode("overwrite").parquet(f"{path}/docs")
    kept = spark.read.parquet(f"{path}/docs")
    lengths = kept.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    mean = terms.crossJoin(F.broadcast(lengths)).agg(F.avg(okapi_idf(F.col("df"), F.col("n"))).alias("mean_idf"))
    lengths.crossJoin(mean).write.mode("overwrite").parquet(f"{path}/stats")
    return SparseIndex.load(spark, path)


def _asked(index: SparseIndex, query: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings of the query's terms, the terms with df and qtf); the terms of a query are few and known, so both are
    filters that reach the scan."""
    row = query.select("tokens").first()  # one query
    tokens = sorted(set(row["tokens"] or [])) if row else []
    of = F.col("term").isin(tokens) if tokens else F.lit(False)
    return index.postings.where(of), index.terms.where(of).join(F.broadcast(_terms_of(query)), "term").crossJoin(F.broadcast(index.stats))


def indexed_tfidf(index: SparseIndex, query: DataFrame) -> DataFrame:
    """(id, score) of all documents, as tfidf_scores, from a stored index."""
    post, terms = _asked(index, query)
    q = terms.select("term", smooth_idf(F.col("df"), F.col("n")).alias("idf"), "qtf").select("term", "idf", (F.col("qtf") * F.col("idf")).alias("qw"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = post.join(F.broadcast(q), "term").groupBy("id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("qw")).alias("dot"))
    both = index.docs.join(dots, "id", "left").crossJoin(F.broadcast(qnorm))
    return both.select("id", F.coalesce(F.col("dot") / (F.col("norm") * F.col("qnorm")), F.lit(0.0)).alias("score"))


def indexed_bm25(index: SparseIndex, query: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(id, score) of all documents, as bm25_scores, from a stored index."""
    post, terms = _asked(index, query)
    idf = okapi_idf(F.col("df"), F.col("n"))
    q = terms.select("term", "avgdl", (F.col("qtf") * F.when(idf < 0, epsilon * F.col("mean_idf")).otherwise(idf)).alias("qw"))
    hits = post.join(F.broadcast(q), "term").join(index.docs.select("id", "dl"), "id")
    part = F.col("qw") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("id").agg(F.sum(part).alias("score"))
    return index.docs.select("id").join(scored, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int, fetch: int = 3, order: str = "id") -> DataFrame:
    """The best *fetch* x k documents with their place; ties go to the earlier of *order*."""
    best = scores.orderBy(F.desc("score"), order).limit(fetch * k)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), order)))


def after_filter(ranked: DataFrame, condition: Column, k: int) -> DataFrame:
    """Of a ranked list the first k that meet the condition; there can be fewer."""
    return ranked.where(condition).orderBy("place").limit(k)
