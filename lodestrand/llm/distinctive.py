"""Problem 4: how distinctive a term is of a record, against the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import contents, tokens
from lodestrand.session import stage

#: A term held by more than one in HOT_PARTS of all (record, term) rows is hot; there are under HOT_PARTS of them.
HOT_PARTS = 10_000


def record_terms(docs: DataFrame) -> DataFrame:
    """(doc_pos, term, tf, len): token counts of every content. Contents without a token give no row."""
    toks = contents(docs).select("doc_pos", tokens(F.col("content")).alias("toks"))
    rows = toks.select("doc_pos", F.size("toks").cast("long").alias("len"), F.explode("toks").alias("term"))
    return rows.groupBy("doc_pos", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def with_term_totals(terms: DataFrame, totals: DataFrame, rows: int) -> DataFrame:
    """Joins each (record, term) row with its term's totals. Terms of more than ``rows`` / HOT_PARTS rows, of which
    there can't be HOT_PARTS, are broadcast; the others are joined by shuffle, none with a large share of it."""
    hot = F.col("df") > F.lit(max(rows // HOT_PARTS, 1000))
    few, rest = totals.where(hot), totals.where(~hot)
    marked = terms.join(F.broadcast(few.withColumnRenamed("df", "hot_df").withColumnRenamed("total", "hot_total")), "term", "left")
    near = marked.where("hot_df is not null").withColumnsRenamed({"hot_df": "df", "hot_total": "total"})
    far = marked.where("hot_df is null").drop("hot_df", "hot_total").join(rest, "term")
    return near.unionByName(far)


def bm25(n: int, avg_len: float) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))"""
    tf, df, size = (F.col(c).cast("double") for c in ("tf", "df", "len"))
    idf = F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))
    return idf * tf * 2.5 / (tf + F.lit(1.5) * (F.lit(0.25) + F.lit(0.75) * size / F.lit(avg_len)))


def log_odds(all_tokens: int, prior: float = 1.0) -> Column:
    """z-score of the log-odds ratio of the record against all others. The Dirichlet prior of a term is its share of
    the collection times ``prior`` times the record's length: it weighs as much as ``prior`` average records of that
    length. A collection of a single term scores 0."""
    tf, total, size = (F.col(c).cast("double") for c in ("tf", "total", "len"))
    alpha0 = F.lit(prior) * size
    alpha = alpha0 * total / F.lit(float(all_tokens))
    rest, rest_size = total - tf, F.lit(float(all_tokens)) - size
    here = F.log(F.try_divide(tf + alpha, size + alpha0 - tf - alpha))
    there = F.log(F.try_divide(rest + alpha, rest_size + alpha0 - rest - alpha))
    spread = F.sqrt(F.lit(1.0) / (tf + alpha) + F.lit(1.0) / (rest + alpha))
    return F.coalesce((here - there) / spread, F.lit(0.0))


def scored_terms(docs: DataFrame, method: str = "log_odds") -> DataFrame:
    """(doc_pos, term, tf, df, score) for every term of every content, the score rounded to 6 decimals.

    ``method`` is ``log_odds`` (z-scores with an informative Dirichlet prior) or ``bm25``. Null and blank contents
    don't count; a collection of a single record, which has no rest to compare with, scores 0 by ``log_odds``.
    """
    if method not in ("log_odds", "bm25"):
        raise ValueError(f"unknown method: {method}")
    all_docs = docs.where(F.col("doc_pos").isNotNull())
    terms = stage(record_terms(all_docs), "record-terms")
    per_doc = terms.groupBy("doc_pos").agg(F.first("len").alias("len")).agg(F.sum("len").alias("tokens"), F.count("*").alias("n")).first()
    n = contents(docs.select("doc_pos", "content")).count()
    all_tokens = per_doc["tokens"] or 0
    totals = stage(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), "term-totals")
    rows = totals.agg(F.sum("df")).first()[0] or 0
    if method == "bm25":
        score = bm25(n, (all_tokens / n) if all_tokens else 1.0)
    elif (per_doc["n"] or 0) < 2:
        score = F.lit(0.0)
    else:
        score = log_odds(all_tokens)
    joined = with_term_totals(terms, totals, rows)
    return joined.select("doc_pos", "term", "tf", "df", F.round(score, 6).alias("score"))


def top_terms(docs: DataFrame, k: int = 3, least_tokens: int = 10, method: str = "log_odds") -> DataFrame:
    """The ``k`` highest terms of every content of at least ``least_tokens`` distinct tokens; equal scores in
    ascending order of term. (doc_pos, term, score, rank)"""
    scores = scored_terms(docs, method)
    order = Window.partitionBy("doc_pos").orderBy(F.desc("score"), "term")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(k, least_tokens))
    enough = F.count("*").over(Window.partitionBy("doc_pos"))
    return ranked.withColumn("seen", enough).where((F.col("seen") >= least_tokens) & (F.col("rank") <= k)).select("doc_pos", "term", "score", "rank")
