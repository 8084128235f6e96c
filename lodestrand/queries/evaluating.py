"""Queries over answers: scores, gold documents, rows and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import evaluation, sparse
from lodestrand.queries import sqlparts as P
from lodestrand.queries.questions import asked
from lodestrand.queries.records import corpus
from lodestrand.queries.registry import query
from lodestrand.queries.searching import _BM25
from lodestrand.session import stage, table
from lodestrand.sources import sinks

_PAIRS = f"pairs AS (SELECT query_id, i AS place, {P.normalize_answer('a')} AS ref, {P.normalize_answer('p')} AS pred FROM (SELECT query_id, unnest(g) AS a, generate_subscripts(g, 1)::INT AS i, g[-1] AS p FROM (SELECT query_id, {P.ANSWERS} AS g FROM asked)))"
_W = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
_F1 = f"""CASE WHEN len({_W('pred')}) = 0 AND len({_W('ref')}) = 0 THEN 1.0 WHEN len({_W('pred')}) = 0 OR len({_W('ref')}) = 0 OR {P.overlap(_W('pred'), _W('ref'))} = 0 THEN 0.0 ELSE
 2.0::DOUBLE * ({P.overlap(_W('pred'), _W('ref'))}::DOUBLE / len({_W('pred')})) * ({P.overlap(_W('pred'), _W('ref'))}::DOUBLE / len({_W('ref')})) / ({P.overlap(_W('pred'), _W('ref'))}::DOUBLE / len({_W('pred')}) + {P.overlap(_W('pred'), _W('ref'))}::DOUBLE / len({_W('ref')})) END::DOUBLE"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every answer of a question against its last one, which stands for a prediction."""
    rows = asked(spark, d).where(F.size("answers") > 0).select("query_id", F.element_at("answers", -1).alias("p"), F.posexplode("answers").alias("i", "a"))
    return rows.select("query_id", (F.col("i") + 1).alias("place"), T.normalize_answer(F.col("a")).alias("ref"), T.normalize_answer(F.col("p")).alias("pred"))


@query(f"WITH {P.QUESTIONS}, {_PAIRS} SELECT query_id, place, ref, pred FROM pairs")
def normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(f"WITH {P.QUESTIONS}, {_PAIRS} SELECT query_id, place, ref = pred AS em FROM pairs")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("query_id", "place", (F.col("ref") == F.col("pred")).alias("em"))


@query(f"WITH {P.QUESTIONS}, {_PAIRS} SELECT query_id, place, round({_F1}, 6) AS f1 FROM pairs")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("query_id", "place", F.round(T.token_f1(F.col("pred"), F.col("ref")), 6).alias("f1"))


@query(f"WITH {P.QUESTIONS}, {_PAIRS} SELECT query_id, bool_or(ref = pred) AS em, round(max({_F1}), 6) AS f1 FROM pairs WHERE place > 1 GROUP BY query_id")
def best_reference(spark: SparkSession, d: str) -> DataFrame:
    """The last answer against all but the first."""
    rows = asked(spark, d).where(F.size("answers") > 1)
    best = evaluation.best_reference(F.element_at("answers", -1), F.slice("answers", F.lit(2), F.size("answers")))
    return rows.select("query_id", best.alias("b")).select("query_id", "b.em", F.round("b.f1", 6).alias("f1"))


_GOLD = "gold AS (SELECT a.query_id, list_sort(list(DISTINCT doc_id)) AS ids FROM asked a JOIN corpus c ON a.context = c.content GROUP BY a.query_id)"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.gold_documents(asked(spark, d), corpus(spark, d))


@query(f"WITH {P.QUESTIONS}, {P.CORPUS}, {_GOLD} SELECT query_id, coalesce(array_to_string(ids, ','), '') AS gold FROM asked LEFT JOIN gold USING (query_id)")
def gold_documents(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d).select("query_id", F.array_join("gold_ids", ",").alias("gold"))


_RANKED = f"WITH {P.QUESTIONS}, q AS (SELECT query_id, query FROM asked), {_BM25}, {_GOLD}, hits AS (SELECT s.query_id, min(rank) AS first FROM sparse s JOIN corpus c USING (pos) JOIN gold g ON g.query_id = s.query_id AND list_contains(g.ids, c.doc_id) WHERE rank <= 4 GROUP BY 1)"


def _retrieved(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    found = sparse.search(asked(spark, d).select("query_id", "query"), docs, V.TOP_K, posts=stage(sparse.postings(docs), "postings"))
    return found.join(docs.select("pos", "doc_id", "content"), "pos")


@query(f"{_RANKED} SELECT query_id, g.ids IS NOT NULL AS retrieval_evaluable, CASE WHEN g.ids IS NOT NULL THEN (first IS NOT NULL)::INT::DOUBLE END AS recall_at_k, CASE WHEN g.ids IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank FROM asked LEFT JOIN gold g USING (query_id) LEFT JOIN hits USING (query_id)")
def reciprocal_rank(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.retrieval_scores(_gold(spark, d), _retrieved(spark, d))


@query(f"{_RANKED} SELECT count(*) FILTER (g.ids IS NOT NULL) AS evaluable, round(avg((first IS NOT NULL)::INT) FILTER (g.ids IS NOT NULL), 6) AS recall_at_k, round(coalesce(sum(1.0::DOUBLE / first), 0) / count(*), 6) AS mrr FROM asked LEFT JOIN gold g USING (query_id) LEFT JOIN hits USING (query_id)")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    scores = evaluation.retrieval_scores(_gold(spark, d), _retrieved(spark, d))
    mrr = F.coalesce(F.sum("reciprocal_rank"), F.lit(0.0)) / F.count("*")
    return scores.agg(F.count_if("retrieval_evaluable").alias("evaluable"), F.round(F.avg("recall_at_k"), 6).alias("recall_at_k"), F.round(mrr, 6).alias("mrr"))


@query(
    f"{_RANKED}, w AS (SELECT query_id, unnest({P.ANSWERS}) AS a FROM asked), n AS (SELECT query_id, {P.normalize_answer('a')} AS a FROM w), t AS (SELECT query_id, {P.normalize_answer('content')} AS t FROM sparse JOIN corpus USING (pos) WHERE rank <= 4), "
    "h AS (SELECT DISTINCT n.query_id FROM n JOIN t USING (query_id) WHERE n.a <> '' AND contains(' ' || t.t || ' ', ' ' || n.a || ' ')) SELECT query_id, query_id IN (SELECT query_id FROM h) AS hit FROM asked"
)
def hit_rate_text(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.text_hits(asked(spark, d).select("query_id", "answers"), _retrieved(spark, d).select("query_id", "content"))


@query(
    "SELECT source AS \"Model\", printf('%.4f', round(avg((n_chars > 800)::INT), 6)) AS \"EM\", count(*)::VARCHAR AS \"QA Examples\" FROM documents WHERE source IS NOT NULL GROUP BY 1"
)
def comparison_format(spark: SparkSession, d: str) -> DataFrame:
    """The formats of the comparison over shares of long documents by source."""
    share = F.round(F.avg((F.col("n_chars") > 800).cast("double")), 6)
    rows = table(spark, d, "documents").where("source is not null").groupBy("source").agg(share.alias("em"), F.count("*").alias("num_qa_examples"))
    return sinks.comparison(rows, "source").select("Model", "EM", "QA Examples")
