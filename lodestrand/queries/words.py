"""Queries over tokens, terms and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.operators import dense, sparse
from lodestrand.queries import sqlparts as P
from lodestrand.queries.records import corpus
from lodestrand.queries.registry import query
from lodestrand.session import table

TF = f"{P.CORPUS}, toks AS (SELECT pos, unnest({P.tokens('content')}) AS term FROM corpus), tf AS (SELECT pos, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY pos)::BIGINT AS len FROM toks GROUP BY pos, term)"


@query(f"WITH {TF} SELECT pos, term, tf, len FROM tf")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return sparse.postings(corpus(spark, d))


@query(f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return sparse.doc_freq(sparse.postings(corpus(spark, d)))


@query(f"WITH {TF} SELECT (SELECT count(*) FROM corpus) AS n_docs, sum(tf)::BIGINT AS n_tokens, round(sum(tf) / greatest(1, (SELECT count(*) FROM corpus)), 6)::DOUBLE AS avg_len FROM tf")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return sparse.corpus_stats(docs, sparse.postings(docs)).withColumn("avg_len", F.round("avg_len", 6))


HASHED = """hashed AS (SELECT key, (('0x' || substr(sha256(w), 1, 8))::UBIGINT % 64)::INT AS slot, sum(n * CASE WHEN ('0x' || substr(sha256(w), 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM (SELECT key, w, count(*) AS n FROM runs GROUP BY key, w) GROUP BY 1, 2), unit AS (SELECT key, slot, x / CASE WHEN norm > 0 THEN norm ELSE 1 END AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY key)) AS norm FROM hashed))"""


@query(f"WITH {P.CORPUS}, runs AS (SELECT pos AS key, unnest({P.runs('content')}) AS w FROM corpus), {HASHED} SELECT key AS pos, slot, round(x, 6) AS x FROM unit WHERE x <> 0")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    vecs = dense.hash_embedding(corpus(spark, d), ["pos"])
    return vecs.select("pos", F.posexplode("vec").alias("slot", "x")).where("x <> 0").select("pos", "slot", F.round("x", 6).alias("x"))


@query("SELECT vec_id, i::INT AS place, round(x, 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS x FROM embeddings)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(dense.l2_normalize(F.col("embedding"))).alias("place", "x"))
    return rows.select("vec_id", "place", F.round("x", 6).alias("x"))


@query(
    "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT q.vec_id, n.vec_id AS other, list_cosine_similarity(q.v, n.v) AS c FROM u q JOIN u n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0) "
    "SELECT vec_id, other, round(c, 6) AS cosine, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY vec_id ORDER BY round(c, 9) DESC, other) QUALIFY row_number() OVER w <= 5"
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 50, against all."""
    rows = table(spark, d, "embeddings").select("vec_id", dense.l2_normalize(F.col("embedding")).alias("vec"))
    top = dense.search(rows.where("vec_id % 50 = 0"), rows.withColumnRenamed("vec_id", "other"), 5, ["vec_id"], "other", exclude_self=True)
    return top.select("vec_id", "other", F.round("score", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id, to_json(list_filter(s, lambda p: p <> ''))::VARCHAR AS sentences FROM (SELECT doc_id, list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])" + P.WS + "+', '\\1' || chr(10), 'g'), chr(10) || '+', chr(10), 'g'), chr(10)), lambda p: " + P.strip("p") + ") AS s FROM documents WHERE text IS NOT NULL)")
def grounding_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.to_json(T.sentences(F.col("text"))).alias("sentences"))
