"""Queries over ranked lists: BM25, dense search, fusion, diversity, contexts, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import context, dense, fusion, grounding, retrieval, sparse
from lodestrand.plans import pipelines, routing
from lodestrand.queries import sqlparts as P
from lodestrand.queries.questions import asked
from lodestrand.queries.records import _chunk_sql, corpus
from lodestrand.queries.registry import SQL, query
from lodestrand.queries.words import HASHED, TF
from lodestrand.session import stage, table

K = 5


def items(spark: SparkSession, d: str) -> DataFrame:
    """The questions of the held-out items (query_id, query)."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))


_BM25 = f"""{TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), st AS (SELECT (SELECT count(*) FROM corpus)::DOUBLE AS n, sum(tf)::DOUBLE / (SELECT count(*) FROM corpus) AS avg_len FROM tf),
 qt AS (SELECT query_id, term, count(*) AS q_tf FROM (SELECT query_id, unnest({P.tokens('query')}) AS term FROM q) GROUP BY ALL),
 sc AS (SELECT query_id, pos, sum(q_tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
 sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM sc WHERE score > 0)"""
_ITEMS = "q AS (SELECT item_id AS query_id, question AS query FROM eval_items)"
_DENSE = f"""runs AS (SELECT 'd' || pos AS key, unnest({P.runs('content')}) AS w FROM corpus UNION ALL SELECT 'q' || query_id, unnest({P.runs('query')}) FROM q), {HASHED},
 dot AS (SELECT a.key, b.key AS other, sum(a.x * b.x) AS score FROM unit a JOIN unit b USING (slot) WHERE starts_with(a.key, 'q') AND starts_with(b.key, 'd') GROUP BY ALL),
 every AS (SELECT 'q' || query_id AS key, query_id, 'd' || pos AS other, pos FROM q, corpus),
 dense AS (SELECT query_id, pos, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0), 9) DESC, pos) AS rank FROM every LEFT JOIN dot USING (key, other))"""


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = corpus(spark, d)
    return sparse.search(items(spark, d), docs, k, posts=stage(sparse.postings(docs), "postings"))


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    docs = dense.hash_embedding(corpus(spark, d), ["pos"])
    return dense.search(dense.hash_embedding(items(spark, d), ["query_id"], "query"), docs, k, ["query_id"], "pos")


@query(f"WITH {_ITEMS}, {_BM25} SELECT query_id, pos, round(score, 6) AS score, rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _sparse(spark, d, 10).select("query_id", "pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ITEMS}, {_BM25} SELECT query_id, count(*) AS matched, round(max(score), 6) AS best FROM sc GROUP BY query_id")
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    rows = sparse.scores(items(spark, d), docs, ["query_id"], posts=stage(sparse.postings(docs), "postings"))
    return rows.groupBy("query_id").agg(F.count("*").alias("matched"), F.round(F.max("score"), 6).alias("best"))


@query(f"WITH {_ITEMS}, {P.CORPUS}, {_DENSE} SELECT query_id, pos, round(score, 6) AS score, rank FROM dense WHERE rank <= {K}")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, K).select("query_id", "pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_REL = f"rel AS (SELECT query_id, query, pos, rank, content, {P.relevance('qt', 'dt', f'least(1.0, 0.25 * len({P.matched(chr(99) + chr(111) + chr(110) + chr(116) + chr(101) + chr(110) + chr(116))}))')} AS relevance FROM (SELECT l.query_id, q.query, l.pos, l.rank, content, {P.tokens('q.query')} AS qt, {P.tokens('content')} AS dt FROM pool l JOIN q USING (query_id) JOIN corpus USING (pos)))"


def _related(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    rows = ranked.join(corpus(spark, d).select("pos", "content", "label", "doc_id"), "pos").join(items(spark, d), "query_id")
    return retrieval.with_relevance(rows)


@query(f"WITH {_ITEMS}, {_BM25}, pool AS (SELECT * FROM sparse WHERE rank <= {K}), {_REL} SELECT query_id, pos, round(relevance, 6) AS relevance FROM rel")
def lexical_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d, _sparse(spark, d, K)).select("query_id", "pos", T.rounded(F.col("relevance")).alias("relevance"))


_RERANK = f"re AS (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round((1 - 0.35::DOUBLE) * (1 - (rank - 1) / n) + 0.35::DOUBLE * relevance, 9) DESC, rank) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM rel))"


@query(f"WITH {_ITEMS}, {P.CORPUS}, {_DENSE}, pool AS (SELECT * FROM dense WHERE rank <= {2 * K}), {_REL}, {_RERANK} SELECT query_id, pos, rank FROM re")
def dense_topk_rerank(spark: SparkSession, d: str) -> DataFrame:
    pool = _related(spark, d, _dense(spark, d, 2 * K))
    return dense.rerank(pool, ["query_id"], "pos").select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


_TWO = f"lists AS (SELECT query_id, pos, rank, 0 AS list_no FROM dense WHERE rank <= {2 * K} UNION ALL SELECT query_id, pos, rank, 1 FROM sparse WHERE rank <= {2 * K})"
_RRF = f"fused AS (SELECT query_id, arg_min(pos, list_no * 4294967296 + rank) AS pos, sum(1.0::DOUBLE / (60 + rank)) AS score, min(list_no * 4294967296 + rank) AS seen FROM lists JOIN corpus USING (pos) GROUP BY query_id, content, origin), pool AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS rank FROM fused QUALIFY rank <= {2 * K})"
_BOTH = f"WITH {_ITEMS}, {_BM25}, {_DENSE}, {_TWO}, {_RRF}"


def _keyed(spark: SparkSession, d: str, lists: DataFrame) -> DataFrame:
    keys = corpus(spark, d).select("pos", fusion.document_key(F.col("content"), F.col("origin")).alias("key"))
    return lists.join(keys, "pos")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    lists = _dense(spark, d, 2 * K).select("query_id", "pos", "rank", F.lit(0).alias("list_no"))
    lists = lists.unionByName(_sparse(spark, d, 2 * K).select("query_id", "pos", "rank", F.lit(1).alias("list_no")))
    return fusion.reciprocal_rank(_keyed(spark, d, lists), ["query_id"], ["key"], 2 * K, carry=["pos"]).drop("key")


@query(f"{_BOTH} SELECT query_id, pos, round(score, 6) AS score, rank FROM pool")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "pos", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"{_BOTH} SELECT query_id, arg_min(pos, list_no * 100 + rank) AS pos, min(list_no * 100 + rank)::BIGINT AS first_at FROM lists JOIN corpus USING (pos) GROUP BY query_id, content, origin")
def dedupe_preserve_order(spark: SparkSession, d: str) -> DataFrame:
    lists = _dense(spark, d, 2 * K).select("query_id", "pos", F.col("rank").cast("long").alias("first_at"))
    lists = lists.unionByName(_sparse(spark, d, 2 * K).select("query_id", "pos", (F.col("rank") + 100).cast("long").alias("first_at")))
    return fusion.first_of(_keyed(spark, d, lists), ["query_id", "key"], ["first_at"]).drop("key")


_JAC = f"""tk AS (SELECT query_id, rank, {P.tokens('content')} AS t FROM pool JOIN corpus USING (pos)), pr AS (SELECT a.query_id, a.rank AS rank_a, b.rank AS rank_b,
 CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) ELSE 0.0 END AS j FROM tk a JOIN tk b ON a.query_id = b.query_id AND a.rank < b.rank)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).join(corpus(spark, d).select("pos", T.tokens(F.col("content")).alias("toks")), "pos")


@query(f"{_BOTH}, {_JAC} SELECT query_id, rank_a, rank_b, round(j, 6) AS similarity FROM pr")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.pairs(_listed(spark, d), ["query_id"])
    return rows.select("query_id", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"), F.round("similarity", 6).alias("similarity"))


@query(f"{_BOTH}, {_JAC} SELECT query_id, round(avg((j >= 0.85)::INT), 6) AS duplicate_rate FROM pr GROUP BY query_id")
def duplicate_context_rate(spark: SparkSession, d: str) -> DataFrame:
    return fusion.duplicate_rate(_listed(spark, d), ["query_id"]).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


def _mmr_sql(k: int) -> str:
    parts, picked = [], "(SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS rank WHERE false)"
    for i in range(1, k + 1):
        parts.append(
            f"m{i} AS (SELECT c.query_id, c.rank, c.pos FROM cand c LEFT JOIN (SELECT p.query_id, s.r, max(s.j) AS worst FROM {picked} p JOIN sym s ON s.query_id = p.query_id AND s.o = p.rank GROUP BY ALL) w ON w.query_id = c.query_id AND w.r = c.rank "
            f"WHERE NOT EXISTS (SELECT 1 FROM {picked} p WHERE p.query_id = c.query_id AND p.rank = c.rank) "
            f"QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY round(c.relevance * 0.75::DOUBLE + 0.1::DOUBLE / c.rank - coalesce(worst, 0) * 0.25::DOUBLE, 12) DESC, c.rank) = 1)"
        )
        picked = "(" + " UNION ALL ".join(f"SELECT query_id, rank FROM m{x}" for x in range(1, i + 1)) + ")"
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT query_id, {i}::BIGINT AS pick_no, pos FROM m{i}" for i in range(1, k + 1))


@query(f"{_BOTH}, {_REL}, {_JAC}, cand AS MATERIALIZED (SELECT query_id, rank, pos, relevance FROM rel), sym AS MATERIALIZED (SELECT query_id, rank_a AS r, rank_b AS o, j FROM pr UNION ALL SELECT query_id, rank_b, rank_a, j FROM pr), {_mmr_sql(4)}")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    pool = _related(spark, d, _fused(spark, d)).select("query_id", "rank", "relevance", "toks", "pos")
    return fusion.diverse(pool, ["query_id"], 4).select("query_id", F.col("pick_no").cast("long").alias("pick_no"), "pos")


def _sentences_sql(x: str) -> str:
    """Sentences of a text without suspicious lines; the marks of the look-around are put in by replacement."""
    safe = P.strip(f"array_to_string(regexp_split_to_array({x}, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), chr(10))")
    marked = f"regexp_replace({safe}, '([.!?]){P.WS}+([A-Z0-9])', '\\1' || chr(10) || '\\2', 'g')"
    kept = f"list_filter(list_transform(regexp_split_to_array({marked}, '\\n+'), lambda p: {P.strip('p')}), lambda p: length(p) >= 3)"
    return f"CASE WHEN {P.suspicious(x)} OR {safe} = '' THEN [] WHEN len({kept}) > 0 THEN {kept} ELSE [{safe}] END"


CUT = f"cut AS (SELECT query_id, query, rank, label, content, generate_subscripts(ss, 1)::INT AS sentence_no, unnest(ss) AS sentence FROM (SELECT query_id, query, rank, label, content, {_sentences_sql('content')} AS ss FROM top))"
_TOP3 = f"WITH {_ITEMS}, {_BM25}, top AS (SELECT query_id, query, rank::INT AS rank, content, label FROM sparse JOIN corpus USING (pos) JOIN q USING (query_id) WHERE rank <= 3), {CUT}"
_NUM = r"'(?:^|[^\pL\pN_])\d{2,4}(?:$|[^\pL\pN_])'"
_CAPS = r"regexp_extract_all(regexp_replace(query, '([^\pL\pN_])', '\1\1', 'g'), '(?:^|[^\pL\pN_])([A-Z][a-zA-Z0-9]+)(?:$|[^\pL\pN_])', 1)"
_BONUS = (
    f"CASE WHEN len(qt) > 0 AND len(st) > 0 THEN least(0.25::DOUBLE, len(list_intersect(qt, st))::DOUBLE / len(list_distinct(qt)) * 0.15 + CASE WHEN regexp_matches(query, {_NUM}) AND regexp_matches(sentence, {_NUM}) THEN 0.10 ELSE 0.0 END "
    f"+ least(0.15::DOUBLE, len(list_filter({_CAPS}, lambda t: contains(lower(sentence), lower(t)))) * 0.05::DOUBLE)) ELSE 0.0 END"
)
#: From ``cut``: all sentences with their score, the best of each document, and the chosen ones.
EVIDENCE = f"""raw AS (SELECT *, {P.relevance('qt', 'st', f"least(1.0, 0.25 * len({P.matched('sentence')}))")} + {_BONUS} AS raw FROM (SELECT *, {P.tokens('query')} AS qt, {P.tokens('sentence')} AS st FROM cut)),
 num AS (SELECT *, round(raw, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank, sentence_no)::INT AS evidence_id FROM raw WHERE raw >= 0.01),
 doc3 AS (SELECT * FROM num QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY score DESC, sentence_no) <= 3),
 chosen AS (SELECT query_id, evidence_id, rank, sentence_no, sentence, score, label FROM doc3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, sentence_no) <= 10)"""
_CHOSEN = f"{_TOP3}, {EVIDENCE}"


@query(f"WITH {P.CORPUS} SELECT pos, generate_subscripts(ss, 1)::INT - 1 AS sentence_no, unnest(ss) AS sentence FROM (SELECT pos, {_sentences_sql('content')} AS ss FROM corpus)")
def evidence_sentences(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("pos", F.posexplode(T.evidence_sentences(F.col("content"))).alias("sentence_no", "sentence"))


def _top_docs(spark: SparkSession, d: str) -> DataFrame:
    return _related(spark, d, _sparse(spark, d, 3)).select("query_id", "query", "rank", "content", "label", "doc_id", "relevance")


@query(f"{_CHOSEN} SELECT * FROM chosen")
def select_evidence(spark: SparkSession, d: str) -> DataFrame:
    return context.select_evidence(_top_docs(spark, d), ["query_id"])


def _block_sql(n: int, budget: int) -> str:
    """The fold over ``n`` blocks, unrolled."""
    cut = lambda b, left: (
        f"CASE WHEN {left} <= 0 THEN '' WHEN length({b}) <= {left} THEN {b} WHEN {left} <= {len(V.TRUNCATED)} THEN substr({b}, 1, {left}) ELSE "
        f"(CASE WHEN length(rtrim(regexp_replace(substr({b}, 1, {left} - {len(V.TRUNCATED)}), ' [^ ]*$', ''))) > 0 THEN rtrim(regexp_replace(substr({b}, 1, {left} - {len(V.TRUNCATED)}), ' [^ ]*$', '')) ELSE rtrim(substr({b}, 1, {left} - {len(V.TRUNCATED)})) END) || {P.quoted(V.TRUNCATED)} END"
    )
    steps, prev = [], "(SELECT query_id, '' AS t, 0 AS n, bs FROM bl)"
    for i in range(1, n + 1):
        gap = "CASE WHEN t <> '' THEN 2 ELSE 0 END"
        left = f"({budget} - length(t) - {gap})"
        sep = "CASE WHEN t <> '' THEN chr(10) || chr(10) ELSE '' END"
        steps.append(f"f{i} AS (SELECT query_id, CASE WHEN bs[{i}] IS NULL OR {left} <= 0 THEN t ELSE t || {sep} || {cut(f'bs[{i}]', left)} END AS t, CASE WHEN bs[{i}] IS NULL OR {left} <= 0 THEN n ELSE n + 1 END AS n, bs FROM {prev})")
        prev = f"f{i}"
    return ", ".join(steps)


def context_parts(budget: int) -> str:
    """From ``chosen`` and ``top``: the context of each query with a document."""
    block = "printf('[Evidence %d | source=%s | score=%.3f]', evidence_id, label, score) || chr(10) || sentence"
    return (
        f"bl AS (SELECT query_id, list({block} ORDER BY rank, sentence_no) AS bs FROM chosen GROUP BY query_id), {_block_sql(10, budget)}, "
        f"ctx AS (SELECT query_id, coalesce(t, {P.quoted(V.NO_CONTEXT)}) AS context, coalesce(n, 0)::INT AS selected, original_chars FROM (SELECT query_id, sum(length(content))::BIGINT AS original_chars FROM top GROUP BY query_id) LEFT JOIN f10 USING (query_id))"
    )


def _context_sql(budget: int) -> str:
    return f"{_CHOSEN}, {context_parts(budget)}"


_PARTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace({P.strip('context')}, '([.!?]){P.WS}+', '\\1' || chr(10), 'g'), '\\n+'), lambda p: {P.strip('p')}), lambda p: p <> '')"


@query(f"{_context_sql(600)} SELECT query_id, context, selected, original_chars, length(context)::INT AS compressed_chars, CASE WHEN selected > 0 THEN round(length(context)::DOUBLE / original_chars, 4) ELSE 0.0 END AS ratio FROM ctx")
def compressed_context(spark: SparkSession, d: str) -> DataFrame:
    return context.compressed_context(_top_docs(spark, d), ["query_id"], 600)


@query(
    f"WITH {_ITEMS}, {_BM25}, top AS (SELECT query_id, rank, content, label FROM sparse JOIN corpus USING (pos) WHERE rank <= 3), "
    f"bl AS (SELECT query_id, list(printf('[Evidence %d | source=%s]', rank, label) || chr(10) || {P.strip(f'array_to_string(regexp_split_to_array(content, chr(13) || chr(10) || {chr(39)}|[{chr(92)}n{chr(92)}x0b{chr(92)}x0c{chr(92)}r{chr(92)}x{{85}}{chr(92)}x{{2028}}{chr(92)}x{{2029}}]{chr(39)}), chr(10))')} ORDER BY rank) AS bs FROM top WHERE NOT {P.suspicious('content')} GROUP BY query_id), "
    f"{_block_sql(3, 700)} SELECT query_id, t AS context FROM f3"
)
def evidence_block(spark: SparkSession, d: str) -> DataFrame:
    return context.evidence_block(_top_docs(spark, d), ["query_id"], 700)


def extract_parts(source: str) -> str:
    """From ``source`` (query_id, query, context): ``extract`` (query_id, answer), the sentence taken from each context."""
    return (
        f"parts AS (SELECT query_id, list_filter(list_distinct({P.runs('query')}), lambda t: length(t) > 2) AS qw, {_PARTS} AS ps, context FROM {source}), "
        "used AS (SELECT query_id, qw, context, CASE WHEN len(hs) > 0 THEN hs ELSE ps END AS us FROM (SELECT *, list_filter(ps, lambda p: NOT regexp_matches(p, '^\\[(?:Evidence|doc=|source=)')) AS hs FROM parts)), "
        f"sent AS (SELECT query_id, s, i, len(list_intersect(qw, {P.runs('s')})) AS hits FROM (SELECT query_id, qw, unnest(us) AS s, generate_subscripts(us, 1) AS i FROM used)), "
        "taken AS (SELECT query_id, s FROM sent QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, length(s), i) = 1), "
        f"extract AS (SELECT query_id, CASE WHEN contains(context, {P.quoted(V.NO_CONTEXT)}) OR s IS NULL THEN {P.quoted(V.EVIDENCE_ABSTENTION)} ELSE substr(s, 1, 300) END AS answer FROM parts LEFT JOIN taken USING (query_id))"
    )


@query(f"{_context_sql(V.CONTEXT_CHARS)}, asking AS (SELECT query_id, query, context FROM ctx JOIN q USING (query_id)), {extract_parts('asking')} SELECT query_id, answer FROM extract")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    built = context.compressed_context(_top_docs(spark, d), ["query_id"])
    return grounding.extractive_answer(items(spark, d).join(built, "query_id"), ["query_id"])


@query(
    f"SELECT 'sentences' AS kind, query_id, context, selected FROM ({SQL['compressed_context']}) UNION ALL SELECT 'documents', query_id, context, 0 FROM ({SQL['evidence_block']}) "
    f"UNION ALL SELECT 'none', query_id, '', 0 FROM ({SQL['compressed_context']})"
)
def context_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Contexts in their three kinds: chosen sentences, whole documents, none for want of a budget."""
    docs = stage(_top_docs(spark, d), "top-documents")
    kinds = {"sentences": context.extract(docs, ["query_id"], 600), "documents": context.extract(docs, ["query_id"], 700, compress=False), "none": context.extract(docs, ["query_id"], 0)}
    parts = [df.select(F.lit(kind).alias("kind"), "query_id", "context", "selected") for kind, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
