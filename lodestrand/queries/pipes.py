"""Queries over whole pipelines: indexes, parent-child retrieval, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import dense, evaluation, retrieval
from lodestrand.plans import pipelines, routing
from lodestrand.queries import questions as Q
from lodestrand.queries import records, searching
from lodestrand.queries import retrievalsql as R
from lodestrand.queries import sqlparts as P
from lodestrand.queries.questions import asked
from lodestrand.queries.records import corpus
from lodestrand.queries.registry import SQL, query
from lodestrand.session import stage
from lodestrand.sources import documents as D
from lodestrand.sources import sinks


def index(spark: SparkSession, d: str, sizes: tuple[int, int]) -> retrieval.Index:
    """The corpus' index of chunks of these sizes, known by the corpus' fingerprint."""
    docs = corpus(spark, d)
    key = (spark.sparkContext.applicationId, D.fingerprint(docs).first()[0], sizes, dense.embedding_identity(dense.hash_embedding))
    return retrieval.prepared(key, lambda: retrieval.Index.build(pipelines.chunk_units(docs, *sizes)))


_PARENTS, _CHILDREN = (R.cut("pieces", "(SELECT pos, content FROM corpus)", "pos", *sizes) for sizes in (V.PARENT_CHUNK, V.CHILD_CHUNK))


@query(f"SELECT 'parent' AS kind, n AS units FROM (WITH RECURSIVE {P.CORPUS}, {_PARENTS} SELECT count(*) AS n FROM pieces) UNION ALL SELECT 'child', n FROM (WITH RECURSIVE {P.CORPUS}, {_CHILDREN} SELECT count(*) AS n FROM pieces)")
def index_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Units of the parent and of the child index."""
    sizes = [("parent", index(spark, d, V.PARENT_CHUNK).count()), ("child", index(spark, d, V.CHILD_CHUNK).count())]
    return spark.createDataFrame(sizes, "kind string, units long")


_BASE = f"WITH RECURSIVE {P.QUESTIONS}, {P.CORPUS}, q AS (SELECT query_id, query FROM asked), {R.baseline('q')}"


@query(f"{_BASE} SELECT query_id, rank, unit, round(relevance, 6) AS relevance FROM docs")
def baseline_retrieve(spark: SparkSession, d: str) -> DataFrame:
    rows = pipelines.baseline_retrieve(asked(spark, d).select("query_id", "query"), index(spark, d, V.CHILD_CHUNK))
    return rows.select("query_id", "rank", "unit", T.rounded(F.col("relevance")).alias("relevance"))


def _planned(spark: SparkSession, d: str) -> DataFrame:
    return stage(routing.planned(asked(spark, d).select("query_id", "query")), "planned")


_FIRST = "list_filter({0}, lambda a, i: list_position({0}, a) = i)".format("vs")
_PLANS = (
    f"{Q._PLAN}, plans AS (SELECT substr(key, 2)::BIGINT AS query_id, q AS query, greatest({V.TOP_K}, CASE WHEN points >= 4 THEN 6 WHEN points >= 2 THEN 5 ELSE 4 END)::BIGINT AS k, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS complexity, "
    f"{_FIRST}[1:CASE WHEN points >= 2 THEN 4 ELSE 3 END] AS vs, {_FIRST}[1:{V.RETRY_VARIANTS}] AS more FROM (SELECT key, q, points, {Q._VARS} AS vs FROM planned WHERE starts_with(key, 'q')))"
)
_TWO = f"WITH RECURSIVE {P.QUESTIONS}, {P.CORPUS}, {_PLANS}, {R.parent_child('plans')}"


@query(f"{_TWO} SELECT query_id, rank, unit, doc_id, round(relevance, 6) AS relevance FROM parent_docs")
def parent_retrieve(spark: SparkSession, d: str) -> DataFrame:
    docs, _ = pipelines.parent_retrieve(_planned(spark, d), index(spark, d, V.PARENT_CHUNK))
    return docs.select("query_id", "rank", "unit", "doc_id", T.rounded(F.col("relevance")).alias("relevance"))


def _two(spark: SparkSession, d: str) -> pipelines.Retrieved:
    return pipelines.parent_child_retrieve(_planned(spark, d), index(spark, d, V.PARENT_CHUNK))


@query(f"{_TWO} SELECT query_id, queries AS vector_queries, queries AS sparse_queries, backfill_searches FROM usage")
def usage_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Queries to vectors and postings of all searches of the parent-child retrieval: variants times searches."""
    return _two(spark, d).usage.drop("searched")


@query(f"{_TWO} SELECT query_id, rank, unit, doc_id, round(relevance, 6) AS relevance FROM docs")
def parent_child_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).documents.select("query_id", "rank", "unit", "doc_id", T.rounded(F.col("relevance")).alias("relevance"))


@query(f"{_TWO} SELECT query_id, attempted, accepted, original_status, retry_status FROM retry")
def corrective_retry(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).retry.drop("original_relevance", "retry_relevance")


_MEASURES = ["max_relevance", "avg_relevance", "duplicate_rate"]


@query(f"{_TWO} SELECT query_id, status, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)}, suspicious, num_documents FROM judged")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return _two(spark, d).quality.select("query_id", "status", *[T.rounded(F.col(c)).alias(c) for c in _MEASURES], "suspicious", F.size("scores").cast("long").alias("num_documents"))


#: From ``docs``, ``judged`` and ``ask`` (query_id, query): the answer, its context and its grounding.
_MADE = ", ".join([
    "top AS (SELECT query_id, query, rank::INT AS rank, content, label FROM docs JOIN ask USING (query_id))", searching.CUT, searching.EVIDENCE, searching.context_parts(V.CONTEXT_CHARS),
    f"asking AS MATERIALIZED (SELECT query_id, query, coalesce(context, {P.quoted(V.NO_CONTEXT)}) AS context, coalesce(selected, 0) AS selected, CASE WHEN selected > 0 THEN round(length(context)::DOUBLE / greatest(original_chars, 1), 4) ELSE 0.0 END::DOUBLE AS ratio FROM ask LEFT JOIN ctx USING (query_id))",
    searching.extract_parts("asking"), "answers_ AS (SELECT query_id AS id, answer, context FROM extract JOIN asking USING (query_id))", Q.support_parts("answers_"),
    f"made AS (SELECT *, {Q.held_sql('quality')} AS held FROM (SELECT s.*, j.status AS quality, j.* EXCLUDE (query_id, status) FROM support s LEFT JOIN judged j ON j.query_id = s.id))",
])
_NOTHING = "0.0::DOUBLE AS max_relevance, 0.0::DOUBLE AS avg_relevance, 0::BIGINT AS suspicious, 0.0::DOUBLE AS duplicate_rate, 0::BIGINT AS num_documents"
_ZEROS = "0::BIGINT AS selected, 0.0::DOUBLE AS ratio"
_USED = "false AS retry_attempted, false AS retry_accepted, 0::BIGINT AS backfill_searches, 0::BIGINT AS vector_queries"
_ANSWER = f"CASE WHEN held THEN {P.quoted(V.EVIDENCE_ABSTENTION)} ELSE a END AS answer"
_GROUNDED = "CASE WHEN held THEN 'abstained_unsupported_evidence' ELSE m.status END AS grounding, CASE WHEN held THEN 1.0 ELSE support_score END::DOUBLE AS support_score, CASE WHEN held THEN '' ELSE unsupported END AS unsupported"
_FIELDS = "round(max_relevance, 6) AS max_relevance, round(avg_relevance, 6) AS avg_relevance, suspicious, round(duplicate_rate, 6) AS duplicate_rate, num_documents"
_BLOCKED = f"""SELECT p.query_id, {P.quoted(V.STATIC_ABSTENTION)} AS answer, true AS blocked, false AS needs_retrieval, 1.0::DOUBLE AS confidence, 'static_corpus_policy' AS decision_source, reason AS reasoning, 'policy_blocked' AS stage, 'none' AS strategy,
 'policy_blocked' AS quality, {_NOTHING}, NULL AS complexity, 0::BIGINT AS context_chars, {_ZEROS}, 'abstained' AS grounding, 1.0::DOUBLE AS support_score, '' AS unsupported, {_USED}, 0::BIGINT AS total_llm_calls, 0::BIGINT AS total_operations FROM pol p WHERE blocked"""
_POL = f"pol AS (SELECT substr(key, 2)::BIGINT AS query_id, blocked, reason FROM ({SQL['static_policy']}) WHERE starts_with(key, 'q'))"

_BASELINE_RECORDS = f"""WITH RECURSIVE {P.QUESTIONS}, {P.CORPUS}, {_POL}, ask AS MATERIALIZED (SELECT query_id, query FROM asked JOIN pol USING (query_id) WHERE NOT blocked), {R.baseline('ask')}, {_MADE}
 SELECT m.id AS query_id, {_ANSWER}, false AS blocked, true AS needs_retrieval, 1.0::DOUBLE AS confidence, 'fixed' AS decision_source, 'Baseline always retrieves' AS reasoning, 'single' AS stage, 'early_chunk_hybrid_sparse_dense_mmr' AS strategy, quality, {_FIELDS},
 NULL AS complexity, length(context)::BIGINT AS context_chars, selected::BIGINT AS selected, ratio, {_GROUNDED}, false AS retry_attempted, false AS retry_accepted, 0::BIGINT AS backfill_searches, 1::BIGINT AS vector_queries, 1::BIGINT AS total_llm_calls, 3::BIGINT AS total_operations
 FROM made m JOIN asking ON asking.query_id = m.id UNION ALL {_BLOCKED}"""
_ROUTES = f"rt AS (SELECT substr(key, 2)::BIGINT AS query_id, needs_retrieval, confidence, source, reasoning FROM ({SQL['routing_decision']}) WHERE starts_with(key, 'q'))"
_ADAPTIVE_RECORDS = f"""WITH RECURSIVE {P.QUESTIONS}, {P.CORPUS}, {_POL}, {_ROUTES}, {_PLANS}, going AS MATERIALIZED (SELECT plans.* FROM plans JOIN pol USING (query_id) JOIN rt USING (query_id) WHERE NOT blocked AND needs_retrieval), {R.parent_child('going')}, ask AS (SELECT query_id, query FROM going), {_MADE}
 SELECT m.id AS query_id, {_ANSWER}, false AS blocked, true AS needs_retrieval, rt.confidence, rt.source AS decision_source, rt.reasoning, 'child' AS stage, CASE WHEN searched THEN 'adaptive_parent_child_multiquery_rrf_hybrid_contextual_mmr' ELSE 'parent_child_multiquery_rrf_hybrid' END AS strategy, quality, {_FIELDS},
 complexity, length(context)::BIGINT AS context_chars, selected::BIGINT AS selected, ratio, {_GROUNDED}, attempted AS retry_attempted, accepted AS retry_accepted, backfill_searches::BIGINT AS backfill_searches, queries::BIGINT AS vector_queries, 1::BIGINT AS total_llm_calls, (1 + 2 * queries)::BIGINT AS total_operations
 FROM made m JOIN asking ON asking.query_id = m.id JOIN going z ON z.query_id = m.id JOIN rt ON rt.query_id = m.id JOIN retry r ON r.query_id = m.id JOIN usage y ON y.query_id = m.id
 UNION ALL {_BLOCKED}
 UNION ALL SELECT query_id, {P.quoted(V.EVIDENCE_ABSTENTION)}, false, false, confidence, source, reasoning, 'decision_only', 'none', NULL, {_NOTHING}, NULL, {len(V.ROUTER_SKIPPED)}::BIGINT, {_ZEROS}, 'abstained', 1.0::DOUBLE, '', {_USED}, 1::BIGINT, 1::BIGINT FROM rt JOIN pol USING (query_id) WHERE NOT blocked AND NOT needs_retrieval"""


def shown(records_: DataFrame) -> DataFrame:
    rounded = {c: T.rounded(F.col(c)) for c in ("max_relevance", "avg_relevance", "duplicate_rate")}
    return records_.withColumns(rounded).withColumn("unsupported", F.array_join("unsupported", "|")).select(
        "query_id", "answer", "blocked", "needs_retrieval", "confidence", "decision_source", "reasoning", "stage", "strategy", "quality", "max_relevance", "avg_relevance", "suspicious", "duplicate_rate",
        "num_documents", "complexity", "context_chars", "selected", "ratio", "grounding", "support_score", "unsupported", "retry_attempted", "retry_accepted", "backfill_searches", "vector_queries", "total_llm_calls", "total_operations",
    )


def items_answered() -> str:
    """The baseline's records of the held-out items' questions."""
    asked_ = f"asked AS (SELECT item_id AS query_id, {P.strip('question')} AS query FROM eval_items)"
    return _BASELINE_RECORDS.replace(P.QUESTIONS, asked_)


@query(_BASELINE_RECORDS)
def baseline_answer(spark: SparkSession, d: str) -> DataFrame:
    return shown(pipelines.baseline_answer(asked(spark, d).select("query_id", "query"), index(spark, d, V.CHILD_CHUNK)))


@query(_ADAPTIVE_RECORDS)
def adaptive_answer(spark: SparkSession, d: str) -> DataFrame:
    return shown(pipelines.adaptive_answer(asked(spark, d).select("query_id", "query"), index(spark, d, V.PARENT_CHUNK)))


def _rows(spark: SparkSession, d: str, model: str) -> DataFrame:
    """Evaluation rows of a pipeline; questions without a context are expected to be abstained from."""
    questions, docs = asked(spark, d), corpus(spark, d)
    run, sizes = (pipelines.baseline, V.CHILD_CHUNK) if model == "baseline" else (pipelines.adaptive, V.PARENT_CHUNK)
    found, answers = run(questions.where(F.length("query") <= V.MAX_QUERY_CHARS).select("query_id", "query"), index(spark, d, sizes))
    return stage(evaluation.rows(questions, stage(answers, "records"), found, docs, records.expected_abstentions(spark, d), model), "evaluation")


def _docs_sql(sql: str) -> str:
    """The documents a pipeline's SQL retrieves, in place of its records."""
    return sql.rsplit("\n SELECT m.id AS query_id", 1)[0] + " SELECT query_id, rank, doc_id FROM docs"


def _rows_sql(model: str, sql: str) -> str:
    """Evaluation rows as one SELECT, without the columns that are taken over as they are."""
    refs = f"list_filter(list_transform({P.ANSWERS}, lambda a: {P.strip('''regexp_split_to_array(a, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{85}\\x{2028}\\x{2029}]')[1]''')}), lambda a: a <> '')"
    words = lambda x: f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    f1 = "CASE WHEN len(pw) = 0 AND len(rw) = 0 THEN 1.0 WHEN len(pw) = 0 OR len(rw) = 0 OR o = 0 THEN 0.0 ELSE 2.0::DOUBLE * (o::DOUBLE / len(pw)) * (o::DOUBLE / len(rw)) / (o::DOUBLE / len(pw) + o::DOUBLE / len(rw)) END::DOUBLE"
    forms = ", ".join(P.quoted(x.lower().rstrip(".")) for x in (V.EVIDENCE_ABSTENTION, V.STATIC_ABSTENTION))
    return f"""SELECT * FROM (WITH {P.QUESTIONS}, {P.CORPUS}, ev AS MATERIALIZED (SELECT query_id, query, context, {refs} AS refs FROM asked WHERE query <> ''), rec AS MATERIALIZED ({sql}), rdocs AS MATERIALIZED ({_docs_sql(sql)}),
 gold AS (SELECT e.query_id, list_sort(list(DISTINCT doc_id)) AS ids FROM ev e JOIN corpus c ON e.context = c.content GROUP BY e.query_id),
 hits AS (SELECT g.query_id, min(rank) AS first FROM gold g JOIN rdocs r USING (query_id) WHERE list_contains(g.ids, r.doc_id) GROUP BY 1),
 base AS (SELECT e.query_id, refs, g.ids, first, r.* EXCLUDE (query_id), length(e.query) > {V.MAX_QUERY_CHARS} OR r.query_id IS NULL AS failed, context IS NULL AND e.query_id > 0 AS wanted,
   CASE WHEN length(e.query) > {V.MAX_QUERY_CHARS} OR r.query_id IS NULL THEN '' ELSE {P.strip('''regexp_split_to_array(answer, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{85}\\x{2028}\\x{2029}]')[1]''')} END AS prediction FROM ev e LEFT JOIN gold g USING (query_id) LEFT JOIN hits USING (query_id) LEFT JOIN rec r USING (query_id) WHERE len(refs) > 0),
 pairs AS (SELECT query_id, {P.normalize_answer('prediction')} AS pred, {P.normalize_answer('ref')} AS ref FROM (SELECT query_id, prediction, unnest(refs) AS ref FROM base)),
 scored AS (SELECT query_id, bool_or(pred = ref) AS em, max({f1}) AS f1 FROM (SELECT *, {words('pred')} AS pw, {words('ref')} AS rw, {P.overlap(words('pred'), words('ref'))} AS o FROM pairs) GROUP BY query_id)
 SELECT '{model}' AS model, b.query_id AS index, prediction, NOT (wanted AND NOT failed) AND NOT failed AND s.em AS em, CASE WHEN wanted OR failed THEN 0.0 ELSE s.f1 END::DOUBLE AS f1, first IS NOT NULL AND NOT failed AS retrieval_hit, coalesce(array_to_string(ids, ','), '') AS gold, ids IS NOT NULL AS retrieval_evaluable,
   CASE WHEN ids IS NOT NULL AND NOT failed THEN (first IS NOT NULL)::INT::DOUBLE END AS recall_at_k, CASE WHEN ids IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank, wanted AND NOT failed AS expected_abstention,
   CASE WHEN wanted AND NOT failed THEN {Q._FORM('prediction')} IN ({forms}) END AS abstention_success, NOT (wanted AND NOT failed) AS scored_qa,
   CASE WHEN failed THEN 'error' WHEN wanted THEN 'expected_abstention' WHEN blocked THEN 'unexpected_model_policy_abstention' ELSE 'paired_closed_corpus_qa' END AS evaluation_category,
   coalesce(needs_retrieval, false) AS needs_retrieval, quality AS retrieval_quality_status, coalesce(suspicious, 0) AS suspicious_chunks, coalesce(duplicate_rate, 0) AS duplicate_context_rate, complexity AS query_complexity, grounding AS grounding_status, coalesce(grounding IN ('supported', 'abstained', 'abstained_unsupported_evidence'), false) AS answer_supported,
   support_score AS grounding_score, coalesce(ratio, 0) AS context_compression_ratio, coalesce(selected, 0) AS selected_evidence_sentences, coalesce(retry_attempted, false) AS corrective_retry_attempted, coalesce(retry_accepted, false) AS corrective_retry_accepted, coalesce(total_llm_calls, 0) AS total_llm_calls,
   coalesce(vector_queries, 0) AS vector_queries, coalesce(vector_queries, 0) AS sparse_queries, coalesce(total_operations, 0) AS total_operations FROM base b JOIN scored s USING (query_id))"""


_BOTH = f"{_rows_sql('baseline', _BASELINE_RECORDS)} UNION ALL {_rows_sql('adaptive', _ADAPTIVE_RECORDS)}"
_NAMES = (
    "model index prediction em retrieval_hit retrieval_evaluable recall_at_k expected_abstention abstention_success scored_qa evaluation_category needs_retrieval retrieval_quality_status suspicious_chunks "
    "query_complexity grounding_status answer_supported grounding_score context_compression_ratio selected_evidence_sentences corrective_retry_attempted corrective_retry_accepted total_llm_calls vector_queries sparse_queries total_operations"
).split()
_ROUNDED = ["f1", "reciprocal_rank", "duplicate_context_rate"]


@query(f"SELECT {', '.join(_NAMES)}, gold, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM ({_BOTH})")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both pipelines over all questions."""
    both = _rows(spark, d, "baseline").unionByName(_rows(spark, d, "adaptive"))
    return both.select(*_NAMES, F.array_join("gold_document_ids", ",").alias("gold"), *[T.rounded(F.col(c)).alias(c) for c in _ROUNDED])


def _summary_sql() -> str:
    rate = lambda c: f"round(count(*) FILTER (scored_qa AND coalesce({c}, false)) / greatest(count(*) FILTER (scored_qa), 1), 6)::DOUBLE"
    over = lambda part, whole: f"round(count(*) FILTER ({whole} AND coalesce({part}, false)) / greatest(count(*) FILTER ({whole}), 1), 6)::DOUBLE"
    mean = lambda c, of="true", n="count(*)": f"round(coalesce(sum(coalesce({c}, 0)) FILTER ({of}), 0)::DOUBLE / greatest({n}, 1), 6)"
    qa = "count(*) FILTER (scored_qa)"
    cols = {
        "em": rate("em"), "f1": mean("f1", "scored_qa", qa), "hit_rate": over("retrieval_hit", "scored_qa AND retrieval_evaluable"), "avg_latency": "0.0::DOUBLE", "amortized_latency": "0.0::DOUBLE", "setup_latency_sec": "0.0::DOUBLE",
        "avg_num_queries": mean("total_operations"), "avg_llm_calls": mean("total_llm_calls"), "avg_vector_queries": mean("vector_queries"), "retrieval_rate": rate("needs_retrieval"),
        "weak_retrieval_rate": rate("retrieval_quality_status IN ('weak', 'empty')"), "suspicious_context_rate": rate("suspicious_chunks > 0"), "answer_support_rate": rate("answer_supported"),
        "abstention_rate": over("starts_with(grounding_status, 'abstained')", "true"), "abstention_success_rate": over("abstention_success", "expected_abstention"), "avg_grounding_score": mean("grounding_score", "scored_qa", qa),
        "avg_sparse_queries": mean("sparse_queries"), "avg_duplicate_context_rate": mean("duplicate_context_rate"), "corrective_retry_rate": over("corrective_retry_attempted", "true"),
        "corrective_retry_accept_rate": over("corrective_retry_accepted", "corrective_retry_attempted"), "avg_context_compression_ratio": mean("context_compression_ratio"), "avg_selected_evidence_sentences": mean("selected_evidence_sentences"),
        "avg_input_tokens": "0.0::DOUBLE", "avg_output_tokens": "0.0::DOUBLE", "avg_total_tokens": "0.0::DOUBLE", "avg_reciprocal_rank": mean("reciprocal_rank", "scored_qa", qa), "num_examples": "count(*)", "num_qa_examples": qa,
        "num_expected_abstentions": "count(*) FILTER (expected_abstention)", "num_retrieval_evaluable": "count(*) FILTER (scored_qa AND retrieval_evaluable)", "benchmark_type": "'paired_closed_corpus'",
    }
    return ", ".join(f"{cols[c]} AS {c}" for c in evaluation.SUMMARY)


@query(f"SELECT {_summary_sql()} FROM ({_rows_sql('baseline', _BASELINE_RECORDS)})")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """All measures of the baseline."""
    return evaluation.summary(_rows(spark, d, "baseline"))


def _cell(heading: str, name: str, form: str) -> str:
    if form == "%s":
        return f'{name}::VARCHAR AS "{heading}"'
    return f'printf(\'{form}\', {name}::{"BIGINT" if form == "%d" else "DOUBLE"}) AS "{heading}"'


@query(f"SELECT {', '.join(_cell(*c) for c in sinks.COMPARISON)} FROM (SELECT model, {_summary_sql()} FROM ({_BOTH}) GROUP BY model)")
def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """The comparison table of both pipelines, written as CSV and read back."""
    both = _rows(spark, d, "baseline").unionByName(_rows(spark, d, "adaptive"))
    table_ = sinks.comparison(evaluation.summary(both, ["model"]))
    path = f"{records.shared_dir(spark)}/stage/comparison"
    return spark.read.option("header", True).option("escape", '"').csv(sinks.write_csv(table_, path), schema=table_.schema)


@query(f"SELECT model, index, {records._SAFE('prediction')} AS prediction, evaluation_category, total_operations::VARCHAR AS operations FROM ({_rows_sql('baseline', _BASELINE_RECORDS)})")
def per_question_export(spark: SparkSession, d: str) -> DataFrame:
    """The export by question, written with its fixed columns and read back; some of them."""
    rows = sinks.per_question(_rows(spark, d, "baseline"))
    path = f"{records.shared_dir(spark)}/stage/per-question"
    kinds = ", ".join(f"`{c}` {'long' if c == 'index' else 'string'}" for c in rows.columns)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").csv(sinks.write_csv(rows, path), schema=kinds)
    return back.select("model", "index", F.coalesce("prediction", F.lit("")).alias("prediction"), "evaluation_category", F.col("total_operations").alias("operations"))


@query("SELECT '0.0' AS em, '0.0' AS f1, 0::BIGINT AS num_examples, 31 AS measures")
def empty_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary of no rows: every measure is there, and 0."""
    none = _rows(spark, d, "baseline").where("false")
    out = evaluation.summary(none)
    return out.select(F.col("em").cast("string").alias("em"), F.col("f1").cast("string").alias("f1"), "num_examples", F.lit(len(out.columns)).alias("measures"))


@query(f"SELECT (SELECT count(*) FROM ({_rows_sql('baseline', _BASELINE_RECORDS)})) AS rows, num_examples, em FROM ({SQL['evaluation_summary']})")
def details_export(spark: SparkSession, d: str) -> DataFrame:
    """Summary and rows written as JSON, twice, and the last of them read back."""
    rows = _rows(spark, d, "baseline")
    path = f"{records.shared_dir(spark)}/stage/details"
    sinks.write_details(evaluation.summary(rows.limit(1)), rows.limit(1), path)
    sinks.write_details(evaluation.summary(rows), rows, path)
    at = sinks.current(spark, path)
    count = spark.read.schema("index long").json(f"{at}/rows").agg(F.count("*").alias("rows"))
    return count.crossJoin(spark.read.schema("num_examples long, em double").json(f"{at}/summary"))
