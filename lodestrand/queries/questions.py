"""Queries over questions: validity, policy, routing, planning, replies, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import grounding
from lodestrand.plans import routing
from lodestrand.queries import samples
from lodestrand.queries import sqlparts as P
from lodestrand.queries.records import sample
from lodestrand.queries.registry import query
from lodestrand.session import table
from lodestrand.sources import documents as D

_ALL = f"(SELECT 's' || id AS key, query FROM {P.values(samples.POLICY)} s(id, query) UNION ALL SELECT 'q' || query_id, query FROM asked)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    return D.questions(table(spark, d, "questions"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, context, place, answer) of every answer of every question."""
    rows = asked(spark, d).select("query_id", "context", F.posexplode("answers").alias("i", "answer"))
    return rows.select("query_id", "context", (F.col("i") + 1).alias("place"), "answer")


def everything(spark: SparkSession, d: str) -> DataFrame:
    own = sample(spark, samples.POLICY, "id int, query string").select(F.concat(F.lit("s"), "id").alias("key"), "query")
    return own.unionByName(asked(spark, d).select(F.concat(F.lit("q"), "query_id").alias("key"), "query"))


@query(f"WITH {P.QUESTIONS} SELECT key, CASE WHEN {P.strip('query')} = '' THEN 'empty' WHEN length({P.strip('query')}) > 80 THEN 'too_long' ELSE 'ok' END AS status FROM {_ALL} t")
def validate_query(spark: SparkSession, d: str) -> DataFrame:
    return everything(spark, d).select("key", D.validated(F.col("query"), 80).alias("status"))


_Q = P.squeeze("lower(query)")


def _policy_sql() -> str:
    temporal = f"({P.has_word('q', V.POLICY_TEMPORAL)} OR ({P.has_word('q', ['live'])} AND {P.has_word('q', V.POLICY_LIVE)}))"
    market = f"({P.has_word('q', V.MARKET_ASSETS)} AND {P.has_word('q', V.MARKET_METRICS)})"
    civic = f"({P.has_word('q', V.CIVIC_TERMS)} AND {P.has_word('q', V.CIVIC_TIMES)})"
    medical = f"({P.has_text('q', V.MEDICAL)} AND {P.has_text('q', V.MEDICAL_ACTIONS + V.ADVICE)})"
    legal, financial = (f"({P.has_text('q', x)} AND {P.has_text('q', V.ADVICE)})" for x in (V.LEGAL, V.FINANCIAL))
    return f"""WITH {P.QUESTIONS}, c AS (SELECT key, regexp_matches(q, {P.quoted(V.POLICY_SOURCE)}) AS bound, {temporal} AS t, {market} AS m, {civic} AS v, {medical} AS md, {legal} AS l, {financial} AS f FROM (SELECT key, {_Q} AS q FROM {_ALL} a))
    SELECT key, ((t OR m OR v) AND NOT bound) OR md OR l OR f AS blocked, (t OR m OR v) AS is_dynamic, (md OR l OR f) AS is_high_stakes, bound AS is_source_bound,
      CASE WHEN (t OR m OR v) AND NOT bound THEN 'dynamic_or_current_information_requires_live_authoritative_evidence' WHEN md OR l OR f THEN 'personalized_high_stakes_advice_is_out_of_scope' ELSE 'allowed' END AS reason,
      array_to_string(list_filter([CASE WHEN md THEN 'medical_advice' END, CASE WHEN l THEN 'legal_advice' END, CASE WHEN f THEN 'financial_advice' END, CASE WHEN m THEN 'dynamic_market' END, CASE WHEN v THEN 'dynamic_civic' END, CASE WHEN t THEN 'dynamic_temporal' END], lambda x: x IS NOT NULL), ',') AS categories FROM c"""


@query(_policy_sql())
def static_policy(spark: SparkSession, d: str) -> DataFrame:
    p = everything(spark, d).select("key", routing.policy(F.col("query")).alias("p"))
    return p.select("key", "p.blocked", "p.is_dynamic", "p.is_high_stakes", "p.is_source_bound", "p.reason", F.array_join("p.categories", ",").alias("categories"))


R = {k: P.quoted(v) for k, v in V.ROUTE_REASONS.items()}


def _route_sql() -> str:
    begins = lambda ws: f"regexp_matches(q, {P.quoted('^(?:' + '|'.join(ws) + ')')})"
    soft = (
        f"round(greatest(0.05, least(0.95, 0.48 + CASE WHEN {P.has_number('q', 3)} THEN 0.12 ELSE 0 END + CASE WHEN length(q) > 100 THEN 0.08 ELSE 0 END "
        f"+ CASE WHEN {P.has_text('q', V.COMPARE_WORDS)} THEN 0.08 ELSE 0 END + CASE WHEN {begins(V.CAUSE_STARTS)} THEN 0.10 ELSE 0 END - CASE WHEN {begins(V.EDIT_STARTS)} THEN 0.20 ELSE 0 END)), 6)"
    )
    why = (
        f"CASE WHEN q = '' THEN {R['empty']} WHEN {P.has_text('q', V.ROUTER_SOURCE)} THEN {R['source']} WHEN {P.has_text('q', V.ROUTER_CURRENT + V.ROUTER_RISKY)} THEN {R['risky']} "
        f"WHEN {P.has_word('q', V.FORCE_WORDS)} THEN {R['factual']} WHEN {P.has_word('q', V.SKIP_WORDS)} THEN {R['writing']} ELSE printf({R['words']}, {soft}::DOUBLE) END"
    )
    return (
        f"SELECT key, {why} AS reason, (CASE WHEN q = '' THEN 0.0 WHEN {P.has_text('q', V.ROUTER_SOURCE)} THEN 0.95 WHEN {P.has_text('q', V.ROUTER_CURRENT + V.ROUTER_RISKY)} THEN 0.92 "
        f"WHEN {P.has_word('q', V.FORCE_WORDS)} THEN 0.82 WHEN {P.has_word('q', V.SKIP_WORDS)} THEN 0.25 ELSE {soft} END)::DOUBLE AS confidence FROM (SELECT key, lower({P.strip('query')}) AS q FROM {_ALL} a)"
    )


@query(f"WITH {P.QUESTIONS} SELECT key, confidence FROM ({_route_sql()})")
def heuristic_router(spark: SparkSession, d: str) -> DataFrame:
    return everything(spark, d).select("key", routing.route_confidence(F.col("query"))["confidence"].alias("confidence"))


@query(
    f"WITH {P.QUESTIONS}, r AS ({_route_sql()}) SELECT key, confidence > 0.35 AS needs_retrieval, confidence, CASE WHEN confidence <= 0.35 OR confidence >= 0.70 THEN 'heuristic' ELSE 'heuristic_offline' END AS source, "
    f"CASE WHEN confidence <= 0.35 OR confidence >= 0.70 THEN reason ELSE {R['offline']} END AS reasoning, CASE WHEN confidence <= 0.35 OR confidence >= 0.70 THEN confidence >= 0.70 ELSE confidence >= 0.55 END AS online FROM r"
)
def routing_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = everything(spark, d).select("key", routing.route(F.col("query")).alias("r"), routing.route(F.col("query"), offline=False).alias("o"))
    return rows.select("key", "r.needs_retrieval", "r.confidence", "r.source", "r.reasoning", F.col("o.needs_retrieval").alias("online"))


@query(f"WITH {P.QUESTIONS} SELECT count(*) AS asked, count(DISTINCT query) AS worked_out FROM {_ALL} t")
def decision_cache_distinct(spark: SparkSession, d: str) -> DataFrame:
    return everything(spark, d).agg(F.count("*").alias("asked"), F.countDistinct("query").alias("worked_out"))


_REPLY = "lower(l)"


@query(
    f"""WITH lines AS (SELECT id, i, {P.strip('l')} AS l FROM (SELECT id, unnest(regexp_split_to_array(reply, '\\r\\n|\\n')) AS l, generate_subscripts(regexp_split_to_array(reply, '\\r\\n|\\n'), 1) AS i FROM {P.values(samples.REPLIES)} s(id, reply))),
    d AS (SELECT id, list(upper({P.strip('substr(l, 10)')}) ORDER BY i) FILTER (starts_with(upper(l), 'DECISION:')) AS said, list(regexp_extract(l, '\\d+') ORDER BY i) FILTER (starts_with(upper(l), 'CONFIDENCE:') AND regexp_matches(l, '\\d')) AS sure,
      list({P.strip('substr(l, 11)')} ORDER BY i) FILTER (starts_with(upper(l), 'REASONING:')) AS why FROM lines GROUP BY id)
    SELECT id, CASE WHEN ok THEN said[-1] = 'YES' END AS decision, CASE WHEN ok THEN CASE WHEN len(sure) > 0 THEN least(1.0, sure[-1]::DOUBLE / 100) ELSE 0.5 END END::DOUBLE AS confidence, CASE WHEN ok THEN coalesce(why[-1], 'LLM decision parsed') END AS reasoning
    FROM (SELECT *, coalesce(len(said) > 0 AND len(list_filter(said, lambda x: x NOT IN ('YES', 'NO'))) = 0, false) AS ok FROM d)"""
)
def parse_router_reply(spark: SparkSession, d: str) -> DataFrame:
    r = sample(spark, samples.REPLIES, "id int, reply string").select("id", routing.parse_reply(F.col("reply")).alias("r"))
    return r.select("id", "r.decision", "r.confidence", "r.reasoning")


_TOKS = P.tokens("q")
_CAP = "[A-Z][a-zA-Z0-9]+"
_GAP = f"\\x01\\x01{P.WS}+\\x01\\x01"
_SPANS = P.found("q", f"\\x01({_CAP}(?:{_GAP}{_CAP}){{0,4}}|\\p{{Nd}}{{3,4}})\\x01")
_NAMES = f"list_filter({_SPANS}, lambda s: lower(s) NOT IN ('what','when','where','which','who','why','how'))"
_ENT = "list_filter(n, lambda a, i: list_position(n, a) = i)[1:5]"
_PLAN = f"""planned AS (SELECT *, 2 * g::INT + 2 * h::INT + b::INT + t::INT + {P.has_number('q', 3)}::INT + (len(toks) > 18)::INT AS points FROM (
  SELECT key, q, {_TOKS} AS toks, {_NAMES} AS n, {P.has_text('lower(q)', V.GLOBAL_MARKERS)} AS g, {P.has_text('lower(q)', V.SOURCE_MARKERS)} AS b, {P.has_text('lower(q)', V.TEMPORAL_MARKERS)} AS t,
    len(list_filter({_TOKS}, lambda x: list_contains({P.listed(V.MULTI_HOP)}, x))) > 0 OR length(q) - length(replace(q, '?', '')) > 1 AS h FROM (SELECT key, {P.strip('query')} AS q FROM {_ALL} a)))"""


@query(
    f"WITH {P.QUESTIONS}, {_PLAN} SELECT key, CASE WHEN points >= 4 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS complexity, (CASE WHEN points >= 4 THEN 6 WHEN points >= 2 THEN 5 ELSE 4 END)::INT AS k, h AS is_multi_hop, g AS is_global, b AS is_source_bound, t AS is_temporal, "
    "CASE WHEN g OR h OR b OR t THEN array_to_string(list_filter([CASE WHEN g THEN 'global/corpus-level' END, CASE WHEN h THEN 'multi-hop' END, CASE WHEN b THEN 'source-bound' END, CASE WHEN t THEN 'temporal/dynamic' END], lambda x: x IS NOT NULL), ', ') ELSE 'simple factual' END AS rationale FROM planned"
)
def query_plan(spark: SparkSession, d: str) -> DataFrame:
    p = everything(spark, d).select("key", routing.plan(F.col("query")).alias("p"))
    return p.select("key", "p.complexity", "p.k", "p.is_multi_hop", "p.is_global", "p.is_source_bound", "p.is_temporal", "p.rationale")


@query(f"WITH {P.QUESTIONS}, {_PLAN} SELECT key, to_json({_ENT})::VARCHAR AS entities FROM planned")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    return everything(spark, d).select("key", F.to_json(T.entity_spans(T.strip(F.col("query")))).alias("entities"))


_REL = f"list_filter(toks, lambda x: list_contains({P.listed(V.MULTI_HOP)}, x))"
_VARS = (
    f"list_filter([q, array_to_string(toks[1:12], ' '), array_to_string({_ENT}, ' '), CASE WHEN len({_ENT}) > 0 AND len({_REL}) > 0 THEN array_to_string(list_concat({_ENT}, {_REL}[1:4]), ' ') ELSE '' END], lambda v: v <> '')"
)


@query(f"WITH {P.QUESTIONS}, {_PLAN}, v AS (SELECT key, points, {_VARS} AS vs FROM planned) SELECT key, to_json(list_filter(vs, lambda a, i: list_position(vs, a) = i)[1:CASE WHEN points >= 2 THEN 4 ELSE 3 END])::VARCHAR AS variants FROM v")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return everything(spark, d).select("key", F.to_json(routing.variants(F.col("query"), routing.plan(F.col("query"))["n_variants"])).alias("variants"))


_FORM = lambda x: f"regexp_replace(regexp_replace(lower({P.strip(x)}), '{P.WS}+', ' ', 'g'), '\\.+$', '')"


@query(
    f"SELECT id, {_FORM('text')} = {P.quoted(V.EVIDENCE_ABSTENTION.lower().rstrip('.'))} AS evidence, {_FORM('text')} IN ({P.quoted(V.EVIDENCE_ABSTENTION.lower().rstrip('.'))}, {P.quoted(V.STATIC_ABSTENTION.lower().rstrip('.'))}) AS abstains "
    f"FROM {P.values(samples.ABSTENTIONS)} s(id, text)"
)
def abstention_flags(spark: SparkSession, d: str) -> DataFrame:
    return sample(spark, samples.ABSTENTIONS, "id int, text string").select("id", T.is_evidence_abstention(F.col("text")).alias("evidence"), T.is_abstention(F.col("text")).alias("abstains"))


@query(
    f"WITH {P.QUESTIONS} SELECT query_id, place, {_FORM('text')} = {P.quoted(V.EVIDENCE_ABSTENTION.lower().rstrip('.'))} AS evidence, {_FORM('text')} IN ({P.quoted(V.EVIDENCE_ABSTENTION.lower().rstrip('.'))}, {P.quoted(V.STATIC_ABSTENTION.lower().rstrip('.'))}) AS abstains "
    f"FROM (SELECT query_id, unnest(given) AS text, generate_subscripts(given, 1)::INT AS place FROM (SELECT query_id, {P.ANSWERS} AS given FROM asked))"
)
def answer_abstentions(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d)
    return rows.select("query_id", "place", T.is_evidence_abstention(F.col("answer")).alias("evidence"), T.is_abstention(F.col("answer")).alias("abstains"))


_WORD = "(?:[A-Z][a-zA-Z0-9]+|[A-Z]{2,})"
_NUMBERS = P.found("a", "\\x01(\\p{Nd}{1,4}(?:\\x01\\x01[.,:]\\x01\\x01\\p{Nd}+)?(?:\\x01\\x01%\\x01|\\x01))")
_CAPITALS = P.found("a", f"\\x01({_WORD}(?:{_GAP}{_WORD}){{0,4}})\\x01")


def markers_sql(stops: str = P.listed(V.STOP_WORDS)) -> str:
    filler = P.listed(V.MARKER_FILLER)
    names = f"list_filter(list_transform({_CAPITALS}, lambda s: array_to_string(list_filter(regexp_split_to_array(s, '{P.WS}+'), lambda w: NOT list_contains({filler}, w)), ' ')), lambda s: s <> '' AND NOT list_contains({stops}, lower(s)))"
    return f"list_sort(list_distinct(list_transform(list_concat({_NUMBERS}, {names}), lambda s: {{'n': length(s), 'l': lower(s), 's': s}})))"


_MARK = markers_sql()


@query(f"WITH {P.QUESTIONS} SELECT query_id, i AS place, array_to_string(list_transform({_MARK}, lambda x: x.s), '|') AS markers FROM (SELECT query_id, unnest(given) AS a, generate_subscripts(given, 1)::INT AS i FROM (SELECT query_id, {P.ANSWERS} AS given FROM asked))")
def fact_markers(spark: SparkSession, d: str) -> DataFrame:
    rows = asked(spark, d).select("query_id", F.posexplode("answers").alias("i", "a"))
    return rows.select("query_id", (F.col("i") + 1).alias("place"), F.array_join(T.fact_markers(F.col("a")), "|").alias("markers"))


def _grounded(spark: SparkSession) -> DataFrame:
    rows = sample(spark, samples.GROUNDING, "id int, answer string, context string")
    return rows.withColumn("report", grounding.support(F.col("answer"), F.array("context")))


def support_parts(source: str) -> str:
    """From ``source`` (id, answer, context): ``support`` (id, a, status, support_score, unsupported); a context that is
    null, blank or the placeholder is none."""
    return f"""g AS (SELECT id, a, c, q, d, {_MARK} AS mk FROM (SELECT *, {P.tokens('a')} AS q, {P.tokens('c')} AS d FROM (SELECT id, {P.strip('answer')} AS a, CASE WHEN context = {P.quoted(V.NO_CONTEXT)} THEN '' ELSE coalesce(context, '') END AS c FROM {source}))),
 gsent AS (SELECT id, q, {P.tokens('s')} AS st, least(1.0, 0.25 * len({P.matched('s')})) AS risk FROM (SELECT id, q, unnest(regexp_split_to_array(regexp_replace(c, '([.!?]){P.WS}+', '\\1' || chr(10), 'g'), '\\n+')) AS s FROM g)),
 gbest AS (SELECT id, max({P.relevance('q', 'st', 'risk')}) AS b FROM gsent GROUP BY id),
 gs AS (SELECT g.*, {_FORM('a')} = {P.quoted(V.EVIDENCE_ABSTENTION.lower().rstrip('.'))} AS abst, {P.strip('c')} <> '' AS has, {P.overlap('q', 'd')}::DOUBLE / greatest(1, len(q)) AS recall,
   CASE WHEN contains(array_to_string(d, ' '), array_to_string(q, ' ')) THEN 1.0 ELSE coalesce(b, 0) END::DOUBLE AS top, list_filter(mk, lambda x: NOT contains(lower(c), x.l)) AS bad FROM g LEFT JOIN gbest USING (id)),
 support AS (SELECT id, a, CASE WHEN abst THEN 'abstained' WHEN len(q) = 0 THEN 'empty_answer' WHEN NOT has THEN 'no_context' WHEN top >= 0.35 AND recall >= 0.6 AND len(bad) = 0 THEN 'supported' ELSE 'weak_or_unsupported' END AS status,
   CASE WHEN abst THEN 1.0 WHEN len(q) = 0 OR NOT has THEN 0.0 ELSE round(greatest(recall, top), 4) END::DOUBLE AS support_score, CASE WHEN abst OR len(q) = 0 OR NOT has THEN NULL ELSE round(recall, 4) END::DOUBLE AS token_recall,
   CASE WHEN abst OR len(q) = 0 OR NOT has THEN '' ELSE array_to_string(list_transform(bad, lambda x: x.s), '|') END AS unsupported, NOT abst AND len(q) > 0 AND has AND top >= 0.35 AS supporting FROM gs)"""


def held_sql(quality: str) -> str:
    """Whether an answer of ``support`` is withheld."""
    return f"(coalesce({quality} IN ('weak', 'empty', 'suspicious_context_blocked'), false) OR status NOT IN ('abstained', 'supported') OR ({P.has_text(_FORM('a'), V.ABSTENTION_MARKERS)} AND status <> 'abstained'))"


_SAMPLED = f"WITH {support_parts(P.values(samples.GROUNDING) + ' s(id, answer, context)')}"
_ANSWERED = (
    f"WITH {P.QUESTIONS}, given_ AS (SELECT query_id, context, {P.ANSWERS} AS al FROM asked), every AS (SELECT query_id, context, unnest(al) AS answer, generate_subscripts(al, 1)::INT AS place FROM given_), "
    f"numbered AS (SELECT *, query_id::VARCHAR || '/' || place AS id FROM every), {support_parts('numbered')}"
)


@query(f"{_SAMPLED} SELECT id, status, status IN ('abstained', 'supported') AS is_supported, support_score, token_recall, unsupported, CASE WHEN supporting THEN '1' ELSE '' END AS supporting FROM support")
def answer_support(spark: SparkSession, d: str) -> DataFrame:
    return _told(_grounded(spark), "id")


def _told(rows: DataFrame, *keys: str) -> DataFrame:
    r = F.col("report")
    lists = F.array_join(r["unsupported"], "|").alias("unsupported"), F.array_join(r["supporting"].cast("array<string>"), ",").alias("supporting")
    return rows.select(*keys, "report.status", "report.is_supported", "report.support_score", "report.token_recall", *lists)


_HELD = f"CASE WHEN held THEN {P.quoted(V.EVIDENCE_ABSTENTION)} ELSE a END AS answer, CASE WHEN held THEN 'abstained_unsupported_evidence' ELSE status END AS status"


@query(f"{_SAMPLED} SELECT id, {_HELD} FROM (SELECT *, {held_sql(P.quoted('good'))} AS held FROM support)")
def enforce_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _enforced(_grounded(spark), F.lit("good"), "id")


def _enforced(rows: DataFrame, quality: Column, *keys: str) -> DataFrame:
    out = grounding.enforced(F.col("answer"), F.col("context"), quality, F.col("report"))
    return rows.select(*keys, out.alias("o")).select(*keys, "o.answer", "o.status")


def _all_grounded(spark: SparkSession, d: str) -> DataFrame:
    """Every answer with its report; an answer is worked out once for each different context it has."""
    return answers(spark, d).withColumn("report", grounding.support(F.col("answer"), F.array("context")))


@query(f"{_ANSWERED} SELECT query_id, place, status, status IN ('abstained', 'supported') AS is_supported, support_score, token_recall, unsupported, CASE WHEN supporting THEN '1' ELSE '' END AS supporting FROM support JOIN numbered USING (id)")
def question_support(spark: SparkSession, d: str) -> DataFrame:
    """``answer_support`` of every answer of every question against the question's context."""
    return _told(_all_grounded(spark, d), "query_id", "place")


_PLACED = "JOIN (SELECT query_id, place, id FROM numbered) USING (id)"


@query(f"{_ANSWERED} SELECT query_id, place, {_HELD} FROM (SELECT *, {held_sql(P.quoted('good'))} AS held FROM support) {_PLACED}")
def question_grounding(spark: SparkSession, d: str) -> DataFrame:
    """``enforce_grounding`` of every answer of every question against the question's context."""
    return _enforced(_all_grounded(spark, d), F.lit("good"), "query_id", "place")


@query(f"{_ANSWERED} SELECT query_id, place, quality, {_HELD} FROM (SELECT *, {held_sql('quality')} AS held FROM support, (VALUES ('good'), ('weak'), ('empty'), ('suspicious_context_blocked'), ('suspicious_context_quarantined'), (NULL)) w(quality)) {_PLACED}")
def grounding_by_quality(spark: SparkSession, d: str) -> DataFrame:
    """The same after a retrieval of every quality."""
    kinds = [F.lit(x).cast("string") for x in ("good", "weak", "empty", "suspicious_context_blocked", "suspicious_context_quarantined", None)]
    rows = _all_grounded(spark, d).withColumn("quality", F.explode(F.array(*kinds)))
    return _enforced(rows, F.col("quality"), "query_id", "place", "quality")


@query(
    f"WITH {P.QUESTIONS} SELECT key, replace(replace({P.quoted(V.QA_PROMPT)}, '{{context}}', 'A {{query}} of canals.'), 'Question: {{query}}', 'Question: ' || query) AS qa, replace({P.quoted(V.NAIVE_PROMPT)}, '{{query}}', query) AS naive, replace({P.quoted(V.DECISION_PROMPT)}, '{{query}}', query) AS decision FROM {_ALL} t"
)
def render_prompts(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    qa = grounding.prompt(V.QA_PROMPT, q, F.lit("A {query} of canals."))
    return everything(spark, d).select("key", qa.alias("qa"), grounding.prompt(V.NAIVE_PROMPT, q).alias("naive"), grounding.prompt(V.DECISION_PROMPT, q).alias("decision"))


_COUNT = lambda *ks: "coalesce(" + ", ".join(f"CASE WHEN {k} >= 0 THEN {k} END" for k in ks) + ", 0)::BIGINT"


@query(
    "WITH u AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 97 END AS input_tokens, CASE WHEN event_id % 3 = 1 THEN event_id % 89 - 5 END AS prompt_tokens, event_id % 13 - 3 AS completion_tokens, CASE WHEN event_id % 4 = 0 THEN event_id % 200 END AS total_tokens FROM events), "
    f"c AS (SELECT event_id, {_COUNT('input_tokens', 'prompt_tokens')} AS i, {_COUNT('completion_tokens')} AS o, {_COUNT('total_tokens')} AS t FROM u) SELECT event_id, i AS input_tokens, o AS output_tokens, CASE WHEN t > 0 THEN t ELSE i + o END AS total_tokens FROM c"
)
def token_usage(spark: SparkSession, d: str) -> DataFrame:
    """Counts of tokens as different providers report them, made of the events' numbers: missing and negative ones too."""
    n = F.col("event_id")
    told = {
        "input_tokens": F.when(n % 3 == 0, n % 97), "prompt_tokens": F.when(n % 3 == 1, n % 89 - 5), "completion_tokens": n % 13 - 3, "total_tokens": F.when(n % 4 == 0, n % 200),
    }
    usage = F.map_filter(F.create_map(*[x for k, v in told.items() for x in (F.lit(k), v.cast("double"))]), lambda k, v: v.isNotNull())
    return table(spark, d, "events").select("event_id", grounding.token_usage(usage).alias("u")).select("event_id", "u.*")
