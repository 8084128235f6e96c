"""Policy, router and planner of questions, as columns of ``query``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V

NUMBER = rf"(?U){T.BEGINS}\d{{3,4}}{T.ENDS}"


def policy(query: Column) -> Column:
    """What a static corpus can't answer: blocked, reason, is_dynamic, is_high_stakes, is_source_bound, categories."""
    return T.let(T.squeeze(F.lower(F.coalesce(query, F.lit("")))), _policy)


def _policy(q: Column) -> Column:
    source = q.rlike(V.POLICY_SOURCE)
    temporal = T.has_word(q, V.POLICY_TEMPORAL) | (T.has_word(q, ["live"]) & T.has_word(q, V.POLICY_LIVE))
    market = T.has_word(q, V.MARKET_ASSETS) & T.has_word(q, V.MARKET_METRICS)
    civic = T.has_word(q, V.CIVIC_TERMS) & T.has_word(q, V.CIVIC_TIMES)
    medical = T.has_text(q, V.MEDICAL) & T.has_text(q, V.MEDICAL_ACTIONS + V.ADVICE)
    legal = T.has_text(q, V.LEGAL) & T.has_text(q, V.ADVICE)
    financial = T.has_text(q, V.FINANCIAL) & T.has_text(q, V.ADVICE)
    dynamic, stakes = temporal | market | civic, medical | legal | financial
    live = dynamic & ~source
    reason = F.when(live, "dynamic_or_current_information_requires_live_authoritative_evidence").when(stakes, "personalized_high_stakes_advice_is_out_of_scope").otherwise("allowed")
    named = [("medical_advice", medical), ("legal_advice", legal), ("financial_advice", financial), ("dynamic_market", market), ("dynamic_civic", civic), ("dynamic_temporal", temporal)]
    kinds = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named]), lambda x: x.isNotNull())
    return F.struct((live | stakes).alias("blocked"), reason.alias("reason"), dynamic.alias("is_dynamic"), stakes.alias("is_high_stakes"), source.alias("is_source_bound"), kinds.alias("categories"))


def route_confidence(query: Column) -> Column:
    """(confidence, reason) that a question needs retrieval, by its words."""
    q = F.lower(T.strip(F.coalesce(query, F.lit(""))))

    def begins(words: list[str]) -> Column:
        return q.rlike("^(?:" + "|".join(words) + ")")

    soft = (
        F.lit(0.48) + F.when(q.rlike(NUMBER), 0.12).otherwise(0.0) + F.when(F.length(q) > 100, 0.08).otherwise(0.0)
        + F.when(T.has_text(q, V.COMPARE_WORDS), 0.08).otherwise(0.0) + F.when(begins(V.CAUSE_STARTS), 0.10).otherwise(0.0)
        - F.when(begins(V.EDIT_STARTS), 0.20).otherwise(0.0)
    )
    soft = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), soft)), 6)
    score = (
        F.when(q == "", 0.0).when(T.has_text(q, V.ROUTER_SOURCE), 0.95).when(T.has_text(q, V.ROUTER_CURRENT + V.ROUTER_RISKY), 0.92)
        .when(T.has_word(q, V.FORCE_WORDS), 0.82).when(T.has_word(q, V.SKIP_WORDS), 0.25).otherwise(soft)
    )
    why = (
        F.when(q == "", V.ROUTE_REASONS["empty"]).when(T.has_text(q, V.ROUTER_SOURCE), V.ROUTE_REASONS["source"]).when(T.has_text(q, V.ROUTER_CURRENT + V.ROUTER_RISKY), V.ROUTE_REASONS["risky"])
        .when(T.has_word(q, V.FORCE_WORDS), V.ROUTE_REASONS["factual"]).when(T.has_word(q, V.SKIP_WORDS), V.ROUTE_REASONS["writing"])
        .otherwise(F.format_string(V.ROUTE_REASONS["words"], soft))
    )
    return F.struct(score.alias("confidence"), why.alias("reason"))


def route(query: Column, reply: Column | None = None, offline: bool = True, fallback: bool = True) -> Column:
    """(needs_retrieval, confidence, source, reasoning). Clear cases are settled by words; others go to retrieval when offline,
    else by a model's parsed ``reply`` (from ``parse_reply``), else to retrieval at 0.5 or by the threshold."""
    return T.let(route_confidence(query), lambda c: _route(c["confidence"], c["reason"], reply, offline, fallback))


def _route(score: Column, why: Column, reply: Column | None, offline: bool, fallback: bool) -> Column:
    def said(needs: Column, sure: Column, source: str, reason: Column) -> Column:
        return F.struct(needs.alias("needs_retrieval"), sure.cast("double").alias("confidence"), F.lit(source).alias("source"), reason.alias("reasoning"))

    clear = (score <= V.SKIP_AT) | (score >= V.RETRIEVE_AT)
    if offline:
        rest = said(F.lit(True), score, "heuristic_offline", F.lit(V.ROUTE_REASONS["offline"]))
    elif fallback:
        rest = said(score >= V.DECIDE_AT, score, "heuristic", why)
    else:
        rest = said(F.lit(True), F.lit(0.5), "fallback", F.lit(V.ROUTE_REASONS["fallback"]))
    decided = F.when(clear, said(score >= V.RETRIEVE_AT, score, "heuristic", why))
    if reply is not None and not offline:
        decided = decided.when(reply["decision"].isNotNull(), said(reply["decision"], reply["confidence"], "llm", reply["reasoning"]))
    return decided.otherwise(rest)


def parse_reply(reply: Column) -> Column:
    """(decision, confidence, reasoning) of a reply by lines; a DECISION other than YES or NO, or none, is null."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"\R"), T.strip)

    def values(name: str) -> Column:
        kept = F.filter(lines, lambda x: F.upper(x).startswith(name + ":"))
        return F.transform(kept, lambda x: T.strip(F.substring(x, F.lit(len(name) + 2), F.length(x))))

    said = F.transform(values("DECISION"), F.upper)
    good = (F.size(said) > 0) & F.forall(said, lambda x: x.isin("YES", "NO"))
    numbers = F.filter(F.transform(values("CONFIDENCE"), lambda x: F.regexp_extract(x, r"\d+", 0)), lambda x: x != "")
    sure = F.when(F.size(numbers) > 0, F.least(F.lit(1.0), F.element_at(numbers, -1).cast("double") / 100)).otherwise(0.5)
    reasons = values("REASONING")
    why = F.when(F.size(reasons) > 0, F.element_at(reasons, -1)).otherwise(V.ROUTE_REASONS["parsed"])
    none = F.lit(None)
    return F.struct(F.when(good, F.element_at(said, -1) == "YES").alias("decision"), F.when(good, sure).otherwise(none).alias("confidence"), F.when(good, why).otherwise(none).alias("reasoning"))


def _relations(toks: Column) -> Column:
    return F.filter(toks, lambda t: F.array_contains(T.lit_list(V.MULTI_HOP), t))


def variants(query: Column, most: Column | int) -> Column:
    """The question, its first 12 keywords, its entities, and these with relation words: different ones, in order."""
    q = T.strip(query)
    toks, names = T.tokens(q), T.entity_spans(q)
    related = _relations(toks)
    keywords = F.array_join(F.slice(toks, 1, 12), " ")
    linked = F.when((F.size(names) > 0) & (F.size(related) > 0), F.array_join(F.concat(names, F.slice(related, 1, 4)), " "))
    found = F.array(q, keywords, F.array_join(names, " "), F.coalesce(linked, F.lit("")))
    return F.slice(F.array_distinct(F.filter(found, lambda v: v != "")), F.lit(1), F.lit(most) if isinstance(most, int) else most)


def plan(query: Column) -> Column:
    """(complexity, k, is_multi_hop, is_global, is_source_bound, is_temporal, rationale, n_variants)"""
    q = T.strip(F.coalesce(query, F.lit("")))
    low = F.lower(q)
    toks = T.tokens(q)
    whole = T.has_text(low, V.GLOBAL_MARKERS)
    bound = T.has_text(low, V.SOURCE_MARKERS)
    temporal = T.has_text(low, V.TEMPORAL_MARKERS)
    hop = (F.size(_relations(toks)) > 0) | (F.length(q) - F.length(F.replace(q, F.lit("?"))) > 1)
    points = whole.cast("int") * 2 + hop.cast("int") * 2 + bound.cast("int") + temporal.cast("int") + q.rlike(NUMBER).cast("int") + (F.size(toks) > 18).cast("int")
    level = F.when(points >= 4, "high").when(points >= 2, "medium").otherwise("low")
    k = F.when(points >= 4, 6).when(points >= 2, 5).otherwise(V.TOP_K)
    bits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in (("global/corpus-level", whole), ("multi-hop", hop), ("source-bound", bound), ("temporal/dynamic", temporal))]), lambda x: x.isNotNull())
    why = F.when(F.size(bits) > 0, F.array_join(bits, ", ")).otherwise("simple factual")
    return F.struct(level.alias("complexity"), k.alias("k"), hop.alias("is_multi_hop"), whole.alias("is_global"), bound.alias("is_source_bound"), temporal.alias("is_temporal"), why.alias("rationale"), F.when(points >= 2, 4).otherwise(3).alias("n_variants"))


def planned(queries: DataFrame) -> DataFrame:
    """``queries`` (query_id, query) with policy, route, plan and variants; each different question is worked out once
    and joined back, as a cache of decisions would."""
    once = queries.select("query").distinct()
    once = once.withColumn("policy", policy(F.col("query"))).withColumn("route", route(F.col("query"))).withColumn("plan", plan(F.col("query")))
    once = once.withColumn("variants", variants(F.col("query"), F.col("plan.n_variants")))
    return queries.join(once, "query")
