"""Offline extractive answers and the check of answers against their context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab


def extractive_answer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., answer): the sentence of ``context`` with most of the query's runs of over two characters, the shorter
    and then the earlier of equals, cut at 300 characters; the abstention where there is no context."""
    long_runs = F.array_distinct(F.filter(T.runs(F.col("query")), lambda t: F.length(t) > 2))
    context = T.strip(F.coalesce("context", F.lit("")))
    parts = T.sentences(context)
    headed = F.filter(parts, lambda s: ~s.rlike(r"^\[(?:Evidence|doc=|source=)"))
    usable = F.when(F.size(headed) > 0, headed).otherwise(parts)
    def keyed(q: Column) -> Column:
        return F.transform(usable, lambda s, i: F.struct((-F.size(F.array_intersect(q, T.runs(s)))).alias("hits"), F.length(s).alias("n"), i.alias("i"), s.alias("s")))

    best = F.array_min(T.let(long_runs, keyed))["s"]
    none = (context == "") | context.contains(vocab.NO_CONTEXT)
    answer = F.when(none, F.lit(vocab.EVIDENCE_ABSTENTION)).otherwise(F.coalesce(F.substring(best, 1, 300), F.lit(vocab.EVIDENCE_ABSTENTION)))
    return rows.select(*keys, answer.alias("answer"))


def prompt(template: str, query: Column, context: Column | None = None) -> Column:
    """A template with the query, and the context where it has a place for one, put in; braces in these stay."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{(query|context)\}", template)):
        parts.append(F.lit(piece) if i % 2 == 0 else query if piece == "query" else context)
    return F.concat(*parts)


#: Names of one count in the replies of different providers, the first that is a number from 0 on holds.
TOKEN_KEYS = {"input_tokens": ["input_tokens", "prompt_tokens"], "output_tokens": ["output_tokens", "completion_tokens"], "total_tokens": ["total_tokens"]}


def token_usage(usage: Column) -> Column:
    """(input_tokens, output_tokens, total_tokens) of a map of reported counts; a total that is missing or 0 is the sum."""

    def first(keys: list[str]) -> Column:
        found = [F.when(F.try_element_at(usage, F.lit(k)) >= 0, F.try_element_at(usage, F.lit(k))) for k in keys]
        return F.coalesce(*found, F.lit(0.0)).cast("long")

    def counted(n: Column) -> Column:
        total = F.when(n["total"] > 0, n["total"]).otherwise(n["input"] + n["output"])
        return F.struct(n["input"].alias("input_tokens"), n["output"].alias("output_tokens"), total.alias("total_tokens"))

    return T.let(F.struct(first(TOKEN_KEYS["input_tokens"]).alias("input"), first(TOKEN_KEYS["output_tokens"]).alias("output"), first(TOKEN_KEYS["total_tokens"]).alias("total")), counted)


def support(answer: Column, contexts: Column, least_recall: float = 0.60) -> Column:
    """The report on an answer against an array of contexts: status, is_supported, support_score, token_recall,
    markers, unsupported and the numbers of the supporting contexts (five at most)."""
    given = T.strip(F.coalesce(answer, F.lit("")))
    return T.let(given, lambda a: T.let(T.tokens(a), lambda toks: _report(a, toks, contexts, least_recall)))


def _report(a: Column, toks: Column, contexts: Column, least_recall: float) -> Column:
    docs = F.filter(F.coalesce(contexts, F.array().cast("array<string>")), lambda c: c.isNotNull() & c.rlike(r"(?U)\S"))
    joined = F.array_join(docs, "\n")
    recall = T.overlap(toks, T.tokens(joined)) / F.greatest(F.size(toks), F.lit(1))
    markers = T.fact_markers(a)
    unsupported = F.filter(markers, lambda m: ~F.lower(joined).contains(F.lower(m)))

    def best_of(doc: Column) -> Column:
        whole = F.array_join(T.tokens(doc), " ").contains(F.array_join(toks, " "))
        scores = F.transform(T.sentences(doc), lambda s: T.relevance(toks, T.tokens(s), T.risk(s)))
        return F.when(whole, 1.0).otherwise(F.coalesce(F.array_max(scores), F.lit(0.0)))

    empty = F.array().cast("array<string>")

    def report(status: Column, ok: Column, points: Column, rec: Column, mark: Column, bad: Column, sup: Column) -> Column:
        return F.struct(status.alias("status"), ok.alias("is_supported"), F.round(points, 4).alias("support_score"), F.round(rec, 4).alias("token_recall"), mark.alias("markers"), bad.alias("unsupported"), sup.alias("supporting"))

    def plain(status: str, ok: bool, points: float) -> Column:
        return report(F.lit(status), F.lit(ok), F.lit(points), F.lit(None).cast("double"), empty, empty, F.array().cast("array<int>"))

    def checked(best: Column, rec: Column, bad: Column) -> Column:
        supporting = F.filter(F.transform(best, lambda b, i: F.when(b >= 0.35, i + 1)), lambda i: i.isNotNull())
        score = F.greatest(rec, F.coalesce(F.array_max(best), F.lit(0.0)))
        good = (F.size(supporting) > 0) & (rec >= least_recall) & (F.size(bad) == 0)
        return report(F.when(good, "supported").otherwise("weak_or_unsupported"), good, score, rec, markers, bad, F.slice(supporting, 1, 5))

    return (
        F.when(T.is_evidence_abstention(a), plain("abstained", True, 1.0))
        .when(F.size(toks) == 0, plain("empty_answer", False, 0.0))
        .when(F.size(docs) == 0, plain("no_context", False, 0.0))
        .otherwise(T.let(F.transform(docs, best_of), lambda best: T.let(recall, lambda r: T.let(unsupported, lambda bad: checked(best, r, bad)))))
    )


def enforced(answer: Column, context: Column, quality: Column, report: Column) -> Column:
    """(answer, status): the abstention in place of an answer that its context doesn't bear out, that is a malformed
    abstention, or whose retrieval was weak, empty or blocked."""
    weak = F.coalesce(quality.isin("weak", "empty", "suspicious_context_blocked"), F.lit(False))
    malformed = T.has_text(T.abstention_form(answer), vocab.ABSTENTION_MARKERS) & ~T.is_evidence_abstention(answer)
    withheld = weak | malformed | ~report["is_supported"]
    return F.struct(
        F.when(withheld, F.lit(vocab.EVIDENCE_ABSTENTION)).otherwise(answer).alias("answer"),
        F.when(withheld, F.lit("abstained_unsupported_evidence")).otherwise(report["status"]).alias("status"),
    )
