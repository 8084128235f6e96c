"""Whole answers for many questions at once: early chunks, and parents before children with a corrective retry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.operators import chunking, context, dense, fusion, grounding, retrieval
from lodestrand.plans import routing
from lodestrand.session import parts, stage

#: From rows (keys..., query, context, prompt) to (keys..., answer) and, where the provider reports counts, ``usage``,
#: a map<string,double>.
Generator = Callable[[DataFrame, list[str]], DataFrame]

#: A unit's number is its document's position and its place in it; a string has fewer chunks than PLACES.
PLACES = 1 << 24
DOCUMENTS = 1 << 39


def unit_number(pos: Column, place: Column) -> Column:
    ok = (pos >= 0) & (pos < DOCUMENTS) & (place < PLACES)
    return F.when(ok, pos * PLACES + place).otherwise(F.raise_error(F.lit("a document's position or number of chunks is out of range"))).cast("long")


def chunk_units(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of normalised documents (pos, doc_id, content, label, origin) as units to search. A unit's number is made
    of its document's position and its place, so it needs no global numbering."""
    shown = [c for c in ("label", "origin", "doc_id") if c in docs.columns]
    parts = chunking.chunks(docs, size, overlap, ["pos"]).withColumn("unit", unit_number(F.col("pos"), F.col("chunk_no")))
    return parts.join(docs.select("pos", *shown), "pos").select("unit", "pos", "chunk_no", "char_start", "char_end", F.col("chunk").alias("content"), *shown)


def _picked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("pick_no")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "unit", "content", "label", "origin", "doc_id", "relevance")


def baseline_search(queries: DataFrame, index: retrieval.Index, k: int = V.TOP_K) -> tuple[DataFrame, DataFrame]:
    """(documents, counts): 2k dense and 2k sparse chunks, fused to 2k, k diverse ones of them, suspicious ones left out
    without backfill; and how many those were (query_id, quarantined)."""
    one = queries.select("query_id", F.lit(0).alias("variant_no"), F.col("query").alias("variant"), F.lit(2 * k).alias("pool"))
    picked = stage(retrieval.picked(queries.select("query_id", "query", F.lit(k).alias("k")), one, index), "picked")
    return _picked(picked.where(~F.col("bad"))), picked.groupBy("query_id").agg(F.count_if("bad").alias("quarantined"))


def baseline_retrieve(queries: DataFrame, index: retrieval.Index, k: int = V.TOP_K) -> DataFrame:
    """(query_id, rank, unit, content, label, origin, doc_id, relevance) of ``baseline_search``."""
    return baseline_search(queries, index, k)[0]


def explode_variants(planned: DataFrame) -> DataFrame:
    return planned.select("query_id", F.posexplode("variants").alias("variant_no", "variant"))


def _budget(planned: DataFrame) -> DataFrame:
    return planned.select("query_id", "query", F.greatest(F.lit(V.TOP_K), F.col("plan.k")).alias("k"))


def parent_retrieve(planned: DataFrame, index: retrieval.Index) -> tuple[DataFrame, DataFrame]:
    """Parents of each question by all its variants, with backfill; and the counts of the search."""
    return retrieval.safe_with_backfill(_budget(planned), explode_variants(planned), index)


@dataclass
class Retrieved:
    """What the parent-child search gives for every question."""

    documents: DataFrame  #: (query_id, rank, unit, content, label, origin, doc_id, relevance)
    quality: DataFrame  #: as of ``retrieval.quality``, of the documents that were kept
    retry: DataFrame  #: (query_id, attempted, accepted, original_status, retry_status, original_relevance, retry_relevance)
    usage: DataFrame  #: (query_id, vector_queries, sparse_queries, backfill_searches) of all its searches
    parents: DataFrame
    parent_quality: DataFrame


def child_units(parents: DataFrame, size: int, overlap: int) -> DataFrame:
    """(query_id, unit, content, label, origin, doc_id): chunks of the parents that each query selected."""
    cut = chunking.chunks(parents, size, overlap, ["query_id", "unit"]).withColumnRenamed("unit", "parent")
    base = parents.select("query_id", F.col("unit").alias("parent"), "rank", "label", "origin", "doc_id")
    number = unit_number(F.col("rank").cast("long"), F.col("chunk_no"))
    return cut.join(base, ["query_id", "parent"]).select("query_id", number.alias("unit"), F.col("chunk").alias("content"), "label", "origin", "doc_id")


def parent_child_retrieve(planned: DataFrame, index: retrieval.Index, child: tuple[int, int] = V.CHILD_CHUNK) -> Retrieved:
    """Parents are searched first, the selected ones cut into child chunks, these searched by the question's own
    statistics, and a weak or empty result searched once more with more variants and twice the number, kept if it is no
    worse. Every search leaves out suspicious texts and fills up by a wider one."""
    variants, asked = explode_variants(planned), _budget(planned)
    parents, counts = parent_retrieve(planned, index)
    parents = stage(parents, "parents")
    parent_quality = retrieval.quality(asked, parents, counts)
    children = retrieval.OwnUnits.build(child_units(parents, *child), index.embed)
    searched = stage(asked.join(children.units.select("query_id").distinct(), "query_id", "left_semi"), "searched")
    found, child_counts = retrieval.safe_with_backfill(searched, variants.join(searched.select("query_id"), "query_id"), children)
    found = stage(found, "children-found")
    quality = stage(retrieval.quality(asked, found, child_counts), "quality")
    n_variants = planned.select("query_id", F.size("variants").alias("n_variants"))
    used = n_variants.join(counts.select("query_id", F.col("searches").alias("parent_searches")), "query_id", "left")
    used = used.join(child_counts.select("query_id", F.col("searches").alias("child_searches")), "query_id", "left")

    poor = quality.where(F.col("status").isin("weak", "empty")).select("query_id").join(searched, "query_id")
    poor = stage(poor, "poor")
    if poor.isEmpty():
        none = {"attempted": F.lit(False), "accepted": F.lit(False), "original_status": F.lit(None).cast("string"), "retry_status": F.lit(None).cast("string"), "original_relevance": F.lit(None).cast("double"), "retry_relevance": F.lit(None).cast("double")}
        retry = quality.select("query_id", *[c.alias(n) for n, c in none.items()])
        return Retrieved(found, quality, retry, _usage(used.withColumn("retry_searches", F.lit(0)).withColumn("more", F.lit(0))), parents, parent_quality)
    more = stage(explode_variants(poor.withColumn("variants", routing.variants(F.col("query"), V.RETRY_VARIANTS))), "retry-variants")
    wide = poor.select("query_id", "query", F.greatest(F.col("k") + 1, F.col("k") * 2).cast("int").alias("k"))
    pool, retry_counts = retrieval.safe_with_backfill(wide, more, children)
    pool = retrieval.with_relevance(pool.drop("relevance").join(poor, "query_id")).withColumns({c: F.lit(None).cast("string") for c in ("key", "bad")})
    second = fusion.diverse(pool.select("query_id", "k", "rank", "relevance", "toks", *retrieval.SHOWN), ["query_id"], F.col("k"))
    second = stage(_picked(second.drop("rank")), "retried")
    after = stage(retrieval.quality(poor, second, retry_counts), "retry-quality")

    new = after.select("query_id", F.col("status").alias("retry_status"), F.col("max_relevance").alias("retry_relevance"), (F.size("scores") > 0).alias("any"))
    judged = quality.select("query_id", F.col("status").alias("original_status"), F.col("max_relevance").alias("original_relevance"), (F.size("scores") == 0).alias("none")).join(new, "query_id", "left")
    accepted = F.coalesce(F.col("any") & (F.col("none") | (F.col("retry_relevance") >= F.col("original_relevance"))), F.lit(False))
    attempted = F.col("retry_status").isNotNull()
    told = [F.when(attempted, F.col(c)).alias(c) for c in ("original_status", "retry_status", "original_relevance", "retry_relevance")]
    retry = stage(judged.select("query_id", attempted.alias("attempted"), accepted.alias("accepted"), *told), "retry")
    yes = retry.where("accepted").select("query_id")
    documents = found.join(yes, "query_id", "left_anti").unionByName(second.join(yes, "query_id"))
    merged = quality.join(yes, "query_id", "left_anti").unionByName(after.join(yes, "query_id"))
    n_more = more.groupBy("query_id").agg(F.count("*").alias("more"))
    used = used.join(retry_counts.select("query_id", F.col("searches").alias("retry_searches")), "query_id", "left").join(n_more, "query_id", "left")
    return Retrieved(documents, merged, retry, _usage(used), parents, parent_quality)


def _usage(used: DataFrame) -> DataFrame:
    """Every search asks each of its variants once of the vectors and once of the postings."""
    times = [F.coalesce(c, F.lit(0)) for c in ("parent_searches", "child_searches", "retry_searches")]
    total = (F.col("n_variants") * (times[0] + times[1]) + F.coalesce("more", F.lit(0)) * times[2]).cast("long")
    extra = sum((F.greatest(c - 1, F.lit(0)) for c in times), F.lit(0)).cast("long")
    rows = used.select("query_id", total.alias("vector_queries"), total.alias("sparse_queries"), extra.alias("backfill_searches"), F.col("child_searches").isNotNull().alias("searched"))
    return stage(rows, "usage")


#: What an answer's record has, by column; those a question doesn't come to are 0, false, empty or null.
RECORD = {
    "query_id": "long", "query": "string", "answer": "string", "context": "string", "blocked": "boolean", "needs_retrieval": "boolean",
    "confidence": "double", "decision_source": "string", "reasoning": "string", "stage": "string", "strategy": "string", "quality": "string",
    "max_relevance": "double", "avg_relevance": "double", "suspicious": "long", "duplicate_rate": "double", "scores": "array<double>",
    "num_documents": "long", "complexity": "string", "context_chars": "long", "selected": "long", "ratio": "double",
    "grounding": "string", "is_supported": "boolean", "support_score": "double", "unsupported": "array<string>",
    "retry_attempted": "boolean", "retry_accepted": "boolean", "backfill_searches": "long", "vector_queries": "long", "sparse_queries": "long",
    "decision_llm_calls": "long", "generation_llm_calls": "long", "total_llm_calls": "long", "total_operations": "long",
    "input_tokens": "long", "output_tokens": "long", "total_tokens": "long",
}
_ZERO = {"long": 0, "double": 0.0, "boolean": False}
_OPEN = {"support_score", "is_supported", "confidence"}  # null says: not applicable


def records(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of RECORD, in its order and type."""
    cols = []
    for name, kind in RECORD.items():
        col = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        if kind in _ZERO and name not in _OPEN and name != "query_id":
            col = F.coalesce(col, F.lit(_ZERO[kind]).cast(kind))
        elif kind.startswith("array"):
            col = F.coalesce(col, F.array().cast(kind))
        cols.append(col.alias(name))
    return rows.select(*cols)


def generated(rows: DataFrame, generate: Generator) -> DataFrame:
    """``rows`` (query_id, ...) with ``answer`` and the tokens that the generator reports."""
    out = generate(rows, ["query_id"])
    if "usage" in out.columns:
        out = out.withColumn("usage", grounding.token_usage(F.col("usage"))).select("query_id", "answer", "usage.*")
    return rows.join(out, "query_id")


def answered(queries: DataFrame, documents: DataFrame, quality: DataFrame, generate: Generator = grounding.extractive_answer) -> DataFrame:
    """``queries`` (query_id, query) with the context of their documents, an answer from it, which is withheld where the
    context doesn't bear it out, and the columns of RECORD that tell of these."""
    ranked = documents.join(queries.select("query_id", "query"), "query_id")
    ctx = context.compressed_context(ranked, ["query_id"])
    rows = queries.select("query_id", "query").join(ctx, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(V.NO_CONTEXT)))
    rows = stage(rows.withColumn("prompt", grounding.prompt(V.QA_PROMPT, F.col("query"), F.col("context"))), "contexts")
    rows = rows.repartition(parts(rows.sparkSession), "query_id")
    rows = generated(rows, generate).join(quality.withColumnRenamed("status", "quality"), "query_id", "left")
    known = F.when(F.col("context") == V.NO_CONTEXT, F.array().cast("array<string>")).otherwise(F.array("context"))
    rows = rows.withColumn("report", grounding.support(F.col("answer"), known))
    rows = rows.withColumn("final", grounding.enforced(F.col("answer"), F.col("context"), F.col("quality"), F.col("report")))
    held = F.col("final.status") == "abstained_unsupported_evidence"
    return rows.drop("prompt").withColumns({
        "answer": F.col("final.answer"), "grounding": F.col("final.status"), "is_supported": held | F.col("report.is_supported"),
        "support_score": F.when(held, 1.0).otherwise(F.col("report.support_score")),
        "unsupported": F.when(held, F.array().cast("array<string>")).otherwise(F.col("report.unsupported")),
        "num_documents": F.size("scores"), "context_chars": F.length("context"), "generation_llm_calls": F.lit(1), "total_llm_calls": F.lit(1),
    }).drop("report", "final")


def blocked_records(rows: DataFrame) -> DataFrame:
    """Records of questions that the policy blocks: the fixed abstention, nothing searched, nothing generated."""
    return records(rows.select("query_id", "query", F.lit(V.STATIC_ABSTENTION).alias("answer"), F.lit(True).alias("blocked"), F.lit(1.0).alias("confidence"),
        F.col("policy.reason").alias("reasoning"), F.lit("static_corpus_policy").alias("decision_source"), F.lit("policy_blocked").alias("stage"), F.lit("none").alias("strategy"),
        F.lit("policy_blocked").alias("quality"), F.lit("abstained").alias("grounding"), F.lit(True).alias("is_supported"), F.lit(1.0).alias("support_score")))


def baseline(queries: DataFrame, index: retrieval.Index, generate: Generator = grounding.extractive_answer) -> tuple[DataFrame, DataFrame]:
    """(documents, records) of every question (query_id, query): blocked ones aren't searched, the others always are."""
    rows = stage(queries.select("query_id", "query").withColumn("policy", routing.policy(F.col("query"))), "judged")
    asked = rows.where("not policy.blocked")
    docs, counts = baseline_search(asked, index)
    docs = stage(docs, "baseline")
    made = answered(asked, docs, retrieval.quality(asked, docs, counts, weak=False), generate)
    made = made.withColumns({
        "needs_retrieval": F.lit(True), "confidence": F.lit(1.0), "reasoning": F.lit("Baseline always retrieves"), "decision_source": F.lit("fixed"), "stage": F.lit("single"),
        "strategy": F.lit("early_chunk_hybrid_sparse_dense_mmr"), "vector_queries": F.lit(1), "sparse_queries": F.lit(1), "total_operations": F.lit(3),
    })
    return docs, records(made).unionByName(blocked_records(rows.where("policy.blocked")))


def baseline_answer(queries: DataFrame, index: retrieval.Index, generate: Generator = grounding.extractive_answer) -> DataFrame:
    return baseline(queries, index, generate)[1]


def adaptive(queries: DataFrame, index: retrieval.Index, generate: Generator = grounding.extractive_answer) -> tuple[DataFrame, DataFrame]:
    """(documents, records): blocked questions get the fixed abstention, skipped ones an answer without context, the
    others the answer of their retrieval; one job for all of them."""
    rows = stage(routing.planned(queries.select("query_id", "query")), "planned")
    decided = [F.col("route.confidence").alias("confidence"), F.col("route.source").alias("decision_source"), F.col("route.reasoning").alias("reasoning")]
    skipped = rows.where("not policy.blocked and not route.needs_retrieval").select("query_id", "query", F.lit(V.ROUTER_SKIPPED).alias("context"), *decided)
    plain = generated(skipped.withColumn("prompt", grounding.prompt(V.NAIVE_PROMPT, F.col("query"))).withColumn("context", F.lit("")), generate)
    plain = plain.withColumn("report", grounding.support(F.col("answer"), F.array().cast("array<string>")))
    open_ = F.col("report.status") == "no_context"
    plain = plain.withColumns({
        "context": F.lit(V.ROUTER_SKIPPED), "context_chars": F.lit(len(V.ROUTER_SKIPPED)), "grounding": F.when(open_, "retrieval_skipped").otherwise(F.col("report.status")),
        "is_supported": F.when(~open_, F.col("report.is_supported")), "support_score": F.when(~open_, F.col("report.support_score")), "stage": F.lit("decision_only"), "strategy": F.lit("none"),
        "generation_llm_calls": F.lit(1), "total_llm_calls": F.lit(1), "total_operations": F.lit(1),
    })
    asked = rows.where("not policy.blocked and route.needs_retrieval")
    got = parent_child_retrieve(asked, index)
    docs = stage(got.documents, "adaptive")
    made = answered(asked, docs, got.quality, generate).join(asked.select("query_id", F.col("plan.complexity").alias("complexity"), *decided), "query_id")
    made = made.join(got.usage, "query_id").join(got.retry.select("query_id", F.col("attempted").alias("retry_attempted"), F.col("accepted").alias("retry_accepted")), "query_id")
    made = made.withColumns({
        "needs_retrieval": F.lit(True), "stage": F.lit("child"), "strategy": F.when(F.col("searched"), "adaptive_parent_child_multiquery_rrf_hybrid_contextual_mmr").otherwise("parent_child_multiquery_rrf_hybrid"),
        "total_operations": F.lit(1) + F.col("vector_queries") + F.col("sparse_queries"),
    })
    return docs, records(made).unionByName(blocked_records(rows.where("policy.blocked"))).unionByName(records(plain))


def adaptive_answer(queries: DataFrame, index: retrieval.Index, generate: Generator = grounding.extractive_answer) -> DataFrame:
    return adaptive(queries, index, generate)[1]
