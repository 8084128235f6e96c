"""The registry, and some queries of each kind against their SQL."""

import pytest

import __spark_entry__ as entry
from lodestrand.queries import registry
from tests.oracle import same

SOME = [
    "normalize_document_shapes", "serialize_documents", "reference_answer_shapes", "expected_abstentions", "cache_merge", "cached_embeddings", "entity_spans", "question_support", "grounding_by_quality",
    "render_prompts", "token_usage", "dedupe_preserve_order", "select_evidence", "baseline_answer", "parent_child_retrieve", "corrective_retry", "usage_accounting", "quality_report", "adaptive_answer", "evaluation_rows", "compare_models",
    "document_ids", "reference_answers", "corpus_fingerprint", "strip_injection_lines", "child_chunks", "cache_evict", "static_policy", "query_plan",
    "query_variants", "fact_markers", "answer_support", "bm25_topk", "rrf_fusion", "mmr_select", "token_f1", "hit_rate_text", "sliding_request_count", "min_interval",
]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, registry.QUERIES[name], registry.SQL[name])


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 60


def test_entry(spark):
    assert entry.entry(spark).count() > 0
