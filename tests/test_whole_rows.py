"""Queries that must answer every row of their table, against plain Python."""

import json
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab as V
from lodestrand.queries import sqlparts as P
from lodestrand.queries.registry import QUERIES, SQL
from lodestrand.queries.samples import GROUNDING, POLICY, SECRETS
from tests.oracle import same

NAMES = [
    "Who dug Zürich Canal in 1821?", "Élodie Baker met Malmö and Ann Lee", "Why did Sekiléaper leave Wigan Pier?", "“What is Bolton Canal known for?”",
    "How many did Ann Lee keep in ２０２０ or 1850é?", "Москва Wigan 1234", "Żary É42 A1é",
]


def entities(q):
    spans = re.findall(r"\b(?:[A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+){0,4}|\d{3,4})\b", q)
    return list(dict.fromkeys(s for s in spans if s.lower() not in "what when where which who why how".split()))[:5]


def markers(a):
    numbers = re.findall(r"\b\d{1,4}(?:[.,:]\d+)?%?\b", a)
    spans = re.findall(r"\b(?:[A-Z][a-zA-Z0-9]+|[A-Z]{2,})(?:\s+(?:[A-Z][a-zA-Z0-9]+|[A-Z]{2,})){0,4}\b", a)
    names = [" ".join(w for w in s.split() if w not in V.MARKER_FILLER) for s in spans]
    return sorted({*numbers, *(s for s in names if s and s.lower() not in V.STOP_WORDS)}, key=lambda s: (len(s), s.lower(), s))


def variants(q, most):
    toks, names = [t for t in re.findall("[a-z0-9]+", q.lower()) if t not in V.STOP_WORDS], entities(q)
    related = [t for t in toks if t in V.MULTI_HOP]
    linked = " ".join(names + related[:4]) if names and related else ""
    return list(dict.fromkeys(v for v in (q, " ".join(toks[:12]), " ".join(names), linked) if v))[:most]


def questions(data):
    """First arrival of each question, stripped, and its answers."""
    rows = duckdb.sql(f"SELECT question_id, question, answers.text FROM '{data}/questions.parquet' WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY asked_at) = 1").fetchall()
    return {i: (q.strip(), list(dict.fromkeys(a.strip() for a in given or () if a and a.strip()))) for i, q, given in rows}


def test_names_beyond_ascii(spark):
    rows = spark.createDataFrame([(x,) for x in NAMES], "x string").select("x", T.entity_spans(F.col("x")).alias("e"), T.fact_markers(F.col("x")).alias("m")).collect()
    assert {r["x"]: (r["e"], r["m"]) for r in rows} == {x: (entities(x), markers(x)) for x in NAMES}


def test_every_question_has_entities_and_variants(spark, data):
    asked = {f"q{i}": q for i, (q, _) in questions(data).items()} | {f"s{i}": q.strip() for i, q in POLICY}
    assert not all(q.isascii() for q in asked.values())
    got = {r["key"]: json.loads(r["entities"]) for r in QUERIES["entity_spans"](spark, data).collect()}
    assert got == {k: entities(q) for k, q in asked.items()}
    most = {r["key"]: 3 if r["complexity"] == "low" else 4 for r in QUERIES["query_plan"](spark, data).collect()}
    got = {r["key"]: json.loads(r["variants"]) for r in QUERIES["query_variants"](spark, data).collect()}
    assert got == {k: variants(q, most[k]) for k, q in asked.items()}


def test_every_answer_has_markers(spark, data):
    want = {(i, k): "|".join(markers(a)) for i, (_, given) in questions(data).items() for k, a in enumerate(given, 1)}
    got = {(r["query_id"], r["place"]): r["markers"] for r in QUERIES["fact_markers"](spark, data).collect()}
    assert got == want and len(got) > 0


def test_secrets_of_a_table(spark, tmp_path):
    texts = SECRETS + [(20, None), (21, "OPENAI_API_KEY=your-key-goes-here\nGOOGLE_API_KEY=abcdefghijklmnop"), (22, "é sk-" + "a1" * 12 + " -----BEGIN PRIVATE KEY-----")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(k + str(i), ",".join(label for label, p in V.SECRET_PATTERNS.items() if re.search(p, t or ""))) for k, rows in (("s", SECRETS), ("d", texts)) for i, t in rows]
    got = [tuple(r) for r in QUERIES["secret_report"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and {("d20", ""), ("d21", "assigned provider key"), ("d22", "private key,sk API key")} <= set(got)


@pytest.mark.parametrize("name", ["csv_safe_questions", "answer_abstentions"])
def test_whole_table_equals_its_sql(spark, data, name):
    same(spark, data, QUERIES[name], SQL[name])


def test_odd_rows_of_a_table(spark, tmp_path):
    rows = [(1, "=1+1", "@c", (["I cannot answer based on the provided context", "1790"],)), (2, "é?", None, (["-5"],)), (3, " ", "x", None)]
    asked = spark.createDataFrame(rows, "question_id long, question string, context string, answers struct<text: array<string>>")
    asked.withColumn("asked_at", F.current_timestamp()).write.parquet(str(tmp_path / "questions.parquet"))

    def run(name):
        return QUERIES[name](spark, str(tmp_path)).collect()

    assert {(r["query_id"], r["place"]): r["abstains"] for r in run("answer_abstentions")} == {(1, 1): True, (1, 2): False, (2, 1): False}
    assert {r["query_id"]: (r["query"], r["context"]) for r in run("csv_safe_questions")} == {1: ("'=1+1", "'@c"), 2: ("é?", None), 3: ("", "x")}
    assert {(r["query_id"], r["place"]): r["status"] for r in run("question_support")} == {(1, 1): "abstained", (1, 2): "weak_or_unsupported", (2, 1): "no_context"}


@pytest.mark.parametrize("name,known", [("question_support", "answer_support"), ("question_grounding", "enforce_grounding")])
def test_every_answer_is_grounded(spark, data, name, known):
    """ASCII rows by the SQL of the samples, put over the table; the others, where word boundaries differ, by their keys."""
    rows = {(r["query_id"], r["place"]): r.asDict() for r in QUERIES[name](spark, data).collect()}
    assert set(rows) == {(i, k) for i, (_, given) in questions(data).items() for k in range(1, len(given) + 1)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW questions AS SELECT * FROM '{data}/questions.parquet'")
    con.sql(f"CREATE TABLE g AS WITH {P.QUESTIONS} SELECT query_id * 1000 + place AS id, answer, coalesce(context, '') AS context FROM (SELECT query_id, context, unnest(given) AS answer, generate_subscripts(given, 1) AS place FROM (SELECT query_id, context, {P.ANSWERS} AS given FROM asked))")
    con.sql("CREATE TABLE cases AS SELECT * FROM g WHERE regexp_full_match(answer || context, '[\\x00-\\x7f]*')")
    rel = con.sql(SQL[known].replace(P.values(GROUNDING), "(SELECT * FROM cases)"))
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert want
    for w in want:
        i = w.pop("id")
        assert {k: pytest.approx(v, abs=1e-4) if isinstance(v, float) else v for k, v in w.items()} == {k: rows[i // 1000, i % 1000][k] for k in w}
