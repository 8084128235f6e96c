"""Records of all shapes, expectations, evaluation rows, exports that survive a failure, shared folders."""

import json

import pytest
from pyspark.sql import functions as F

from lodestrand import session
from lodestrand.operators import evaluation, grounding
from lodestrand.sources import documents as D
from lodestrand.sources import sinks


def test_shapes_of_records(spark, tmp_path):
    rows = [{"text": " one "}, {"content": "two", "title": "T"}, {"body": "", "passage": "three", "metadata": {"k": "v", "title": "old"}, "title": "new"}, {"text": "  "}, {"doc_id": "mine", "page_content": "four"}]
    path = tmp_path / "docs.json"
    path.write_text(json.dumps(rows))
    read = D.read_records(spark, str(path)).coalesce(1).withColumn("no", F.monotonically_increasing_id())
    got = {r["content"]: r for r in D.normalize(read, "no").collect()}
    assert set(got) == {"one", "two", "three", "four"}
    assert got["three"]["metadata"] == {"k": "v", "title": "new", "doc_id": "corpus-doc-0002", "index": "2"} and got["three"]["label"] == "new"
    assert got["four"]["doc_id"] == "mine" and got["one"]["label"] == "corpus-doc-0000"


def test_arrays_and_lines_of_records(spark, tmp_path):
    rows = [{"text": "one"}, {"text": "two"}]
    (tmp_path / "a.json").write_text("\n" + json.dumps(rows, indent=1))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    for name in ("a.json", "b.jsonl"):
        assert sorted(r["text"] for r in D.read_records(spark, str(tmp_path / name)).collect()) == ["one", "two"]
    with pytest.raises(Exception):
        D.read_records(spark, str(tmp_path / "none.json"))


def test_positions_count_kept_documents(spark):
    docs = spark.createDataFrame([(0, " "), (70_000, "a"), (3, "b"), (140_001, "c")], "pos long, text string")
    assert {r["content"]: r["doc_id"] for r in D.normalize(docs, "pos").collect()} == {"b": "corpus-doc-0000", "a": "corpus-doc-0001", "c": "corpus-doc-0002"}
    assert D.normalize(docs.where("false"), "pos").count() == 0


def test_records_without_a_text_column(spark):
    docs = spark.createDataFrame([(1, "x", "red", None), (2, "y", None, None)], "pos long, title string, colour string, size int")
    assert [(r["pos"], r["content"]) for r in D.normalize(docs, "pos").collect()] == [(1, "red")]


def answers(spark, df):
    return df.select(D.reference_answers(D.given_answers(df)).alias("x")).first()["x"]


def test_shapes_of_answers(spark):
    df = spark.createDataFrame([("a", [" b", "a", None])], "answer string, answers array<string>")
    assert answers(spark, df) == ["a", "b"]
    df = spark.createDataFrame([([("", "x"), ("y", None), None],)], "answers array<struct<text: string, answer: string>>")
    assert answers(spark, df) == ["x", "y"]
    df = spark.createDataFrame([(("z",),)], "answers struct<text: string>")
    assert answers(spark, df) == ["z"]
    df = spark.createDataFrame([([1, 2], None)], "answer array<int>, answers struct<text: array<string>>")
    assert answers(spark, df) == ["1", "2"]


def test_expectations_are_checked(spark, tmp_path):
    def write(**kw):
        (tmp_path / "e.json").write_text(json.dumps({"schema_version": 1, "questions_sha256": "AB", "expected_abstention_indexes": [2, 3]} | kw))
        return D.read_expectations(spark, str(tmp_path / "e.json"), "ab")

    assert sorted(r[0] for r in write().collect()) == [2, 3]
    for wrong in ({"schema_version": 2}, {"questions_sha256": "cd"}, {"expected_abstention_indexes": [0]}, {"expected_abstention_indexes": [1.5]}):
        with pytest.raises(ValueError):
            write(**wrong)


def evaluated(spark):
    questions = spark.createDataFrame([(1, "Who?", "ctx", ["Ann"]), (2, "Where?", "other", ["Wigan", "at Wigan"]), (3, "When?", "ctx", ["1790"]), (4, "x" * 40, "ctx", ["y"]), (5, "none", "ctx", [])], "query_id long, query string, context string, answers array<string>")
    docs = spark.createDataFrame([("d1", "ctx"), ("d2", "more")], "doc_id string, content string")
    record = "query_id long, answer string, blocked boolean, needs_retrieval boolean, quality string, suspicious long, grounding string, is_supported boolean, support_score double, total_operations long"
    rest = [c for c in evaluation.TAKEN if c not in {x.split()[0] for x in record.split(', ')}]
    told = spark.createDataFrame([(1, "Ann.", False, True, "good", 0, "supported", True, 0.9, 3), (2, "I cannot answer based on the provided context.", True, False, "policy_blocked", 0, "abstained", True, 1.0, 0), (3, "I cannot answer based on the provided context.", False, True, "weak", 1, "abstained_unsupported_evidence", True, 1.0, 5)], record)
    told = told.withColumns({c: F.lit(None).cast("array<string>") if c == "unsupported" else F.lit(c == "x") if c.startswith("retry") else F.lit(0).cast("long") for c in rest}).withColumn("query", F.lit("q")).withColumn("context", F.lit("c"))
    found = spark.createDataFrame([(1, 1, "d9"), (1, 2, "d1"), (3, 1, "d2")], "query_id long, rank int, doc_id string")
    expected = spark.createDataFrame([(3,)], "query_id long")
    return evaluation.rows(questions, told, found, docs, expected, "m", most=30)


def test_evaluation_rows(spark):
    got = {r["index"]: r for r in evaluated(spark).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["em"], got[1]["f1"], got[1]["retrieval_hit"], got[1]["reciprocal_rank"]) == (True, 1.0, True, 0.5)
    assert (got[2]["evaluation_category"], got[2]["recall_at_k"], got[2]["gold_document_ids"]) == ("unexpected_model_policy_abstention", None, [])
    assert (got[3]["evaluation_category"], got[3]["abstention_success"], got[3]["scored_qa"], got[3]["em"]) == ("expected_abstention", True, False, False)
    assert (got[4]["evaluation_category"], got[4]["scored_qa"], got[4]["reciprocal_rank"], got[4]["recall_at_k"]) == ("error", True, 0.0, None) and got[4]["error"]


def test_summary(spark):
    got = evaluation.summary(evaluated(spark), setup_sec=8.0).first().asDict()
    assert list(got) == evaluation.SUMMARY and len(got) == 31
    assert (got["num_examples"], got["num_qa_examples"], got["num_expected_abstentions"], got["num_retrieval_evaluable"]) == (4, 3, 1, 2)
    assert got["em"] == pytest.approx(1 / 3, abs=1e-6) and got["hit_rate"] == 0.5 and got["abstention_success_rate"] == 1.0 and got["abstention_rate"] == 0.5 and got["amortized_latency"] == 2.0
    none = evaluation.summary(evaluated(spark).where("false")).first()
    assert none["num_examples"] == 0 and none["em"] == 0.0 and none["corrective_retry_accept_rate"] == 0.0
    text = sinks.report(evaluation.summary(evaluated(spark), ["model"])).first()["report"]
    assert text.splitlines()[0] == "m:" and "  EM:              0.3333" in text
    assert len(sinks.comparison(evaluation.summary(evaluated(spark), ["model"])).columns) == 31
    assert sinks.per_question(evaluated(spark)).columns == sinks.PER_QUESTION


def test_a_failed_write_keeps_the_last(spark, tmp_path):
    path = str(tmp_path / "details")
    good = spark.createDataFrame([(1,), (2,)], "x int")
    sinks.write_details(good, good, path)
    bad = good.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        sinks.write_details(good, bad, path)
    assert spark.read.json(sinks.current(spark, path) + "/rows").count() == 2
    sinks.write_details(good, good.where("x = 1"), path)
    assert spark.read.json(sinks.current(spark, path) + "/rows").count() == 1


def test_token_usage(spark):
    rows = spark.createDataFrame([({"prompt_tokens": 5.0, "output_tokens": 2.0},), ({"input_tokens": -1.0, "prompt_tokens": 4.0, "total_tokens": 9.0},), ({},), (None,)], "u map<string,double>")
    got = [tuple(r["t"]) for r in rows.select(grounding.token_usage(F.col("u")).alias("t")).collect()]
    assert got == [(5, 2, 7), (4, 0, 9), (0, 0, 0), (0, 0, 0)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_hot_keys_join_like_others(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 250, 0).otherwise(F.col("id")).alias("k"), "id")
    side = spark.range(400).select((F.col("id") - F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    want = sorted((i, v) for i in range(300) for v in range(400) if v - v % 2 == (0 if i < 250 else i))
    assert sorted((r["id"], r["v"]) for r in session.spread_join(rows, side, ["k"], least=20).collect()) == want
