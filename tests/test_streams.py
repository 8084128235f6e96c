"""Limits and streams."""

import datetime as dt

from pyspark.sql import functions as F

from lodestrand.operators.retrieval import Index
from lodestrand.plans import pipelines
from lodestrand.streaming import answers, limits

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s), u, t) for i, (s, u, t) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string")


def test_refused_requests_do_not_count(spark):
    rows = events(spark, [(0, 1, "a"), (1, 1, "a"), (2, 1, "a"), (60, 1, "a"), (61, 1, "a"), (61, 2, "a")])
    got = {r["event_id"]: r["admitted"] for r in limits.rate_limited(rows, 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_breaker_opens_and_closes(spark):
    rows = events(spark, [(0, 1, "error"), (1, 1, "error"), (2, 1, "view"), (70, 1, "error"), (71, 1, "view")])
    got = [r["state"] for r in limits.circuit_breaker(rows, 2, 60).orderBy("event_id").collect()]
    assert got == ["closed", "closed", "open", "closed", "closed"]


def test_sliding_counts_match_brute_force(spark):
    rows = events(spark, [(s, u, "a") for s in (0, 10, 59, 60, 61, 200) for u in (1, 2)])
    for r in limits.sliding_counts(rows).collect():
        assert r["recent"] == sum(1 for x in (0, 10, 59, 60, 61, 200) if 0 <= (r["ts"] - START).total_seconds() - x < 60)


def test_rate_limited_stream(spark, tmp_path):
    events(spark, [(0, 1, "a"), (1, 1, "a"), (2, 1, "a")]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = limits.limited_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_id"], r["admitted"]) for r in spark.table("limited").collect()) == [(0, True), (1, True), (2, False)]


def test_answer_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "The Bolton Canal opened in 1790.", "d0", "one")], "pos long, content string, doc_id string, label string")
    index = Index.build(pipelines.chunk_units(docs, 512, 80))
    spark.createDataFrame([(1, "When did the Bolton Canal open?")], "query_id long, query string").write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema("query_id long, query string").parquet(str(tmp_path / "q"))
    answers.answer_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "log"), pipelines.baseline_answer).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select(F.col("query_id")).collect()[0][0] == 1


def test_refused_requests_do_not_move_the_clock(spark):
    rows = events(spark, [(0, 1, "a"), (20, 1, "a"), (35, 1, "a"), (64, 1, "a"), (65, 1, "a"), (5, 2, "a")])
    got = {r["event_id"]: r["spaced"] for r in limits.min_interval(rows, 30).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True, 5: True}


def test_batches_leave_nothing_staged(spark, tmp_path):
    from lodestrand import session

    with session.scope():
        kept = session.stage(spark.range(3).toDF("x"), "scoped")
        files = [f.split(":", 1)[1].replace("//", "/") for f in kept.inputFiles()]
        assert kept.count() == 3
    import os

    assert files and not any(os.path.exists(f) for f in files)
