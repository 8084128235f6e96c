"""Queries over the events: limits, breaker, streams."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import vocab as V
from lodestrand.plans import pipelines
from lodestrand.queries.pipes import index, items_answered, shown
from lodestrand.queries.registry import query
from lodestrand.session import shared_dir, table
from lodestrand.streaming import answers, limits


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_request_count(spark: SparkSession, d: str) -> DataFrame:
    return limits.sliding_counts(table(spark, d, "events")).select("event_id", "user_id", "recent")


@query(
    """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, coalesce(user_id, -1) AS u, epoch_us(ts) AS t, row_number() OVER (PARTITION BY coalesce(user_id, -1) ORDER BY ts, event_id) AS n FROM events),
    a AS (SELECT u, n, t FROM e WHERE n = 1 UNION ALL SELECT u, n, t FROM (SELECT e.u, e.n, e.t FROM a JOIN e ON e.u = a.u AND e.n > a.n AND e.t >= a.t + 30000000 QUALIFY row_number() OVER (PARTITION BY e.u ORDER BY e.n) = 1))
    SELECT event_id, a.n IS NOT NULL AS spaced FROM e LEFT JOIN a USING (u, n)"""
)
def min_interval(spark: SparkSession, d: str) -> DataFrame:
    return limits.min_interval(table(spark, d, "events"), 30).select("event_id", "spaced")


#: Events of each user in order, and a step for each of them over all users at once.
_ORDERED = "e AS MATERIALIZED (SELECT event_id, user_id, ts, coalesce(user_id, -1) AS u, epoch_us(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY coalesce(user_id, -1) ORDER BY ts, event_id) AS n FROM events WHERE {0})"


@query(
    f"WITH RECURSIVE {_ORDERED.format('true')}, a AS (SELECT u, 0::BIGINT AS n, []::BIGINT[] AS kept, false AS admitted FROM (SELECT DISTINCT u FROM e) UNION ALL "
    "SELECT u, n, CASE WHEN len(k) < 3 THEN list_append(k, t) ELSE k END, len(k) < 3 FROM (SELECT e.u, e.n, e.t, list_filter(a.kept, lambda x: e.t - x < 3600000000) AS k FROM a JOIN e ON e.u = a.u AND e.n = a.n + 1)) "
    "SELECT event_id, user_id, ts, admitted FROM e JOIN a USING (u, n)"
)
def rate_limiter(spark: SparkSession, d: str) -> DataFrame:
    return limits.rate_limited(table(spark, d, "events"), limit=3, seconds=3600)


@query(
    f"WITH RECURSIVE {_ORDERED.format('user_id IS NOT NULL')}, a AS (SELECT u, 0::BIGINT AS n, 0 AS errors, NULL::BIGINT AS until, NULL::VARCHAR AS state FROM (SELECT DISTINCT u FROM e) UNION ALL "
    "SELECT u, n, CASE WHEN open THEN errors ELSE c END, CASE WHEN open THEN until WHEN c >= 2 THEN t + 3600000000 END, CASE WHEN open THEN 'open' ELSE 'closed' END FROM ("
    "SELECT *, CASE WHEN bad THEN CASE WHEN until IS NULL THEN errors ELSE 0 END + 1 ELSE 0 END AS c FROM (SELECT e.u, e.n, e.t, e.bad, a.errors, a.until, coalesce(e.t < a.until, false) AS open FROM a JOIN e ON e.u = a.u AND e.n = a.n + 1))) "
    "SELECT event_id, user_id, ts, state FROM e JOIN a USING (u, n)"
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    return limits.circuit_breaker(table(spark, d, "events"), failures=2, seconds=3600)


@query(items_answered())
def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """The held-out questions as a stream, answered by the baseline in micro-batches."""
    units = index(spark, d, V.CHILD_CHUNK)
    path = f"{d}/eval_items.parquet"
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    source = path if os.path.isdir(path) else folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if source == path else name).parquet(source)
    out = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    questions = stream.select(F.col("item_id").alias("query_id"), F.col("question").alias("query"))
    answers.answer_stream(questions, units, out + "/rows", out + "/log", pipelines.baseline_answer).awaitTermination()
    return shown(spark.read.parquet(out + "/rows").drop("batch"))
