"""Questions that arrive as a stream, answered batch by batch against a corpus that stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrand.operators.retrieval import Index
from lodestrand.plans.pipelines import adaptive_answer
from lodestrand.session import scope


def answer_stream(stream: DataFrame, index: Index, out: str, checkpoint: str, answer: Callable[[DataFrame, Index], DataFrame] = adaptive_answer) -> StreamingQuery:
    """Answers each micro-batch of ``stream`` (query_id, query) and adds it to the Parquet table at ``out``, a folder for
    each batch, so that a batch done again after a failure replaces itself."""

    def one(batch: DataFrame, n: int) -> None:
        with scope():  # what a batch stages goes with it
            if not batch.isEmpty():
                answer(batch, index).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
