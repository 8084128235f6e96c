"""Problem 1: occurrences and record presence of every distinct term."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.session import partitions, stage

RANGE_WIDTH = 4096
RARE_DOCS = 2
COMMON_SHARE = 0.25


def live_postings(postings: DataFrame) -> DataFrame:
    """(doc_pos, term, tf): the state in force of each key, where the term is still in the document.

    Null or blank terms, null counts and null ``doc_pos`` are passed over. Of a key's rows the latest
    ``indexed_at`` holds (a null one is the oldest; of equal ones the greatest ``tf``); ``tf`` of 0 or less ends it.
    """
    term = F.lower(F.regexp_replace("term", r"(?U)^\s+|\s+$", ""))
    rows = postings.select("doc_pos", term.alias("term"), "tf", "indexed_at").where(
        F.col("doc_pos").isNotNull() & F.col("tf").isNotNull() & (F.col("term") != "")
    )
    state = rows.groupBy("doc_pos", "term").agg(F.max(F.struct("indexed_at", "tf")).alias("s"))
    return state.where("s.tf > 0").select("doc_pos", "term", F.col("s.tf").cast("long").alias("tf"))


def term_dictionary(terms: DataFrame, buckets: int) -> DataFrame:
    """(term, term_id) with ids 0, 1, 2 ... over distinct terms: a running number inside hash buckets, to which
    the sizes of the buckets before are added. Only ``buckets`` sums are ever broadcast."""
    from pyspark.sql import Window

    rows = terms.select("term").distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("term")) - 1)
    numbered = stage(numbered.withColumn("n", F.col("n").cast("long")), "term-numbers")
    sizes = numbered.groupBy("bucket").agg(F.count("*").alias("size"))
    before = sizes.select(
        "bucket",
        F.coalesce(
            F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    return numbered.join(F.broadcast(before), "bucket").select("term", (F.col("n") + F.col("before")).alias("term_id"))


def _sum_ranges(width: int):
    """Adds up the blocks' count arrays of one identifier range and names the ids again."""

    def add(arrays: pa.Table, names: pa.Table) -> pa.Table:
        occ, docs = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for k, to in (("occ", occ), ("docs", docs)):
            for slots, values in zip(arrays.column("slot").chunks, arrays.column(k).chunks):
                np.add.at(to, slots.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False))
        at = names.column("term_id").to_numpy() % width
        return pa.table({"term": names.column("term").combine_chunks(), "occurrences": occ[at], "docs": docs[at]})

    return add


def term_counts(live: DataFrame, blocks: int | None = None, width: int = RANGE_WIDTH) -> DataFrame:
    """(term, occurrences, docs) of every term of ``live``, which has one row per (doc_pos, term).

    Rows are added up within blocks of documents first, so a term that holds a third of the index leaves at most
    ``blocks`` rows; those are encoded by the global dictionary, put into count arrays of ``width`` ids each, and the
    arrays are summed by identifier range. A group has at most ``blocks`` arrays of ``width`` entries. An empty
    index gives no rows; extra columns are ignored.
    """
    spark = live.sparkSession
    blocks = blocks or min(256, max(16, partitions(spark)))
    block = F.pmod(F.xxhash64("doc_pos"), F.lit(blocks)).cast("int").alias("block")
    part = live.groupBy("term", block).agg(F.sum("tf").alias("occ"), F.count("*").alias("docs"))
    part = stage(part, "term-blocks")
    names = stage(term_dictionary(part, blocks), "term-dictionary")
    names = names.withColumn("range_no", F.expr(f"term_id div {width}"))
    coded = part.join(names, "term").select("block", "range_no", (F.col("term_id") % width).cast("int").alias("slot"), "occ", "docs")
    arrays = coded.groupBy("range_no", "block").agg(F.collect_list(F.struct("slot", "occ", "docs")).alias("a"))
    arrays = arrays.select("range_no", F.col("a.slot").alias("slot"), F.col("a.occ").alias("occ"), F.col("a.docs").alias("docs"))
    return (
        arrays.groupBy("range_no")
        .cogroup(names.select((F.col("range_no") + 0).alias("range_of"), "term_id", "term").groupBy("range_of"))
        .applyInArrow(_sum_ranges(width), "term string, occurrences long, docs long")
    )


def mark_terms(counts: DataFrame, n_docs: int, rare: int = RARE_DOCS, share: float = COMMON_SHARE) -> DataFrame:
    """Adds ``verdict``: rare (in at most ``rare`` documents), common (in more than ``share`` of them) or null.
    A term that is both, as in an index of a few documents, is rare."""
    verdict = F.when(F.col("docs") <= rare, "rare").when(F.col("docs") > F.lit(share) * n_docs, "common")
    return counts.withColumn("verdict", verdict)


def term_report(postings: DataFrame) -> DataFrame:
    """(term, occurrences, docs, verdict) for every term of the index in force."""
    live = stage(live_postings(postings), "live-postings")
    n_docs = live.select("doc_pos").distinct().count()
    return mark_terms(term_counts(live), n_docs)
