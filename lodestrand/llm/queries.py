"""The queries of the subpackage over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.llm import distinctive, format_dup, leakage, near_dup, neighbours, packing, pieces, spam, term_counts
from lodestrand.llm.common import contents
from lodestrand.session import stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_report(table(spark, d, "term_postings")).where("verdict is not null").select("term", "verdict")


def p1_term_report(spark: SparkSession, d: str) -> DataFrame:
    return term_counts.term_report(table(spark, d, "term_postings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = neighbours.store_vectors(table(spark, d, "vector_store")).unionByName(neighbours.cache_vectors(table(spark, d, "embedding_cache")))
    with neighbours.shuffles_dropped(spark):
        vectors = stage(neighbours.usable(rows), "vectors")
    pairs = neighbours.similar_pairs(vectors)
    return pairs.select(F.substring_index("space", "/", 1).alias("origin"), "id_a", "id_b")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split(table(spark, d, "corpus_docs"), pieces.window_pieces)


def p3_structure(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces_with_metadata(table(spark, d, "corpus_docs"), pieces.tree_pieces)


def p3_structure_checks(spark: SparkSession, d: str) -> DataFrame:
    """What ``p3_structure`` must hold, by document: characters covered, pieces over the limit, gaps, overlaps other than
    the one set, pieces whose text or metadata isn't the document's."""
    docs = table(spark, d, "corpus_docs")
    whole = contents(docs, ("metadata",)).withColumnsRenamed({"metadata": "own"})
    rows = p3_structure(spark, d).join(whole, "doc_pos")
    before = F.lag("char_end").over(Window.partitionBy("doc_pos").orderBy("piece_no"))
    text = F.expr("substring(content, cast(char_start + 1 as int), cast(char_end - char_start as int))")
    as_json = lambda c: F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(""))
    rows = rows.withColumn("start", F.coalesce(F.greatest(before - pieces.OVERLAP, F.lit(0)), F.lit(0)))
    wrong = (F.col("piece") != text) | (as_json(F.col("metadata")) != as_json(F.col("own")))
    return rows.groupBy("doc_pos").agg(
        F.max("char_end").alias("covered"), F.count_if(F.col("char_end") - F.col("char_start") > pieces.LIMIT).alias("over_limit"),
        F.count_if(F.col("char_start") != F.col("start")).alias("misplaced"), F.count_if(wrong).alias("altered"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_terms(table(spark, d, "corpus_docs"), method="bm25").select("doc_pos", "term")


def p4_log_odds(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_terms(table(spark, d, "corpus_docs"), method="log_odds").select("doc_pos", "term", "score")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_dup.document_pairs(*near_dup.near_duplicates(table(spark, d, "corpus_docs")))
    return pairs.select(F.col("x").alias("doc_pos_a"), F.col("y").alias("doc_pos_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.document_groups(*near_dup.near_duplicates(table(spark, d, "corpus_docs"))).withColumnRenamed("id", "doc_pos")


def _records(spark: SparkSession, d: str) -> format_dup.Records:
    docs, questions = table(spark, d, "corpus_docs"), table(spark, d, "questions")
    return format_dup.corpus_records(docs) + format_dup.question_records(questions)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return format_dup.duplicate_links(_records(spark, d))


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    return format_dup.copy_counts(records, format_dup.duplicate_links(records))


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing.window_checks(stage(p7_windows(spark, d), "windows"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.exact_leaks(leakage.alignments(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_alignments(spark: SparkSession, d: str) -> DataFrame:
    return leakage.alignments(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.scan(table(spark, d, "documents")).where("spam").select("doc_id")


def p9_measures(spark: SparkSession, d: str) -> DataFrame:
    return spam.scan(table(spark, d, "documents"))


QUERIES = {k: f for k, f in list(globals().items()) if k[0] == "p" and k[1].isdigit() and callable(f)}
