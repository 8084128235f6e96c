"""Problem 6: records that differ only in how they are written."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import let
from lodestrand.llm.common import blank, letters
from lodestrand.session import spread_join, stage

LINE_ENDS = r"\r\n|[\n\u000B\u000C\r\u0085\u2028\u2029|]"
LEAST_PIECES = 3


def content_fields(content: Column) -> Column:
    """The normalized fields of a content: of a card its pieces by letters, else its letters, as one field.

    A card is parted by line ends or ``|`` into at least three non-blank pieces, each holding a colon. The name of a
    card's field and its value stay together in its piece; other contents have one field.
    """

    def by_piece(pieces: Column) -> Column:
        is_card = (F.size(pieces) >= LEAST_PIECES) & F.forall(pieces, lambda x: x.contains(":"))
        return F.when(is_card, F.transform(pieces, letters)).otherwise(F.array(letters(content)))

    pieces = F.filter(F.split(content, LINE_ENDS), lambda x: ~blank(x))
    parted = content.contains(":") & content.rlike(LINE_ENDS)
    return F.when(parted, let(pieces, by_piece)).otherwise(F.array(letters(content)))


def question_fields(question: Column, answers: Column) -> Column:
    """``q`` and the letters of the question, then ``a`` and the letters of each different answer that has any.
    Null where no answer has letters: such questions don't count."""
    given = F.array_distinct(F.filter(F.transform(F.filter(answers, lambda x: x.isNotNull()), letters), lambda x: x != ""))
    named = F.concat(F.array(F.concat(F.lit("q"), letters(F.coalesce(question, F.lit(""))))), F.transform(given, lambda x: F.concat(F.lit("a"), x)))
    return F.when(F.size(given) > 0, named)


def fingerprint(fields: Column, bits: int = 64) -> Column:
    """A hash of a multiset: of two hashes of each field the halves are summed, so order doesn't matter, repeats do,
    and nothing is sorted. ``bits`` under 64 weakens it, for tests of the verification."""
    mask = F.lit((1 << min(bits, 32)) - 1)

    return let(fields, lambda x: _fingerprint(x, mask, bits))


def _fingerprint(fields: Column, mask: Column, bits: int) -> Column:
    def total(seed: int, shift: int) -> Column:
        def half(x: Column) -> Column:
            return F.shiftrightunsigned(F.xxhash64(F.lit(seed), x), shift).bitwiseAND(mask)

        return F.aggregate(fields, F.lit(0).cast("long"), lambda acc, x: acc + half(x))

    if bits < 64:
        return F.when(fields.isNotNull(), F.struct(total(0, 0).alias("a")))
    sums = [total(seed, shift).alias(f"s{seed}_{shift}") for seed in (0, 1) for shift in (0, 32)]
    return F.when(fields.isNotNull(), F.struct(F.size(fields).alias("n"), *sums))


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether ``fields`` and ``keep_fields`` hold the same fields equally often."""
    for b in batches:
        one, two = b.column("fields").to_pylist(), b.column("keep_fields").to_pylist()
        same = [x == y or Counter(x) == Counter(y) for x, y in zip(one, two)]
        yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("keep_id"), b.column("id"), pa.array(same, pa.bool_())], ["origin", "keep_id", "copy_id", "same"])


@dataclass
class Records:
    """Sources of records, each as rows (origin, id, ...) and the fields that are worked out of them. An id may have
    several rows, as a document that arrives again; those with null fields don't count."""

    parts: list[tuple[DataFrame, Column]]

    def __add__(self, other: Records) -> Records:
        return Records(self.parts + other.parts)

    def marks(self, bits: int) -> DataFrame:
        """(origin, id, fp): an id's fingerprint, the greatest should its rows differ. Made where the rows are read; only
        fingerprints are shuffled."""
        rows = [df.select("origin", "id", fingerprint(fields, bits).alias("fp")) for df, fields in self.parts]
        both = reduce(DataFrame.unionByName, rows).where("id is not null and fp is not null")
        return both.groupBy("origin", "id").agg(F.max("fp").alias("fp"))

    def of(self, wanted: DataFrame, bits: int) -> DataFrame:
        """``wanted`` (origin, id, fp, ...) with the ``fields`` of the row that has the fingerprint. Fields are worked out
        for wanted ids only."""
        rows = []
        for df, fields in self.parts:
            met = df.join(wanted, ["origin", "id"]).withColumn("fields", fields)
            rows.append(met.where(fingerprint(F.col("fields"), bits) == F.col("fp")).select(*wanted.columns, "fields"))
        return reduce(DataFrame.unionByName, rows).dropDuplicates(["origin", "id"])


def duplicate_links(records: Records, bits: int = 64) -> DataFrame:
    """(origin, keep_id, copy_id) of ``records``: a row for each record other than the smallest id of its group of equal
    records. Records with null fields or ids don't count; an id is one record.

    Fields are fingerprinted where they are read, and only fingerprints are grouped. Those that share one are read
    again, their fields compared with those of the smallest id, and what fails the comparison is grouped by its very
    fields.
    """
    marks = stage(records.marks(bits), "record-marks")
    groups = marks.groupBy("origin", "fp").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = stage(marks.join(groups, ["origin", "fp"]).select("origin", "id", "fp", "keep_id"), "copy-marks")
    shared = stage(records.of(shared, bits), "copy-records")
    keep = shared.where("id = keep_id").select("origin", "keep_id", "fp", F.col("fields").alias("keep_fields"))
    compared = spread_join(shared.where("id <> keep_id"), keep, ["origin", "keep_id", "fp"]).select("origin", "keep_id", "id", "fields", "keep_fields")
    compared = stage(compared.mapInArrow(_same, "origin string, keep_id long, copy_id long, same boolean"), "copy-compared")
    failed = compared.where("not same").select("origin", F.col("copy_id").alias("id")).join(shared, ["origin", "id"])
    failed = failed.withColumn("exact", F.to_json(F.array_sort("fields")))
    again = failed.groupBy("origin", "exact").agg(F.min("id").alias("first_id"))
    late = failed.join(again, ["origin", "exact"]).where("id <> first_id").select("origin", F.col("first_id").alias("keep_id"), F.col("id").alias("copy_id"))
    return compared.where("same").select("origin", "keep_id", "copy_id").unionByName(late)


def corpus_records(docs: DataFrame) -> Records:
    """Records of corpus_docs by ``doc_pos``; null and blank contents don't count. Contents without any letter are all
    equal, as their letters are."""
    rows = docs.where(F.col("doc_pos").isNotNull() & ~blank(F.col("content")))
    return Records([(rows.select(F.lit("corpus_docs").alias("origin"), F.col("doc_pos").alias("id"), "content"), content_fields(F.col("content")))])


def question_records(questions: DataFrame) -> Records:
    """Records of questions by ``question_id``."""
    rows = questions.where(F.col("question_id").isNotNull())
    rows = rows.select(F.lit("questions").alias("origin"), F.col("question_id").alias("id"), "question", F.col("answers")["text"].alias("given"))
    return Records([(rows, question_fields(F.col("question"), F.col("given")))])


def copy_counts(records: Records, links: DataFrame) -> DataFrame:
    """(origin, keep_id, copies): every distinct record once, with the number of records that are it."""
    extra = links.groupBy("origin", F.col("keep_id").alias("id")).agg(F.count("*").alias("n"))
    ids = records.marks(64).select("origin", "id").join(links.select("origin", F.col("copy_id").alias("id")), ["origin", "id"], "left_anti")
    return ids.join(extra, ["origin", "id"], "left").select("origin", F.col("id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + 1).alias("copies"))
