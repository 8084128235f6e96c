"""What several operators of the subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.vocab import STOP_WORDS
from lodestrand.session import spread, stage

#: Groups are paired in squares of so many members a side.
PAIR_BLOCK = 2_000

def blank(c: Column) -> Column:
    """True for null and for texts of white space only."""
    return c.isNull() | ~c.rlike(r"(?U)\S")


#: Keys that repeat are broadcast up to so many.
SENT_KEYS = 500_000


def texts(docs: DataFrame) -> DataFrame:
    """(doc_pos, content) as of ``contents``, the texts staying where they are read: first the keys that repeat are found,
    and only their rows are brought together. Beyond SENT_KEYS of these all rows meet them by shuffle."""
    kept = spread(docs.where(F.col("doc_pos").isNotNull() & ~blank(F.col("content"))).select("doc_pos", "content"))
    twice = stage(kept.groupBy("doc_pos").agg(F.count("*").alias("n")).where("n > 1").select("doc_pos"), "repeated-keys")
    few = F.broadcast(twice) if twice.count() <= SENT_KEYS else twice
    again = kept.join(few, "doc_pos", "left_semi").groupBy("doc_pos").agg(F.max("content").alias("content"))
    return kept.join(few, "doc_pos", "left_anti").unionByName(again)


def contents(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_pos, content, extra...) with each ``doc_pos`` once; null and blank contents and null keys are left out.

    A document that arrives again has the same content; should contents differ, the greatest is taken, so the
    result doesn't depend on the order of rows. The extra columns are of the latest arrival.
    """
    kept = docs.where(F.col("doc_pos").isNotNull() & ~blank(F.col("content")))
    if not extra:
        return kept.groupBy("doc_pos").agg(F.max("content").alias("content"))
    last = F.max_by(F.struct(*extra), F.col("ingested_at")) if "ingested_at" in docs.columns else F.first(F.struct(*extra))
    rows = kept.groupBy("doc_pos").agg(F.max("content").alias("content"), last.alias("_extra"))
    return rows.select("doc_pos", "content", *[F.col("_extra")[c].alias(c) for c in extra])


_TOKEN = "(?<![a-z0-9])(?!(?:" + "|".join(STOP_WORDS) + ")(?![a-z0-9]))[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 but for the stop words, in the order of the text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    """The distinct tokens."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(runs, F.array(*[F.lit(w) for w in STOP_WORDS]))


def letters(text: Column) -> Column:
    """Letters and digits of any script, lower-cased, all else dropped."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def pairs_within(rows: DataFrame, on: list[str], ident: str, keep: Column | None = None, size: str | None = None, threshold: float = 1.0, block: int | None = PAIR_BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of the distinct ``ident`` of ``rows`` that agree in ``on``, of which ``keep`` is true (over
    a, b, and ``size`` as size_a, size_b).

    A group of over ``block`` members is paired in squares of blocks, so no task holds it. With ``size``, only members
    whose sizes are within ``threshold`` of each other are brought together there: sizes are ranked by powers of it,
    and a rank meets itself and its two neighbours. ``block`` of None says that every group is small. ``rows`` is read
    twice and should be staged."""
    extra = [size] if size else []
    one = rows.select(*on, F.col(ident).alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    two = rows.select(*on, F.col(ident).alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    met = F.col("a") < F.col("b") if keep is None else (F.col("a") < F.col("b")) & keep
    if block is None:
        return one.join(two, on).where(met).select("a", "b")
    sizes = rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    sizes = stage(sizes, "large-groups")
    if sizes.isEmpty():
        return one.join(two, on).where(met).select("a", "b")
    small = one.join(sizes, on, "left_anti").join(two, on).where(met).select("a", "b")
    one, two = one.join(sizes.select(*on), on), two.join(sizes.select(*on), on)
    keys = [*on]
    if size:
        step = F.lit(1.0 / threshold)
        ranked = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.log(step)).cast("int")
        near = F.array(*[ranked(f"{size}_a") + i for i in (-1, 0, 1)])
        one, two, keys = one.withColumn("_rank", F.explode(near)), two.withColumn("_rank", ranked(f"{size}_b")), [*on, "_rank"]
    cells = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    square = stage(cells(one, "_rows").join(cells(two, "_cols"), keys), "squares")
    one = one.join(square, keys).withColumn("_i", F.pmod(F.xxhash64("a"), F.col("_rows")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)))
    two = two.join(square, keys).withColumn("_j", F.pmod(F.xxhash64("b"), F.col("_cols")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
    cell = [*keys, "_i", "_j"]
    large = one.select(*cell, "a", *[f"{c}_a" for c in extra]).join(two.select(*cell, "b", *[f"{c}_b" for c in extra]), cell)
    return small.unionByName(large.where(met).select("a", "b"))
