"""A vector cache as a table: lookups, merges and eviction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import vocab
from lodestrand.operators.dense import Embedder, embedding_identity, hash_embedding, usable
from lodestrand.session import stage


def in_force(entries: DataFrame) -> DataFrame:
    """Of entries (seq, cache_identity, dim, text_hash, vec) the usable one of the highest ``seq`` of each key."""
    good = entries.where(usable(F.col("vec"), F.col("dim")))
    best = good.groupBy("cache_identity", "text_hash").agg(F.max_by(F.struct("seq", "dim", "vec"), "seq").alias("r"))
    return best.select("cache_identity", "text_hash", "r.*")


def lookup(texts: DataFrame, cache: DataFrame, identity: str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``texts`` (text_hash, ...) in the entries in force of one identity."""
    held = cache.where(F.col("cache_identity") == identity)
    return texts.join(held.select("text_hash", "vec"), "text_hash"), texts.join(held, "text_hash", "left_anti")


def merge(disk: DataFrame, memory: DataFrame) -> DataFrame:
    """Both tables' entries, memory's before disk's; an identity whose dimension has changed is replaced by memory's."""
    new = memory.groupBy("cache_identity").agg(F.max("dim").alias("new_dim"))
    kept = disk.join(new, "cache_identity", "left").where("new_dim is null or new_dim = dim").drop("new_dim")
    return kept.join(memory, ["cache_identity", "text_hash"], "left_anti").unionByName(memory)


def embedded(texts: DataFrame, cache: DataFrame, embed: Embedder = hash_embedding, refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vectors, cache): ``vec`` for each of ``texts`` (key, text), out of the cache in force where it holds the text's
    hash under the embedder's identity with a usable vector, else made; and the cache with what was made. An embedder
    whose dimension has changed replaces all entries of its identity. ``refresh`` makes all anew."""
    identity = embedding_identity(embed)
    hashed = texts.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = cache.where(usable(F.col("vec"), F.col("dim")))
    hits, misses = lookup(hashed, held.where(F.lit(not refresh)), identity)
    top = F.coalesce(F.lit(cache.agg(F.max("seq")).first()[0]), F.lit(0))
    once = misses.groupBy("text_hash").agg(F.min("text").alias("text"))
    made = stage(embed(once, ["text_hash"], "text"), "made-vectors")
    entries = made.select(F.lit(identity).alias("cache_identity"), "text_hash", top.alias("seq"), F.size("vec").alias("dim"), "vec")
    vectors = hits.select("key", "vec").unionByName(misses.join(made, "text_hash").select("key", "vec"))
    return vectors, merge(held.select(entries.columns), entries)


def evict(cache: DataFrame, most: int = vocab.CACHE_VECTORS) -> DataFrame:
    """The ``most`` last inserted entries of each identity, the oldest going first.

    The place that is the last to stay is found on (identity, seq) alone, in two steps of counts by ranges of seq, so an
    identity that holds a third of the cache isn't brought into one task."""
    span = 4096
    slot = F.expr(f"seq div {span}").alias("slot")
    counts = cache.groupBy("cache_identity", slot).agg(F.count("*").alias("n"))
    later = Window.partitionBy("cache_identity").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    above = counts.withColumn("above", F.coalesce(F.sum("n").over(later), F.lit(0)))
    whole = above.where(F.col("above") + F.col("n") <= most).select("cache_identity", "slot", F.lit(None).cast("long").alias("left"))
    part = above.where((F.col("above") < most) & (F.col("above") + F.col("n") > most)).select("cache_identity", "slot", (F.lit(most) - F.col("above")).alias("left"))
    rows = cache.withColumn("slot", slot)
    edge = rows.join(part, ["cache_identity", "slot"])
    order = Window.partitionBy("cache_identity").orderBy(F.desc("seq"))
    edge = edge.withColumn("n", F.row_number().over(order)).where("n <= left").drop("n")
    return rows.join(whole, ["cache_identity", "slot"]).unionByName(edge).drop("slot", "left")
