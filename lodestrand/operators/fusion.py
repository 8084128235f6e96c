"""Fusion of ranked lists, duplicates within them, and diversity."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab


def reciprocal_rank(lists: DataFrame, keys: list[str], item: list[str], limit: int | None = None, k: int = vocab.RRF_K, carry: list[str] | None = None) -> DataFrame:
    """Fuses ``lists`` (keys..., list_no, rank, item...): the sum of 1 / (k + rank) over all of an item's places, equal
    sums in order of first arrival. No limit, or 0, keeps every item. (keys..., item..., carry..., score, rank); the
    ``carry`` columns are those of the item's first arrival."""
    seen = F.col("list_no").cast("long") * (1 << 32) + F.col("rank")
    first = [F.min_by(c, seen).alias(c) for c in carry or []]
    sums = lists.groupBy(*keys, *item).agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.min(seen).alias("first_seen"), *first)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "first_seen")
    ranked = sums.withColumn("rank", F.row_number().over(order)).drop("first_seen")
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def document_key(content: Column, origin: Column) -> Column:
    """What makes two retrieved texts the same document: the content without outer white space, and where it is from."""
    return F.md5(F.concat(T.strip(content), F.lit("\0"), F.coalesce(origin, F.lit(""))))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def pairs(rows: DataFrame, keys: list[str], rank: str = "rank", toks: str = "toks") -> DataFrame:
    """(keys..., rank_a, rank_b, similarity) of every two members of a ranked list, which are few by its limit."""
    a = rows.select(*keys, F.col(rank).alias("rank_a"), F.col(toks).alias("a"))
    b = rows.select(*keys, F.col(rank).alias("rank_b"), F.col(toks).alias("b"))
    return a.join(b, keys).where("rank_a < rank_b").select(*keys, "rank_a", "rank_b", T.jaccard(F.col("a"), F.col("b")).alias("similarity"))


def duplicate_rate(rows: DataFrame, keys: list[str], threshold: float = vocab.NEAR_DUPLICATE) -> DataFrame:
    """(keys..., duplicate_rate): the share of near-duplicate pairs of each list; a list of one has 0."""
    gathered = rows.groupBy(*keys).agg(F.collect_list("toks").alias("toks"))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lists in b.column("toks").to_pylist():
                like = [likeness(x, y) >= threshold for x, y in combinations([frozenset(t) for t in lists], 2)]
                out.append(sum(like) / len(like) if like else 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], pa.array(out, pa.float64())], [*keys, "duplicate_rate"])

    kinds = ", ".join(f"`{c}` {gathered.schema[c].dataType.simpleString()}" for c in keys)
    return gathered.mapInArrow(rate, f"{kinds}, duplicate_rate double")


def diverse(pool: DataFrame, keys: list[str], k: Column | int, weight: float = vocab.MMR_LAMBDA) -> DataFrame:
    """Maximal marginal relevance over a ranked pool (keys..., rank, relevance, toks, ...): (keys..., pick_no and the
    pool's columns). Step by step the member of the highest weight * relevance + 0.1 / rank - (1 - weight) * likeness
    to what is chosen is taken, the earlier of equal ones. A pool is one row's array, bounded by its limit."""
    extra = [c for c in pool.columns if c not in keys]
    limit = F.lit(k) if isinstance(k, int) else k
    gathered = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in extra if c != "rank"]))).alias("pool"), F.max(limit).alias("_k"))
    gathered = gathered.where(F.col("_k") > 0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pools = b.column("pool")
            parts = pools.flatten()
            ranks, scores, toks = (parts.field(c).to_pylist() for c in ("rank", "relevance", "toks"))
            ends, limits = pools.value_lengths().to_pylist(), b.column("_k").to_pylist()
            at, picked = 0, []
            for n, most in zip(ends, limits, strict=True):
                own = slice(at, at + n)
                picked.append([i + 1 for i in spread_out(scores[own], ranks[own], [frozenset(t) for t in toks[own]], most, weight)])
                at += n
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in [*keys, "pool"]], pa.array(picked, pa.list_(pa.int32()))], [*keys, "pool", "picked"])

    kinds = ", ".join(f"`{c}` {gathered.schema[c].dataType.simpleString()}" for c in [*keys, "pool"])
    picked = gathered.mapInArrow(choose, f"{kinds}, picked array<int>")
    out = picked.select(*keys, "pool", F.posexplode("picked").alias("n", "i")).withColumn("c", F.element_at("pool", F.col("i")))
    return out.select(*keys, (F.col("n") + 1).alias("pick_no"), *[F.col("c")[c].alias(c) for c in extra])


def spread_out(relevance: list[float], ranks: list[int], sets: list[frozenset], k: int, weight: float = vocab.MMR_LAMBDA) -> list[int]:
    """Places of the members that ``diverse`` takes of one pool, in order."""
    base = [r * weight + 0.10 / n for r, n in zip(relevance, ranks, strict=True)]
    worst, left, out = [0.0] * len(base), list(range(len(base))), []
    while left and len(out) < k:
        best = min(left, key=lambda i: (-math.floor((base[i] - worst[i] * (1 - weight)) * 1e12 + 0.5), i))
        out.append(best)
        left.remove(best)
        for i in left:
            worst[i] = max(worst[i], likeness(sets[i], sets[best]))
    return out


def likeness(a: frozenset, b: frozenset) -> float:
    """Jaccard's of two sets of tokens; 0 if either is empty."""
    if not a or not b:
        return 0.0
    n = len(a & b)
    return n / (len(a) + len(b) - n)
