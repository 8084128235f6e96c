"""Problem 5: near-duplicate records, by SuperMinHash signatures, banding, verification and grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import pairs_within, texts, token_set
from lodestrand.llm.components import components
from lodestrand.session import spread_join, stage

THRESHOLD = 0.85
#: A pair at 0.85 misses all bands with a probability of (1 - 0.85 ** 6) ** 22 = 0.00003; a pair at 0.2 meets in one with 0.0014.
BANDS, ROWS = 22, 6
HOT_BUCKET = 500
_BATCH_TOKENS = 400_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step, for uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_min_hash(values: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Signatures (records x ``size``) of sets of 64-bit hashes, given end to end with their ``lengths`` (all > 0).

    In step j every element gives its j-th random slot the value j + r; its slots are a random permutation, drawn
    step by step. A record is left once all its slots are filled, as later steps give greater values only.
    """
    n = len(lengths)
    terms, term = np.unique(values.view(np.uint64), return_inverse=True)
    rec = np.repeat(np.arange(n), lengths)
    sig = np.full(n * size, np.inf)
    slots = np.tile(np.arange(size, dtype=np.int16), (len(terms), 1))
    rows = np.arange(len(terms))
    for j in range(size):
        u = _mix(terms[rows] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((u & np.uint64(0xFFFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        chosen = slots[rows, k]
        slots[rows, k] = slots[rows, j]
        slots[rows, j] = chosen
        value = np.empty(len(terms))
        value[rows] = j + (u >> np.uint64(32)).astype(np.float64) / 2**32
        np.minimum.at(sig, rec * size + slots[term, j], value[term])
        if j % 4 == 3:
            open_ = np.isinf(sig.reshape(n, size)).any(axis=1)
            keep = open_[rec]
            if not keep.any():
                break
            rec, term = rec[keep], term[keep]
            rows = np.unique(term)
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(records x ``bands``) keys as int64, the number of the band being part of the key."""
    parts = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for i in range(rows):
        key = _mix(key ^ parts[:, :, i] + np.uint64(i))
    return key.view(np.int64)


def _band_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column("rep").to_numpy(zero_copy_only=False), b.column("hashes")
            values, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            ends, start = np.cumsum(lengths), 0
            while start < len(ids):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + _BATCH_TOKENS, "right")))
                size = lengths[start:stop]
                keys = band_keys(super_min_hash(values[done : ends[stop - 1]], size, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(ids[start:stop], bands)), pa.array(np.repeat(size, bands).astype(np.int32))],
                    ["key", "rep", "size"],
                )
                start = stop

    return run


def token_sets(docs: DataFrame) -> DataFrame:
    """(id, class_key, toks): the sorted set of distinct tokens of every content that has any, and its digest."""
    toks = texts(docs).select(F.col("doc_pos").alias("id"), F.sort_array(token_set(F.col("content"))).alias("toks"))
    return toks.where(F.size("toks") > 0).select("id", F.sha2(F.concat_ws(" ", "toks"), 256).alias("class_key"), "toks")


def candidate_pairs(classes: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a, b) of ``classes`` (rep, toks) that share a band.

    A bucket of more than ``hot`` classes isn't paired: its members are parted by the rarest tokens of each, of which
    two similar sets must share one, so nothing is lost there. Where even the rarest tokens are common, as in texts of
    one template, the holders of a token are paired by like lengths and in squares.
    """
    hashed = classes.select("rep", F.transform("toks", lambda t: F.xxhash64(t)).alias("hashes"))
    keyed = stage(hashed.mapInArrow(_band_rows(bands, rows), "key long, rep long, size int"), "band-keys")
    sizes = stage(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "band-sizes")
    shared = stage(spread_join(keyed, sizes, ["key"]), "shared-bands")
    near = F.least("size_a", "size_b") >= F.lit(threshold) * F.greatest("size_a", "size_b") - 1e-9
    pairs = pairs_within(shared.where(F.col("n") <= hot), ["key"], "rep", near, "size", threshold, None)
    crowd = stage(shared.where(F.col("n") > hot).select("rep").distinct(), "crowded")
    if not crowd.isEmpty():
        df = classes.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
        held = classes.join(crowd, "rep", "left_semi").select("rep", F.explode("toks").alias("tok"), F.size("toks").alias("size"))
        order = Window.partitionBy("rep").orderBy("df", "tok")
        first = spread_join(stage(held, "crowded-tokens"), df, ["tok"]).withColumn("at", F.row_number().over(order))
        first = first.where(F.col("at") <= F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).select("rep", "size", "tok")
        pairs = pairs.unionByName(pairs_within(stage(first, "rare-tokens"), ["tok"], "rep", near, "size", threshold))
    return pairs.distinct()


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD, **kw) -> DataFrame:
    """Pairs (a, b, similarity) of classes whose token sets have at least ``threshold`` of their union in common. Token
    sets are joined by shuffle, as their files tell too little of their size to broadcast them."""
    pairs = stage(candidate_pairs(classes, threshold, **kw), "candidate-pairs")
    one = classes.select(F.col("rep").alias("a"), F.col("toks").alias("toks_a")).hint("merge")
    two = classes.select(F.col("rep").alias("b"), F.col("toks").alias("toks_b")).hint("merge")
    both = spread_join(pairs, one, ["a"])
    both = both.join(two, "b").withColumn("common", F.size(F.array_intersect("toks_a", "toks_b")))
    union = F.size("toks_a") + F.size("toks_b") - F.col("common")
    return both.withColumn("similarity", F.col("common") / union).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, **kw) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``members`` (id, rep) names for every content with a token the smallest id of those with the
    very same token set; ``links`` (a, b, similarity) are the similar pairs of such representatives.

    Null and blank contents, those without a token, null ids and arrivals after the first don't count.
    """
    sets = stage(token_sets(docs), "token-sets")
    classes = stage(sets.groupBy("class_key").agg(F.min("id").alias("rep"), F.first("toks").alias("toks")), "token-classes")
    members = sets.select("id", "class_key").join(classes.select("class_key", "rep"), "class_key").select("id", "rep")
    return stage(members, "members"), stage(similar_classes(classes.select("rep", "toks"), threshold, **kw), "similar")


def document_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of documents, within a class and between linked ones, the smaller id first. A class that holds a third of
    all documents is paired in squares; ``document_groups`` says the same in one row a document."""
    within = pairs_within(members, ["rep"], "id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    m, w = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = spread_join(m, links.select("a", "b"), ["a"])
    across = spread_join(w, across, ["b"])
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within.unionByName(across)


def document_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, rep, group_id, links): for every document its class, its group of linked classes (by smallest id) and the
    number of other classes its own is linked to."""
    roots = components(links.select("a", "b")).select(F.col("node").alias("rep"), "root")
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(roots, "rep", "left").join(ends, "rep", "left").select(
        "id", "rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
