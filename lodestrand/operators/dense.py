"""Vectors: hash embedding, normalisation, exact search."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import text as T
from lodestrand.functions import vocab
from lodestrand.operators.sparse import top_k
from lodestrand.session import stage

#: Query vectors are sent to the corpus in blocks of about so many bytes.
BLOCK_BYTES = 32 << 20
QUERY_ROWS = 512


def usable(v: Column, dim: Column | None = None) -> Column:
    """A vector that isn't empty, has ``dim`` elements and only finite ones."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & finite
    return F.coalesce(ok if dim is None else ok & (F.size(v) == dim), F.lit(False))


def nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def l2_normalize(v: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return T.let(norm, lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def hash_embedding(docs: DataFrame, keys: list[str], text: str = "content", dims: int = vocab.HASH_DIMS) -> DataFrame:
    """(keys..., vec): every run of the text adds 1 or -1, by the fifth byte of its SHA-256, to the element its first
    four bytes name; then unit length. Arrow batches of the runs are hashed, each different one once, and summed;
    nothing is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            words = lists.flatten().dictionary_encode()
            digests = [hashlib.sha256(w.encode()).digest() for w in words.dictionary.to_pylist()]
            slot = np.array([int.from_bytes(h[:4], "big") % dims for h in digests], np.int64)
            sign = np.array([1.0 if h[4] % 2 == 0 else -1.0 for h in digests])
            word = words.indices.to_numpy()
            sums = np.bincount(at * dims + slot[word], sign[word], len(lists) * dims).reshape(len(lists), dims)
            norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            unit = sums / np.where(norm > 0, norm, 1.0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, dims), pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], vec], [*keys, "vec"])

    rows = docs.select(*keys, T.runs(F.coalesce(F.col(text), F.lit(""))).alias("vec"))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.mapInArrow(add, ", ".join([*kinds, "vec array<double>"]))


#: Adds ``vec`` to (keys..., text): DataFrame, keys, name of the text -> (keys..., vec), unit vectors of one dimension.
Embedder = Callable[[DataFrame, list[str], str], DataFrame]


def embedding_identity(embed: Embedder) -> str:
    """The name that an embedder's vectors are cached under: its own ``cache_identity``, or a hash of what it is."""
    if own := getattr(embed, "cache_identity", None):
        return str(own)
    details = {"class": f"{embed.__module__}.{embed.__qualname__}" if hasattr(embed, "__qualname__") else type(embed).__qualname__}
    details |= {k: getattr(embed, k, None) for k in ("model", "dimensions", "revision", "normalized")}
    return hashlib.sha256(json.dumps(details, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


hash_embedding.cache_identity = f"hash-{vocab.HASH_DIMS}"


def search(queries: DataFrame, docs: DataFrame, k: int, query_keys: list[str], doc_key: str, vec: str = "vec", exclude_self: bool = False) -> DataFrame:
    """(query_keys..., doc_key, score, rank): the ``k`` documents of the highest cosine for each query vector, equal
    ones by ascending key. Both sides hold unit vectors of one dimension; zero queries find nothing.

    The corpus is read in as many parts as there are cores, and queries go to each in blocks of about BLOCK_BYTES; a part
    keeps ``k`` rows for each query of a block, so what is shuffled doesn't grow with the rows. With more than one block each is worked
    off and its vectors are dropped before the next is sent; ``docs`` should be a staged table then. Keys are of type long.
    """
    if k <= 0:
        return top_k(queries.select(*query_keys).crossJoin(docs.select(doc_key)).withColumn("score", F.lit(0.0)).where("false"), 0, query_keys, doc_key)
    asked = queries.where(nonzero(F.col(vec))).select(*[F.col(c).cast("long") for c in query_keys], F.transform(F.col(vec), lambda x: x.cast("double")).alias("v"))
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("n")).first()["n"] * 8
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        asked = stage(asked, "query-vectors")
    fields = ", ".join([f"{c} long" for c in query_keys] + [f"{doc_key} long", "score double"])
    rows = docs.select(F.col(doc_key).cast("long").alias(doc_key), F.transform(F.col(vec), lambda x: x.cast("double")).alias("v"))
    rows = rows.coalesce(queries.sparkSession.sparkContext.defaultParallelism)
    found = None
    for i in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(*query_keys), F.lit(blocks)) == i)
        got = part.toArrow()
        ids = np.stack([got.column(c).to_numpy() for c in query_keys], 1) if got.num_rows else np.zeros((0, len(query_keys)), np.int64)
        q = np.array(got.column("v").to_pylist(), dtype=float).reshape(len(ids), -1)
        shared = queries.sparkSession.sparkContext.broadcast((ids, q))
        one = rows.mapInArrow(_scan(shared, k, query_keys, doc_key, exclude_self), fields)
        if blocks > 1:
            one = stage(top_k(one, k, query_keys, doc_key).drop("rank"), "nearest")
            shared.destroy()
        found = one if found is None else found.unionByName(one)
    return top_k(found, k, query_keys, doc_key)


def _scan(shared, k: int, query_keys: list[str], doc_key: str, exclude_self: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best_s, best_d = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if not b.num_rows or not len(q):
                continue
            docs = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(docs), -1)
            for i in range(0, len(q), QUERY_ROWS):
                part = slice(i, i + QUERY_ROWS)
                s = q[part] @ x.T
                if exclude_self:
                    s[ids[part, :1] == docs[None, :]] = -np.inf
                _keep(s, docs, best_s[part], best_d[part])
        at = np.nonzero(np.isfinite(best_s))
        cols = [pa.array(ids[at[0], c]) for c in range(len(query_keys))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(best_d[at]), pa.array(best_s[at])], [*query_keys, doc_key, "score"])

    return run


def _keep(s: np.ndarray, docs: np.ndarray, best_s: np.ndarray, best_d: np.ndarray) -> None:
    """Puts the cosines that belong to the best of each row into these, in order of cosine to nine decimals and key. What
    is less than the last of a row's best is passed over at once."""
    m, k = best_s.shape
    least = best_s[:, -1]
    if k < s.shape[1] and not np.isfinite(least).all():
        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    row, at = np.nonzero(s >= (least - 2e-9)[:, None])
    if not len(row):
        return
    rows = np.concatenate([np.repeat(np.arange(m), k), row])
    score, key = np.concatenate([best_s.ravel(), s[row, at]]), np.concatenate([best_d.ravel(), docs[at]])
    order = np.lexsort((key, -np.round(score, 9), rows))
    kept = order[np.searchsorted(rows[order], np.arange(m))[:, None] + np.arange(k)]
    best_s[:], best_d[:] = score[kept], key[kept]


def rerank(pool: DataFrame, keys: list[str], tie: str, weight: float = vocab.RERANK_WEIGHT) -> DataFrame:
    """Orders a dense pool (keys..., rank, relevance) anew by (1 - weight) * (1 - (rank - 1) / n) + weight * relevance;
    equal scores keep the dense order. The pool's size n counts, so a wider pool isn't a longer list of the same."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    score = F.lit(1 - weight) * (F.lit(1.0) - (F.col("rank") - 1) / n) + F.lit(weight) * F.col("relevance")
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("blend", 9)), "dense_rank")
    return pool.withColumn("blend", score).withColumnRenamed("rank", "dense_rank").withColumn("rank", F.row_number().over(order))
