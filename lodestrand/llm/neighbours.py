"""Problem 2: the most similar vectors of every vector, by partition and exact scores.

Rows are parted into cells around the centres of a spherical k-means, and cells that are still large once more, level by
level. A row stands in several of its nearest cells, and is compared exactly with every row of each, so two rows meet if
any cell is near to both. A space of up to SPLIT_AT rows is one cell, and its result is exact. The index can also keep a
vector's residual from its cell's centre as 4-bit codes of an anisotropic product quantiser, whose loss weighs the part
of the error along the vector more than the part across it; the search doesn't scan them, as a table look-up costs NumPy
several times a row's product.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.session import discard, spread_join, stage

THRESHOLD = 0.82
K = 5
#: A level is fitted on so many rows a cell of the part it divides, LEAST_FIT at least; every row is indexed.
FIT_ROWS, LEAST_FIT = 8, 4_096
ROWS_PER_CELL = 160
#: A part of over SPLIT_AT rows is divided into FAN cells at most, up to LEVELS times.
FAN, SPLIT_AT, LEVELS = 8_192, 8_192, 4
#: Models of a level are sent to all executors if they are so many bytes together, else joined to blocks of so many rows.
MODEL_BYTES, MODEL_ROWS = 32 << 20, 16_384
#: Cells a row stands in at the first level, and below in each of them that is divided.
PROBES, PROBES_BELOW = 12, 3
#: Cells are searched in rounds of about so many rows a vector, so that no more of them lie in shuffle files at once.
ROUND_ROWS = 4
CODE_DIMS = 2
ERROR_AT = 0.2
#: A cell of more rows is searched in squares of blocks of so many.
BLOCK = 65_536
#: Scores held at once in a task; float32 scores are off by less than SLACK.
SCORES, SLACK = 1 << 22, 1e-5
#: Of a vector with more than so many copies only the first are searched.
HOT_COPIES = 50
#: Small tables by space or cell are broadcast up to so many rows.
SENT_ROWS = 500_000

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROW = "space string, id long, key string, hash long, dim int, v binary"


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps usable vectors, as bytes of float32 of unit length."""
    for b in batches:
        lists = b.column("vec")
        dim = b.column("dim").to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy()) * ~lists.is_null().to_numpy(zero_copy_only=False)
        start = lists.offsets.to_numpy()[:-1]
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        ok = (size > 0) & (size == dim)
        out = [None] * len(ok)
        for d in np.unique(size[ok]):
            rows = np.flatnonzero(ok & (size == d))
            m = flat[start[rows][:, None] + np.arange(d)]
            top = np.abs(m).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            m = m[good] / top[good, None]
            m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
            for i, v in zip(rows[good], m):
                out[i] = v.tobytes()
        keep = np.flatnonzero([x is not None for x in out])
        yield pa.RecordBatch.from_arrays(
            [b.column(c).take(pa.array(keep)) for c in ("space", "id", "key", "hash", "dim")] + [pa.array([out[i] for i in keep], pa.binary())],
            ["space", "id", "key", "hash", "dim", "v"],
        )


def usable(rows: DataFrame) -> DataFrame:
    """Of ``rows`` (space, id, key, dim, vec) the usable ones: ``dim`` finite elements, not all zero. Of one key in a
    space the highest ``id`` holds; repeated rows count once. Null elements, ids, spaces and dims are unusable."""
    known = rows.where("space is not null and id is not null and dim is not null and vec is not null and not exists(vec, x -> x is null)")
    ready = known.select("space", "id", F.coalesce("key", F.lit("")).alias("key"), F.lit(0).cast("long").alias("hash"), "dim", "vec")
    normal = ready.mapInArrow(_normal, ROW)
    best = normal.groupBy("space", "key").agg(F.max_by(F.struct("id", "dim", "v"), "id").alias("r"))
    return best.select("space", "r.*").withColumn("hash", F.xxhash64("v"))


def store_vectors(store: DataFrame) -> DataFrame:
    return store.select(F.concat(F.lit("store/"), "cache_identity").alias("space"), F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("key"), "dim", F.col("vec").cast("array<double>").alias("vec"))


def cache_vectors(cache: DataFrame) -> DataFrame:
    return cache.select(F.concat(F.lit("cache/"), "cache_identity").alias("space"), F.col("seq").alias("id"), F.col("text_hash").alias("key"), "dim", "vec")


def _centres(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; a centre without members moves to a random row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(p @ c.T, axis=1) for p in np.array_split(x, max(1, len(x) // 1024))])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = np.bincount(own, minlength=k) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def encode(x: np.ndarray, base: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """4-bit codes (n x parts) of the residuals of ``x`` from ``base``, part by part the code of least loss
    |e|^2 + (eta - 1) (e.x)^2, where e is the whole remaining error."""
    parts, _, width = books.shape
    r = (x - base).reshape(len(x), parts, width)
    xs = x.reshape(len(x), parts, width)
    codes = np.zeros((len(x), parts), np.uint8)
    along = np.zeros((len(x), parts), np.float32)
    for p in range(parts):
        codes[:, p] = np.argmin((books[p] ** 2).sum(1) - 2 * r[:, p] @ books[p].T, axis=1)
        along[:, p] = ((r[:, p] - books[p][codes[:, p]]) * xs[:, p]).sum(1)
    total = along.sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            rest = total - along[:, p]
            dots = (r[:, p] * xs[:, p]).sum(1)[:, None] - xs[:, p] @ books[p].T
            across = (r[:, p] ** 2).sum(1)[:, None] + (books[p] ** 2).sum(1) - 2 * r[:, p] @ books[p].T
            codes[:, p] = np.argmin(across + (eta - 1) * (rest[:, None] + dots) ** 2, axis=1)
            along[:, p] = dots[np.arange(len(x)), codes[:, p]]
            total = rest + along[:, p]
    return codes


def _books(x: np.ndarray, base: np.ndarray, width: int, eta: float, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Sixteen code words for each part, by turns of encoding and of least squares under the anisotropic loss."""
    parts = x.shape[1] // width
    r = (x - base).reshape(len(x), parts, width)
    xs = x.reshape(len(x), parts, width)
    pick = rng.choice(len(x), 16, replace=len(x) < 16)
    books = np.ascontiguousarray(r[pick].transpose(1, 0, 2))
    eye = np.eye(width)
    for _ in range(rounds):
        codes = encode(x, base, books, eta, 1)
        along = np.stack([((r[:, p] - books[p][codes[:, p]]) * xs[:, p]).sum(1) for p in range(parts)], 1)
        total = along.sum(1)
        for p in range(parts):
            rest = total - along[:, p] + (r[:, p] * xs[:, p]).sum(1)
            left, right = np.zeros((16, width, width)), np.zeros((16, width))
            np.add.at(left, codes[:, p], eye + (eta - 1) * xs[:, p, :, None] * xs[:, p, None, :])
            np.add.at(right, codes[:, p], r[:, p] + (eta - 1) * rest[:, None] * xs[:, p])
            used = np.bincount(codes[:, p], minlength=16) > 0
            books[p][used] = np.linalg.solve(left[used] + 1e-6 * eye, right[used][..., None])[..., 0]
    return books


@dataclass(frozen=True)
class Shape:
    """Rows a cell is meant for, cells a part is divided into at most (FAN or fewer), rows from which a cell is divided
    again, and the bytes of models that are broadcast."""

    fill: int = ROWS_PER_CELL
    fan: int = FAN
    split_at: int = SPLIT_AT
    model_bytes: int = MODEL_BYTES


def _small(df: DataFrame) -> DataFrame:
    """``df``, a staged table, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def _matrix(v: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_pylist()), np.float32).reshape(-1, dim)


def _cells(shape: Shape, rows):
    """Cells that a part of ``rows`` rows is divided into."""
    return 1 if rows <= shape.split_at else min(shape.fan, -(-rows // shape.fill))


def _fit(shape: Shape, coded: bool):
    """A part's model, and with codes the head of each of its cells: centre and code books."""

    def fit(table: pa.Table) -> pa.Table:
        space, cell, rows, dim = (table.column(c)[0].as_py() for c in ("space", "cell", "rows", "dim"))
        x = _matrix(table.column("v"), dim)
        rng = np.random.default_rng(7)
        k = max(1, min(_cells(shape, rows), len(x) // 2))
        centres = _centres(x, k, 4, rng)
        if not coded:
            return pa.table({"space": [space], "cell": [cell], "sub": pa.array([-1], pa.int32()), "body": pa.array([pickle.dumps((centres, None, None))], pa.binary())})
        width = CODE_DIMS if dim % CODE_DIMS == 0 else 1
        some = x[rng.permutation(len(x))[:4096]]
        eta = max(1.0, (dim - 1) * ERROR_AT**2 / (1 - ERROR_AT**2))
        books = _books(some, centres[np.argmax(some @ centres.T, axis=1)], width, eta, rng).astype(np.float32)
        bodies = [pickle.dumps((centres, books, eta))] + [pickle.dumps((c, books)) for c in centres]
        n = len(bodies)
        return pa.table({"space": [space] * n, "cell": [cell] * n, "sub": pa.array(range(-1, n - 1), pa.int32()), "body": pa.array(bodies, pa.binary())})

    return fit


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def unpack_codes(packed: np.ndarray, parts: int) -> np.ndarray:
    return np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, :parts]


PLACED = "space string, id long, v binary, cells array<long>, codes binary, held boolean"


def _nearest_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centres of each row, nearest first."""
    out = np.empty((len(x), n), np.int64)
    step = max(1, SCORES // 2 // len(centres))
    for i in range(0, len(x), step):
        away = -(x[i : i + step] @ centres.T)
        best = np.argpartition(away, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(away), 1))
        out[i : i + step] = np.take_along_axis(best, np.argsort(np.take_along_axis(away, best, 1), axis=1, kind="stable"), 1)
    return out


def _placed(model: bytes, space: str, cell: int, ids: np.ndarray, v: pa.Array, held: np.ndarray, probes: int) -> pa.RecordBatch:
    """Rows of one part with the cells of it they stand in, nearest first, and for those it holds the codes, if it has any."""
    centres, books, eta = pickle.loads(model)
    x = _matrix(v, centres.shape[1])
    n = min(probes, len(centres))
    best = _nearest_cells(x, centres, n)
    codes = [None] * len(x)
    if books is not None:
        codes = [row.tobytes() if h else None for row, h in zip(pack_codes(encode(x, centres[best[:, 0]], books, eta)), held)]
    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n), pa.int32()), pa.array(best.ravel() + cell * FAN))
    return pa.RecordBatch.from_arrays([pa.array([space] * len(x), pa.string()), pa.array(ids), v, cells, pa.array(codes, pa.binary()), pa.array(held)], ["space", "id", "v", "cells", "codes", "held"])


def _place_batches(shared, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = np.array([f"{c}/{s}" for s, c in zip(b.column("space").to_pylist(), b.column("cell").to_pylist())], dtype=object)
            ids, held = b.column("id").to_numpy(zero_copy_only=False), b.column("held").to_numpy(zero_copy_only=False)
            for p in np.unique(part.astype(str)) if len(part) else []:
                at = np.flatnonzero(part == p)
                cell, space = p.split("/", 1)
                yield _placed(shared.value[space, int(cell)], space, int(cell), ids[at], b.column("v").take(pa.array(at)), held[at], probes)

    return run


def _place_group(probes: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        body = [x for x in table.column("body").to_pylist() if x is not None]
        rows = table.filter(pa.compute.is_null(table.column("body")))
        if not len(rows):
            return pa.schema([("space", pa.string()), ("id", pa.int64()), ("v", pa.binary()), ("cells", pa.list_(pa.int64())), ("codes", pa.binary()), ("held", pa.bool_())]).empty_table()
        ids, held = rows.column("id").to_numpy(), rows.column("held").to_numpy()
        v = rows.column("v").combine_chunks()
        v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
        return pa.Table.from_batches([_placed(body[0], rows.column("space")[0].as_py(), rows.column("cell")[0].as_py(), ids, v, held, probes)])

    return run


def _divide(rows: DataFrame, sizes: DataFrame, probes: int, shape: Shape, coded: bool) -> tuple[DataFrame, DataFrame]:
    """(placed, heads) of ``rows`` (space, cell, id, v, held) by a model of each part of ``sizes`` (space, cell, rows),
    fitted by the executors on FIT_ROWS a cell of the rows it holds. Models of ``model_bytes`` together are broadcast; more
    are sent to blocks of each part's rows."""
    spark = rows.sparkSession
    share = F.col("rows") * (F.pmod(F.xxhash64("id", "cell", F.lit(11)), F.lit(1 << 20)) / F.lit(1 << 20))
    sample = rows.where("held").join(_small(sizes), ["space", "cell"]).where(share < F.greatest(F.lit(LEAST_FIT), FIT_ROWS * F.least(F.lit(shape.fan), F.ceil(F.col("rows") / shape.fill))))
    sample = sample.select("space", "cell", "rows", (F.octet_length("v") / 4).cast("int").alias("dim"), "v")
    fitted = stage(sample.groupBy("space", "cell").applyInArrow(_fit(shape, coded), "space string, cell long, sub int, body binary"), "models")
    models = fitted.where("sub = -1").select("space", "cell", "body")
    heads = fitted.where("sub >= 0").select("space", (F.col("cell") * FAN + F.col("sub")).alias("cell"), F.col("body").alias("head"))
    if (models.agg(F.sum(F.octet_length("body"))).first()[0] or 0) <= shape.model_bytes:
        shared = spark.sparkContext.broadcast({(r["space"], r["cell"]): bytes(r["body"]) for r in models.collect()})
        placed = stage(rows.mapInArrow(_place_batches(shared, probes), PLACED), "placed")
        shared.destroy()
        return placed, heads
    blocks = sizes.select("space", "cell", F.ceil(F.col("rows") / MODEL_ROWS).cast("int").alias("blocks"))
    parted = rows.join(_small(blocks), ["space", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").withColumn("body", F.lit(None).cast("binary"))
    sent = models.join(blocks, ["space", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("space", "cell", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("v"), F.lit(False).alias("held"), "block", "body")
    both = parted.select(*sent.columns).unionByName(sent)
    return stage(both.groupBy("space", "cell", "block").applyInArrow(_place_group(probes), PLACED), "placed"), heads


def _by_cell(placed: DataFrame) -> DataFrame:
    rows = placed.select("space", "id", "v", "codes", F.col("held").alias("owned"), F.posexplode("cells").alias("no", "cell"))
    held = F.col("owned") & (F.col("no") == 0)
    return rows.select("space", "cell", "id", "v", F.when(held, F.col("codes")).alias("codes"), held.alias("held"))


def index(vectors: DataFrame, probes: int = PROBES, shape: Shape = Shape(), coded: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cells, heads) of ``vectors`` (space, id, v): every row in the one cell that holds it and in the others it stands in
    (space, cell, id, v, codes, held), and of each cell its centre and code books (space, cell, head). Unless ``coded``
    there are no codes and no heads.

    A space is one part at first. The first level puts each row into its ``probes`` nearest cells, a lower one into
    PROBES_BELOW of each divided cell, so the work for a row grows with the number of levels, that is with the
    logarithm of the rows to the base FAN, besides that of a level's FAN cells, which grow up to ``split_at`` rows."""
    rows = vectors.select("space", F.lit(0).cast("long").alias("cell"), "id", "v", F.lit(True).alias("held"))
    sizes = stage(rows.groupBy("space", "cell").agg(F.count("*").alias("rows")), "space-sizes")
    front, heads = _divide(rows, sizes, probes, shape, coded)
    done = []
    for _ in range(LEVELS - 1):
        cells = _by_cell(front)
        large = cells.where("held").groupBy("space", "cell").agg(F.count("*").alias("rows")).where(F.col("rows") > shape.split_at)
        large = stage(large, "large-cells")
        if large.isEmpty():
            break
        few = _small(large)
        done.append(cells.join(few, ["space", "cell"], "left_anti"))  # read again from what is written
        inner = cells.join(few.select("space", "cell"), ["space", "cell"]).select("space", "cell", "id", "v", "held")
        front, more = _divide(inner, large, PROBES_BELOW, shape, coded)
        heads = stage(heads.join(few, ["space", "cell"], "left_anti").unionByName(more), "heads")
    return reduce(DataFrame.unionByName, [*done, _by_cell(front)]), heads


def scan(q: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Scores (queries x vectors) of 4-bit codes by table: a table a part, or for many vectors one for two parts."""
    parts, _, width = books.shape
    tables = np.einsum("qpw,pcw->pqc", q.reshape(-1, parts, width), books, optimize=True)
    score = np.zeros((len(q), len(codes)), np.float32)
    if len(codes) < 1_024 or parts % 2:
        for p in range(parts):
            score += tables[p].take(codes[:, p], axis=1)
        return score
    for p in range(0, parts, 2):
        two = (tables[p][:, :, None] + tables[p + 1][:, None, :]).reshape(len(q), 256)
        score += two.take(codes[:, p].astype(np.int64) * 16 + codes[:, p + 1], axis=1)
    return score


def _best(q: np.ndarray, q_ids: np.ndarray, db: np.ndarray, db_ids: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(row of ``q``, row of ``db``, cosine) of the ``k`` nearest others of each row of ``q``, in double precision; what
    can't be among them by its float32 score is left out before."""
    score = q @ db.T
    least = np.full(len(q), threshold - SLACK, np.float32)
    many = np.flatnonzero((score >= least[:, None]).sum(1) > 32)
    if len(many) and k + 1 < len(db):
        least[many] = np.maximum(least[many], np.partition(score[many], len(db) - k - 1, axis=1)[:, len(db) - k - 1] - 2 * SLACK)
    r, c = np.nonzero(score >= least[:, None])
    other = q_ids[r] != db_ids[c]
    r, c = r[other], c[other]
    value = np.zeros(len(r))
    for i in range(0, len(r), 1 << 16):
        at = slice(i, i + (1 << 16))
        value[at] = np.einsum("nd,nd->n", q[r[at]].astype(np.float64), db[c[at]].astype(np.float64))
    order = np.lexsort((db_ids[c], -value, r))
    order = order[value[order] >= threshold]
    r, c, value = r[order], c[order], value[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep], value[keep]


def _search(k: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        space = table.column("space")[0].as_py()
        ids, stored, asks = (table.column(c).to_numpy() for c in ("id", "stored", "asks"))
        out: list[list[np.ndarray]] = [[], [], []]
        if stored.any() and asks.any():
            x = _matrix(table.column("v"), len(table.column("v")[0].as_py()) // 4)
            db, db_ids, q, q_ids = x[stored], ids[stored], x[asks], ids[asks]
            step = max(1, SCORES // len(db))
            for i in range(0, len(q), step):
                r, c, value = _best(q[i : i + step], q_ids[i : i + step], db, db_ids, k, threshold)
                for to, got in zip(out, (q_ids[i + r], db_ids[c], value)):
                    to.append(got)
        a, b, c = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"space": pa.array([space] * len(a), pa.string()), "id": a.astype(np.int64), "other": b.astype(np.int64), "cosine": c.astype(np.float64)})

    return run


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a written table go as soon as it is written, and not when the driver collects its
    garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _copies(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(rest, links): of every vector with more than HOT_COPIES copies all but the ``k`` + 1 smallest ids are taken out of
    ``vectors`` and linked to the ``k`` smallest. Copies are found by hash and compared."""
    same = vectors.groupBy("space", "hash").agg(F.count("*").alias("n"), F.min("v").alias("first")).where(F.col("n") > HOT_COPIES)
    same = stage(same.select("space", "hash", "first"), "copied-vectors")
    if same.isEmpty():
        return vectors.select("space", "id", "v"), vectors.select("space", "id", F.col("id").alias("other"), F.lit(1.0).alias("cosine")).where("false")
    copies = stage(spread_join(vectors, same, ["space", "hash"]).where("v = first").select("space", "hash", "id"), "copies")
    ranks = Window.partitionBy("space", "hash").orderBy("id")
    first = copies.withColumn("at", F.row_number().over(ranks)).where(F.col("at") <= k + 1)
    first = stage(first.groupBy("space", "hash").agg(F.array_sort(F.collect_list("id")).alias("first_ids")), "first-copies")
    left = stage(spread_join(copies, first, ["space", "hash"]).where("not array_contains(first_ids, id)"), "other-copies")
    links = left.select("space", "id", F.explode(F.slice("first_ids", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    return vectors.join(left.select("space", "id"), ["space", "id"], "left_anti").select("space", "id", "v"), links


def nearest(vectors: DataFrame, k: int = K, threshold: float = THRESHOLD, probes: int = PROBES, shape: Shape = Shape()) -> DataFrame:
    """(space, id, other, cosine): for every row of ``vectors`` (as of ``usable``) up to ``k`` most similar others of its
    space, of a cosine of at least ``threshold``; of equal cosines the smaller id comes first.

    Of a vector with more than HOT_COPIES copies, only the ``k`` + 1 smallest ids are searched: they are the nearest of
    all its copies, at a cosine of 1. A cell of over BLOCK rows is searched block by block, and the cells in rounds.
    """
    with shuffles_dropped(vectors.sparkSession):
        return _nearest(vectors, k, threshold, probes, shape)


def _nearest(vectors: DataFrame, k: int, threshold: float, probes: int, shape: Shape) -> DataFrame:
    rest, links = _copies(vectors, k)
    cells, _ = index(rest, probes, shape, coded=False)
    sizes = stage(cells.groupBy("space", "cell").agg(F.count("*").alias("standing"), F.count_if("held").alias("holding")), "cell-sizes")
    many = sizes.where(F.col("standing") > BLOCK).select("space", "cell", F.ceil(F.col("standing") / BLOCK).cast("int").alias("parts"))
    total = sizes.agg(F.sum("standing").alias("standing"), F.sum("holding").alias("holding")).first()
    rounds = -(-(total["standing"] or 0) // (ROUND_ROWS * max(1, total["holding"] or 0))) or 1
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)

    def searched(part: DataFrame) -> DataFrame:
        def rows(df: DataFrame, block, of, stored, asks) -> DataFrame:
            return df.select("space", "cell", block.alias("block"), of.alias("part"), "id", "v", stored.alias("stored"), asks.alias("asks"))

        if many.isEmpty():
            groups = rows(part, zero, zero, yes, yes)
        else:
            parted = part.join(_small(many), ["space", "cell"], "left")
            large, own = parted.where("parts is not null"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
            each = F.explode(F.sequence(zero, F.col("parts") - 1))
            groups = rows(parted.where("parts is null"), zero, zero, yes, yes)
            groups = groups.unionByName(rows(large.withColumn("block", each), F.col("block"), own, no, yes))
            groups = groups.unionByName(rows(large.withColumn("part", each), own, F.col("part"), yes, no))
        return groups.groupBy("space", "cell", "block", "part").applyInArrow(_search(k, threshold), "space string, id long, other long, cosine double")

    order = Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "other")
    top = None
    for i in range(rounds):
        found = stage(searched(cells.where(F.pmod(F.xxhash64("cell"), F.lit(rounds)) == i)), "found")
        once = (found if top is None else top.unionByName(found)).repartition("space", "id").dropDuplicates(["space", "id", "other"])
        best = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        if i < rounds - 1:
            kept = stage(best, "nearest")
            for done in [found] + [top] * (top is not None):
                discard(done)
            top = kept
    return best.unionByName(links)


def similar_pairs(vectors: DataFrame, k: int = K, threshold: float = THRESHOLD, probes: int = PROBES, shape: Shape = Shape()) -> DataFrame:
    """(space, id_a, id_b) of vectors one of which is among the other's ``k`` nearest."""
    near = nearest(vectors, k, threshold, probes, shape)
    return near.select("space", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
