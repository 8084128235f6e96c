"""Problem 7: filling windows of fixed capacity with whole documents, by pattern packing on the histogram of lengths."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.session import stage

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Over all that are listed for 2,048 lengths; larger capacities share it among their lengths.
MOST_PATTERNS = 400_000
ROUNDS = 400
BUCKET_ITEMS, MOST_BUCKETS = 100_000, 512
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def _encoder(vocabulary: bytes):
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        pairs = (line.split() for line in vocabulary.splitlines() if line)
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        _encoders[key] = tiktoken.Encoding("window", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every document by the public vocabulary; null ids, null and empty texts have no row. The
    vocabulary's file is read here and sent to the executors, which need no path of their own; it is under 2 MB."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value).encode_ordinary
        for b in batches:
            sizes = pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes], ["doc_id", "tokens"])

    rows = docs.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(count, "doc_id long, tokens long")


def window_items(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece_no, token_start, size): each document as one item; only those over ``capacity`` are divided, into
    full windows and a remainder."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))
    cut = lengths.where("tokens > 0").select("doc_id", "tokens", F.posexplode(starts).alias("piece_no", "token_start"))
    return cut.select("doc_id", F.col("piece_no").cast("long").alias("piece_no"), "token_start", F.least(F.col("tokens") - F.col("token_start"), F.lit(capacity)).cast("int").alias("size"))


Pattern = tuple[int, ...]


def best_fit(hist: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best fit in descending order of length on whole counts: windows with the same content are kept as one entry with
    their number, so the work depends on the number of lengths, not of documents."""
    open_: dict[int, Counter[Pattern]] = {}
    done: Counter[Pattern] = Counter()
    for size in sorted((s for s, n in hist.items() if n > 0), reverse=True):
        left = hist[size]
        for room in sorted(r for r in open_ if r >= size):
            while left and open_.get(room):
                pattern, n = next(iter(open_[room].items()))
                fit = room // size
                if left >= fit:
                    take, times = min(n, left // fit), fit
                else:
                    take, times = 1, left
                open_[room][pattern] -= take
                if not open_[room][pattern]:
                    del open_[room][pattern]
                left -= take * times
                _put(open_, done, pattern + (size,) * times, room - size * times, take)
            if not left:
                break
        if left:
            fit = capacity // size
            if full := left // fit:
                _put(open_, done, (size,) * fit, capacity - size * fit, full)
            if rest := left % fit:
                _put(open_, done, (size,) * rest, capacity - size * rest, 1)
    for patterns in open_.values():
        done.update(patterns)
    return done


def _put(open_: dict, done: Counter, pattern: Pattern, room: int, n: int) -> None:
    if room:
        open_.setdefault(room, Counter())[pattern] += n
    else:
        done[pattern] += n


def candidate_patterns(hist: dict[int, int], capacity: int, most: int = MOST_PATTERNS) -> list[Pattern]:
    """Patterns of few documents that fill a window: every pair, and for every length with each of the most frequent
    ones the third that fits, the frequent ones being taken in turn for all lengths until there are ``most`` patterns; those of best fit on the histogram and on slices of it, which reach the short lengths."""
    sizes = np.array(sorted(hist), dtype=np.int64)
    known = set(hist)
    found: dict[Pattern, None] = {}
    for s in sizes[sizes == capacity]:
        found[(int(s),)] = None
    for scale in (1, 4, 16):
        for pattern in best_fit({s: -(-n // scale) for s, n in hist.items()}, capacity):
            found[pattern] = None
    often = [s for s, _ in Counter(hist).most_common(48)]
    for a in sizes.tolist():
        b = capacity - a
        if b in known and b <= a:
            found[(a, b)] = None
    for m in often:
        for k in range(1, 5):  # a long one, k of a frequent length, and what fills the window
            if len(found) >= most:
                return list(found)
            for a in sizes.tolist():
                c = capacity - a - k * m
                if c <= 0:
                    break
                if c in known:
                    found[tuple(sorted((a, *(m,) * k, c), reverse=True))] = None
    return list(found)


def fit_counts(patterns: list[Pattern], hist: dict[int, int], rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts by non-negative least squares: accelerated projected gradient on the patterns' length counts,
    each length being scaled by the root of its number."""
    sizes = {s: i for i, s in enumerate(sorted(hist))}
    cells = [(sizes[s], j, n) for j, p in enumerate(patterns) for s, n in Counter(p).items()]
    row, col = (np.array([c[k] for c in cells]) for k in (0, 1))
    weight = 1 / np.sqrt(np.maximum([hist[s] for s in sizes], 1))
    value = np.array([c[2] for c in cells], dtype=float) * weight[row]
    target = np.array([hist[s] for s in sizes]) * weight

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * x[col], len(sizes))

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(col, value * y[row], len(patterns))

    scale = np.sqrt(np.maximum(np.bincount(col, value**2, len(patterns)), 1e-12))
    z = np.ones(len(patterns))
    for _ in range(20):  # the largest eigenvalue, of columns of unit length
        z = back(times(z / scale)) / scale
        norm = np.linalg.norm(z)
        z /= norm
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(y - back(times(y / scale) - target) / scale / norm, 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = after + (t - 1) / t_after * (after - x), after, t_after
    return x / scale


def plan_windows(hist: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """How often each pattern is packed: fitted counts, rounded down to what the histogram holds, and best fit for the
    rest. Every document is in exactly one window."""
    if any(not 0 < s <= capacity for s in hist):
        raise ValueError("sizes must be from 1 to the capacity")
    hist = {s: n for s, n in hist.items() if n > 0}
    if not hist:
        return Counter()
    patterns = candidate_patterns(hist, capacity)
    counts = fit_counts(patterns, hist)
    left, plan = dict(hist), Counter()
    full = sorted(range(len(patterns)), key=lambda j: (sum(patterns[j]) < capacity, -counts[j]))
    for j in full:
        if sum(patterns[j]) < capacity * 0.995:
            continue
        need = Counter(patterns[j])
        n = min(int(counts[j] + 0.5), *(left[s] // k for s, k in need.items()))
        if n > 0:
            plan[patterns[j]] += n
            for s, k in need.items():
                left[s] -= n * k
    plan.update(best_fit(left, capacity))
    return plan


def _segments(plan: Counter[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(size, from, to, first window, offset): the items of a size numbered from ``from`` to ``to`` (exclusive) go into
    the windows from the first one on, one each, at the offset."""
    used: Counter[int] = Counter()
    out, base = [], 0
    for pattern, n in sorted(plan.items(), reverse=True):
        at = 0
        for size in pattern:
            out.append((size, used[size], used[size] + n, base, at))
            used[size] += n
            at += size
        base += n
    return out


def _pages(segments: np.ndarray, hist: dict[int, int]) -> tuple[dict[int, int], pa.Table]:
    """(width by size, segments by page): the items of a size are paged by their number, in as many pages as the size has
    segments, and every segment stands on each page it reaches into; so there are at most twice as many rows as
    segments, and an item meets two of them on average."""
    count = Counter(segments[:, 0].tolist())
    width = {s: max(1, -(-n // count[s])) for s, n in hist.items()}
    w = np.array([width[s] for s in segments[:, 0].tolist()], np.int64)
    first, last = segments[:, 1] // w, (segments[:, 2] - 1) // w
    at = np.repeat(np.arange(len(segments)), last - first + 1)
    page = np.arange(len(at)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[at]
    cols = {"size": segments[at, 0].astype(np.int32), "page": page, "lo": segments[at, 1], "hi": segments[at, 2], "base": segments[at, 3], "window_start": segments[at, 4].astype(np.int32)}
    return width, pa.table(cols)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(window_no, window_start, doc_id, piece_no, token_start, size) of every item of ``items``.

    Only the histogram of at most ``capacity`` lengths reaches the driver. The plan's segments are written as a table and
    joined by size and page of the item's number, so an item meets about two of them however many there are, and nothing
    but tables by size is broadcast. Items of one length are numbered within hash buckets and by the buckets' sums, so a
    length that a third of all documents have isn't brought into one task: a length has a bucket for each BUCKET_ITEMS
    of its items, MOST_BUCKETS at most, which bounds the sums.
    """
    spark = items.sparkSession
    items = items.select("doc_id", "piece_no", "token_start", "size")
    hist = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}
    segments = np.array(_segments(plan_windows(hist, capacity)), np.int64).reshape(-1, 5)
    width, paged = _pages(segments, hist)
    sizes = spark.createDataFrame([(s, min(MOST_BUCKETS, -(-n // BUCKET_ITEMS)), width[s]) for s, n in hist.items()], "size int, buckets int, width long")
    items = items.join(F.broadcast(sizes), "size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("buckets")).cast("int")).drop("buckets")
    sums = items.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    plan = stage(spark.createDataFrame(paged), "window-plan") if len(segments) else spark.createDataFrame([], "size int, page long, lo long, hi long, base long, window_start int")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")
    numbered = items.withColumn("k", F.row_number().over(own) - 1).join(F.broadcast(first), ["size", "bucket"]).withColumn("k", F.col("k") + F.col("first"))
    at = numbered.withColumn("page", F.expr("k div width")).join(plan, ["size", "page"]).where("k >= lo and k < hi")
    return at.select((F.col("base") + F.col("k") - F.col("lo")).alias("window_no"), "window_start", "doc_id", "piece_no", "token_start", "size")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Windows of ``capacity`` tokens filled with whole documents. No documents, no windows; a repeated ``doc_id`` with
    the same text is packed as often as it occurs."""
    return pack(stage(window_items(token_lengths(docs, vocabulary), capacity), "window-items"), capacity)


def window_checks(windows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What packed windows must hold, as one row: ``documents`` packed, windows ``overfull``, items that don't begin where
    the one before ends (``gaps``), documents ``divided`` though they fit or into pieces that aren't consecutive, and
    whether the windows are ``filled``: at most 1 % and one more of them than the tokens need."""
    order = Window.partitionBy("window_no").orderBy("window_start", "doc_id", "piece_no")
    before = F.coalesce(F.lag(F.col("window_start") + F.col("size")).over(order), F.lit(0))
    placed = windows.withColumn("gap", F.col("window_start") != before)
    by_window = placed.groupBy("window_no").agg(F.sum("size").alias("used"), F.count_if("gap").alias("gaps"))
    one = by_window.agg(F.count("*").alias("windows"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.count_if(F.col("used") > capacity).alias("overfull"), F.coalesce(F.sum("gaps"), F.lit(0)).alias("gaps"))
    by_doc = windows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("size").alias("used"), F.max(F.col("token_start") + F.col("size")).alias("end"), F.countDistinct("piece_no").alias("numbers"))
    wrong = (F.col("n") != F.ceil(F.col("used") / capacity)) | (F.col("end") != F.col("used")) | (F.col("numbers") != F.col("n"))
    two = by_doc.agg(F.count("*").alias("documents"), F.count_if(wrong).alias("divided"))
    filled = F.col("windows") <= F.ceil(F.col("tokens") / capacity) * 1.01 + 1
    return one.crossJoin(two).select("documents", "overfull", "gaps", "divided", filled.alias("filled"))
