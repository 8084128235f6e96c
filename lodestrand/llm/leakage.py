"""Problem 8: evaluation passages in training text, by n-gram seeds and local alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import blank
from lodestrand.session import spread_join, stage

SEED_WORDS, RUN_WORDS = 5, 13
MATCH, MISS, GAP = 2, -1, -1
#: Bits of the filter that documents are read through, for each seed and at most, and the bits a seed sets. More seeds
#: than there is room for make it let more through.
SEED_BITS, MOST_BITS, PLACES = 64, 1 << 28, 6
KNOWN_WORDS = 1 << 20

_WORD = re.compile(r"[^\W_]+")
FIELDS = "doc_id long, item_id long, score int, run int, item_words int, covered double"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits of any script, lower-cased."""
    return _WORD.findall(text.lower())


class _Words(dict):
    """Hashes of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_known = _Words()


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` of the word hashes (uint64), in order."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total = total * _STEP + hashes[i : len(hashes) - n + 1 + i]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An item's words, their number, the length of its seeds and their hashes; nothing of an item without a word."""
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            own = words(text)
            if own:
                n = min(SEED_WORDS, len(own))
                grams = np.unique(gram_hashes(np.array([_known[w] for w in own], np.uint64), n)).view(np.int64)
                for to, v in zip(out, (item_id, " ".join(own), len(own), n, grams)):
                    to.append(v)
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["item_id", "item", "size", "n", "seeds"])


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, item, size, n, seeds): the words of each item, a blank between, and the hashes of its word 5-grams; an
    item of fewer words is one gram. Items with null id or without a word don't count; of rows with one id the greatest
    text holds."""
    once = items.where(F.col("item_id").isNotNull() & ~blank(F.col("text"))).groupBy("item_id").agg(F.max("text").alias("text"))
    return once.select(F.col("item_id").cast("long"), "text").mapInArrow(_seeds, "item_id long, item string, size int, n int, seeds array<long>")


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of all ``seeds`` (seed), as bytes: SEED_BITS bits for each, MOST_BITS at most, which bounds what
    comes to the driver and goes to the executors. It lets every seed through, and some others."""
    bits = 1 << 16
    while bits < min(MOST_BITS, seeds.count() * SEED_BITS):
        bits *= 2
    places = F.explode(F.array(*[F.shiftrightunsigned("seed", 7 * i).bitwiseAND(F.lit(bits - 1).cast("long")) for i in range(PLACES)]))
    slots = seeds.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy()
    return out.view(np.uint8)


def seed_hits(docs: DataFrame, filter_: np.ndarray, sizes: list[int]) -> DataFrame:
    """(doc_id, line, hits) of every document that holds a gram which the filter lets through: its words, one blank
    between, and the hashes of those grams. One pass over whole texts, however many items there are; nothing is
    shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = len(table) * 8

        def passing(grams: np.ndarray) -> np.ndarray:
            for i in range(PLACES):  # each place is looked up for what the last ones let through
                place = (grams >> np.uint64(7 * i)) & np.uint64(bits - 1)
                grams = grams[((table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]
            return grams

        for b in batches:
            ids, lines, hits = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = words(text)
                hashes = np.fromiter(map(_known.__getitem__, own), np.uint64, len(own))
                found = np.unique(np.concatenate([passing(gram_hashes(hashes, n)) for n in sizes]))
                if len(found):
                    ids.append(doc_id)
                    lines.append(" ".join(own))
                    hits.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string()), pa.array(hits, pa.list_(pa.int64()))], ["doc_id", "line", "hits"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(scan, "doc_id long, line string, hits array<long>")


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int]:
    """(score, run): the best Smith-Waterman score of two rows of word numbers, and their longest common run."""
    at = np.arange(len(doc) + 1)
    h, runs, score, run = np.zeros(len(doc) + 1, np.int64), np.zeros(len(doc) + 1, np.int64), 0, 0
    for x in item:
        same = doc == x
        t = np.maximum(h + GAP, 0)
        t[1:] = np.maximum(t[1:], h[:-1] + np.where(same, MATCH, MISS))
        h = np.maximum.accumulate(t - GAP * at) + GAP * at
        runs[1:] = np.where(same, runs[:-1] + 1, 0)
        score, run = max(score, int(h.max())), max(run, int(runs.max()))
    return score, run


def _aligned(least_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, last, doc_words = [], None, []
            for doc_id, line, item_id, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "line", "item_id", "item"))):
                if doc_id != last:
                    last, doc_words = doc_id, line.split()
                number: dict[str, int] = {}
                coded = np.array([number.setdefault(w, len(number)) for w in item.split()])
                doc = np.array([number.get(w, -1) for w in doc_words])
                size = len(coded)
                held = np.zeros(len(number) + 1, bool)
                held[doc] = True
                held[-1] = False
                least = MATCH * min(RUN_WORDS, least_share * size)
                if MATCH * held[coded].sum() < least:
                    continue  # no alignment scores more than all words in common
                score, longest = align(coded, doc)
                if score >= least:
                    out.append((doc_id, item_id, score, longest, size, score / (MATCH * size)))
            cols = list(zip(*out)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "score", "run", "item_words", "covered"])

    return run


def alignments(docs: DataFrame, items: DataFrame, least_share: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, run, item_words, covered) of documents and the items aligned with them.

    ``score`` is the local alignment's over words, ``covered`` its share of the item's own, ``run`` the longest run of
    words in common. Rows score as much as 13 words in a row, or ``least_share`` of the item. A document that holds 13
    consecutive words of an item, or all of a shorter one, is never missed. Every word 5-gram of an item is a seed, however
    many documents hold it; a document without any of them in common isn't aligned. Documents with null id or text and items
    without a word give no row; whole texts are read, markup included. With no items the result is empty.

    Documents are read once, through a filter of all seeds; what passes is joined with the items by the seeds' hashes, and
    every pair of document and item is aligned. Seeds and items that a third of all documents hold are joined in parts.
    """
    known = stage(item_seeds(items), "item-seeds")
    seeds = stage(known.select("item_id", F.explode("seeds").alias("seed")), "seeds")
    sizes = [r["n"] for r in known.select("n").distinct().collect()]  # SEED_WORDS numbers at most
    if not sizes:
        return docs.sparkSession.createDataFrame([], FIELDS)
    hits = stage(seed_hits(docs, seed_filter(seeds.select("seed").distinct()), sizes), "seed-hits")
    met = stage(hits.select("doc_id", F.explode("hits").alias("seed")), "hits-by-seed")
    pairs = stage(spread_join(met, seeds, ["seed"]).select("doc_id", "item_id").distinct(), "documents-and-items")
    pairs = spread_join(pairs, known.select("item_id", "item"), ["item_id"])
    rows = pairs.join(hits.select("doc_id", "line"), "doc_id").select("doc_id", "line", "item_id", "item")
    return rows.mapInArrow(_aligned(least_share), FIELDS)


def exact_leaks(aligned: DataFrame) -> DataFrame:
    """The alignments that hold 13 consecutive words of the item, or all words of a shorter one."""
    return aligned.where(F.col("run") >= F.least(F.col("item_words"), F.lit(RUN_WORDS))).select("doc_id", "item_id")
