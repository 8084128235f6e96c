"""The pool of one query at a time: reranking, fusion and diversity over the few units that its lists name.

Rows of a query stand together, in order, in Arrow batches; what is worked out for one needs nothing of another."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions import vocab
from lodestrand.operators import fusion
from lodestrand.session import parts

#: What a row tells of: the query itself, a variant, a unit, a place in a list.
QUERY, VARIANT, UNIT, PLACE = range(4)
#: Columns of the rows; ``n`` is the query's k, a variant's pool or a place's rank, ``words`` are tokens between blanks.
FIELDS = {"part": "int", "variant_no": "int", "kind": "int", "unit": "long", "n": "int", "key": "string", "words": "string", "risk": "double", "vec": "array<double>"}


def told(rows: DataFrame, part: int, **cols: str) -> DataFrame:
    """``rows`` (query_id ...) as rows of FIELDS of the kind ``part``."""
    given = {"part": F.lit(part)} | {k: F.col(v) for k, v in cols.items()}
    return rows.select("query_id", *[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in FIELDS.items()])


def rounded(x: float, places: int = 9) -> int:
    return math.floor(x * 10**places + 0.5)


@dataclass
class Unit:
    key: str
    words: str
    risk: float
    vec: np.ndarray | None
    toks: list[str] = field(init=False)
    counts: Counter = field(init=False)

    def __post_init__(self) -> None:
        self.toks = self.words.split(" ") if self.words else []
        self.counts = Counter(self.toks)


@dataclass
class Asked:
    """One query with its variants (pool, tokens, vector), units and lists."""

    query: list[str] = field(default_factory=list)
    k: int = 0
    variants: dict[int, tuple[int, list[str], np.ndarray | None]] = field(default_factory=dict)
    units: dict[int, Unit] = field(default_factory=dict)
    lists: dict[tuple[int, int], list[int]] = field(default_factory=dict)  #: units in order, by variant and kind

    @property
    def pool(self) -> int:
        return max((v[0] for v in self.variants.values()), default=0)


def relevance(q: list[str], d: Unit) -> float:
    """As ``text.relevance`` of the tokens, with the unit's risk."""
    if not q or not d.toks:
        return 0.0
    n = sum(min(c, d.counts[t]) for t, c in Counter(q).items())
    bonus = 0.15 if " ".join(q[:3]) in d.words else 0.0
    return min(1.0, n / len(q) * 0.85 + n / min(len(d.toks), 200) * 0.15 + bonus) * (1.0 - d.risk * 0.5)


def evidence(q: list[str], s: Unit, numbers: bool, terms: int) -> float:
    """The relevance of a sentence and its reward, 0.25 at most, for the query's words, numbers and capitalised ``terms``."""
    bonus = 0.0
    if q and s.toks:
        words = set(q)
        bonus = min(0.25, sum(t in s.counts for t in words) / len(words) * 0.15 + (0.10 if numbers else 0.0) + min(0.15, terms * 0.05))
    return relevance(q, s) + bonus


def own_lists(a: Asked) -> None:
    """Lists of all of the query's own units by cosine and by BM25 of their own statistics, cut at each variant's pool."""
    ids, n = list(a.units), len(a.units)
    if not n:
        return
    df = Counter(t for u in a.units.values() for t in u.counts)
    avg_len = max(sum(len(u.toks) for u in a.units.values()) / n, 1e-9)
    vecs = np.stack([u.vec for u in a.units.values()])
    for v, (pool, toks, vec) in a.variants.items():
        if vec is not None and vec.any():
            near = sorted((-rounded(s), u) for s, u in zip((vecs @ vec).tolist(), ids, strict=True))
            a.lists[v, 0] = [u for _, u in near[:pool]]
        asked = [(t, c, math.log(1.0 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t, c in Counter(toks).items() if t in df]
        found = []
        for i, u in a.units.items():
            norm = (1 - vocab.B) + vocab.B * len(u.toks) / avg_len
            s = sum(c * (idf * (u.counts[t] * (vocab.K1 + 1)) / (u.counts[t] + vocab.K1 * norm)) for t, c, idf in asked if t in u.counts)
            if s > 0:
                found.append((-rounded(s), i))
        a.lists[v, 1] = [u for _, u in sorted(found)[:pool]]


def fused(a: Asked) -> list[tuple[int, float]]:
    """(unit, score) of the query's pool in order: the dense lists reranked by words, all fused by what is the same
    document, whose first arrival stands for it."""
    sums: dict[str, float] = {}
    first: dict[str, int] = {}
    for (v, kind), units in sorted(a.lists.items()):
        if kind == 0:
            toks, n = a.variants[v][1], len(units)
            weight = vocab.RERANK_WEIGHT
            blend = [(1 - weight) * (1.0 - i / n) + weight * relevance(toks, a.units[u]) for i, u in enumerate(units)]
            units = [units[i] for i in sorted(range(n), key=lambda i: (-rounded(blend[i]), i))]
        for rank, u in enumerate(units, 1):
            key = a.units[u].key
            first.setdefault(key, u)
            sums[key] = sums.get(key, 0.0) + 1.0 / (vocab.RRF_K + rank)
    order = sorted(sums, key=lambda key: -rounded(sums[key]))  # stable: equal ones by arrival
    return [(first[key], sums[key]) for key in order[: a.pool]]


def pooled(a: Asked) -> Iterator[tuple]:
    for rank, (unit, score) in enumerate(fused(a), 1):
        yield unit, rank, score


def diverse(a: Asked) -> Iterator[tuple]:
    pool = [u for u, _ in fused(a)]
    scores = [relevance(a.query, a.units[u]) for u in pool]
    picked = fusion.spread_out(scores, list(range(1, len(pool) + 1)), [frozenset(a.units[u].counts) for u in pool], a.k)
    for n, i in enumerate(picked, 1):
        yield pool[i], n, scores[i]


def by_query(rows: DataFrame, each: Callable[[Asked], Iterator[tuple]], names: tuple[str, str], own: bool = False) -> DataFrame:
    """(query_id, unit, names...) of what ``each`` gives for a query; ``rows`` as of ``told``. ``own``: the lists are made
    here, of the query's own units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, a = None, Asked()

        def done() -> None:
            if now is not None:
                if own:
                    own_lists(a)
                out.extend((now, *x) for x in each(a))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["query_id", "unit", *names])

        for b in batches:
            vecs = b.column("vec")
            ends = np.cumsum(vecs.value_lengths().fill_null(0).to_numpy()).tolist() if b.num_rows else []
            flat, none = vecs.flatten().to_numpy(zero_copy_only=False), vecs.is_null().to_pylist()
            start = 0
            for i, row in enumerate(zip(*[b.column(c).to_pylist() for c in ("query_id", "part", "variant_no", "kind", "unit", "n", "key", "words", "risk")], strict=True)):
                query, part, variant, kind, unit, n, key, words, risk = row
                vec, start = None if none[i] else flat[start : ends[i]], ends[i]
                if query != now:
                    done()
                    now, a = query, Asked()
                if part == QUERY:
                    a.query, a.k = words.split(" ") if words else [], n
                elif part == VARIANT:
                    a.variants[variant] = n, words.split(" ") if words else [], vec
                elif part == UNIT:
                    a.units[unit] = Unit(key, words, risk, vec)
                else:
                    a.lists.setdefault((variant, kind), []).append(unit)
            if len(out) >= 10_000:
                yield batch()
        done()
        yield batch()

    ordered = rows.repartition(parts(rows.sparkSession), "query_id").sortWithinPartitions("query_id", "part", "variant_no", "kind", "n", "unit")
    return ordered.mapInArrow(run, f"query_id long, unit long, {names[0]} int, {names[1]} double")
