"""Overlapping chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = ("\n\n", "\n", ". ", " ")


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Windows of at most ``size`` characters that end after the coarsest break in their second half, each beginning
    ``overlap`` characters (but at least one further on) before the end of the last."""
    start, n = 0, len(text)
    while True:
        end = n
        if n - start > size:
            at, stop = start + max(1, size // 2), start + size
            found = ((text.rfind(b, at, stop), b) for b in BREAKS)
            end = next((i + len(b) for i, b in found if i >= 0), stop)
        yield start, end
        if end >= n:
            return
        start = max(end - overlap, start + 1)


def check_sizes(size: int, overlap: int) -> None:
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError("the chunk size must be a positive integer")
    if isinstance(overlap, bool) or not isinstance(overlap, int) or not 0 <= overlap < size:
        raise ValueError("the overlap must be from 0 to the size less 1")


def chunks(docs: DataFrame, size: int, overlap: int, keys: list[str], text: str = "content") -> DataFrame:
    """(keys..., chunk_no, char_start, char_end, chunk) of every text; chunks are without outer white space, and the
    offsets are those of what is left. Blank texts and chunks give no row. ``keys`` are of type long."""
    check_sizes(size, overlap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, lo, hi, part = [], [], [], [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                for n, (s, e) in enumerate(spans(t, size, overlap)):
                    piece = t[s:e]
                    if kept := piece.strip():
                        s += len(piece) - len(piece.lstrip())
                        for to, v in ((row, i), (no, n), (lo, s), (hi, s + len(kept)), (part, kept)):
                            to.append(v)
            at = pa.array(row, pa.int64())
            own = [b.column(k).take(at) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(no, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(part, pa.string())], [*keys, "chunk_no", "char_start", "char_end", "chunk"])

    rows = docs.where(F.col(text).rlike(r"(?U)\S")).select(*[F.col(k).cast("long") for k in keys], F.col(text))
    fields = ", ".join([f"{k} long" for k in keys] + ["chunk_no int, char_start int, char_end int, chunk string"])
    return rows.mapInArrow(cut, fields)
