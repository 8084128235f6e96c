"""Problem 3: splitting oversized contents at natural boundaries: by packing a tree of the text's structure
(``tree_pieces``), or window by window at the coarsest separator (``window_pieces``), as ``p3_found`` fixes its cuts."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import contents, texts

LIMIT, OVERLAP = 1000, 120
SEPARATORS = ("\n\n", "\n", ". ", " ")
PIECE_FIELDS = "doc_pos long, piece_no long, char_start long, char_end long"


class Separators:
    """The places where a text may be cut, as sorted lists by kind of separator: blank lines, lines, sentences, words.

    A kind is listed only when some window asks for it, that is when no coarser kind has a place there, so words are
    looked up in oversized sentences only.
    """

    def __init__(self, text: str, separators: tuple[str, ...] = SEPARATORS):
        self.text, self.separators, self.levels = text, separators, [None] * len(separators)

    def ends(self, level: int) -> list[int]:
        if self.levels[level] is None:
            sep = self.separators[level]
            self.levels[level] = [m.start() + len(sep) for m in re.finditer(f"(?={re.escape(sep)})", self.text)]
        return self.levels[level]

    def last_end(self, level: int, start: int, stop: int) -> int | None:
        """The last end in ``stop`` or before of a separator that begins at ``start`` or after."""
        ends = self.ends(level)
        at = bisect_right(ends, stop) - 1
        return ends[at] if at >= 0 and ends[at] - len(self.separators[level]) >= start else None


def window_pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Consecutive pieces of at most ``limit`` characters, each ending after the last separator of the coarsest kind in
    the second half of its window. No tree is packed here. Pieces overlap by ``overlap`` characters; a text within the
    limit is one piece, an empty one none."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be under half the limit")
    known, out, start = Separators(text), [], 0
    while len(text) - start > limit:
        at = (known.last_end(k, start + limit // 2, start + limit) for k in range(len(known.separators)))
        end = next((e for e in at if e is not None), start + limit)
        out.append((start, end))
        start = end - overlap
    if text:
        out.append((start, len(text)))
    return out


_HEADING = re.compile(r"(#{1,6})\s+\S|<h([1-6])\b", re.I)
_ITEM = re.compile(r"(\s*)(?:[-*+•]|\d{1,3}[.)])\s+\S")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


class Node:
    __slots__ = ("start", "end", "children")

    def __init__(self, start: int, end: int, children: list[Node] | None = None):
        self.start, self.end, self.children = start, end, children or []


def _nest(spans: list[tuple[int, int, int]]) -> list[Node]:
    """Nodes of consecutive (depth, start, end) spans: a span takes the deeper ones after it as children, and ends with
    the last of them."""
    roots: list[Node] = []
    stack: list[tuple[int, Node]] = []
    last = 0

    def close(depth: int) -> None:
        while stack and stack[-1][0] >= depth:
            stack.pop()[1].end = last

    for depth, start, end in spans:
        close(depth)
        node = Node(start, end)
        if stack:
            up = stack[-1][1]
            if not up.children:  # its own text before the first child
                up.children.append(Node(up.start, start))
            up.children.append(node)
        else:
            roots.append(node)
        stack.append((depth, node))
        last = end
    close(-1)
    return roots


def structure_tree(text: str) -> Node:
    """Root over sections (by heading rank), over list items (by indent) and paragraphs, over sentences."""
    spans: list[tuple[int, int, int]] = []
    at = 0
    blank_before = True
    for line in text.splitlines(keepends=True):
        end = at + len(line)
        if m := _HEADING.match(line):
            spans.append((int(m[2] or len(m[1])), at, end))
        elif m := _ITEM.match(line):
            spans.append((10 + len(m[1].expandtabs(4)), at, end))
        elif spans and not blank_before and spans[-1][0] >= 10:
            spans[-1] = (spans[-1][0], spans[-1][1], end)
        else:
            spans.append((10, at, end))
        blank_before = not line.strip()
        if blank_before and len(spans) > 1 and spans[-1][1] == at:  # blank lines close the node before
            spans.pop()
            spans[-1] = (spans[-1][0], spans[-1][1], end)
        at = end
    return Node(0, len(text), _nest(spans))


def _split_leaf(node: Node, text: str, limit: int) -> list[tuple[int, int]]:
    cuts = [m.end() for m in _SENTENCE.finditer(text, node.start, node.end)] + [node.end]
    out, start = [], node.start
    for cut in cuts:
        while cut - start > limit:  # a sentence over the limit: words, then characters
            sp = text.rfind(" ", start + 1, start + limit)
            stop = sp + 1 if sp > start else start + limit
            out.append((start, stop))
            start = stop
        if cut > start:
            out.append((start, cut))
            start = cut
    return out


def tree_pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Pieces of a whole text along its structure: siblings of the tree are merged while they stay within ``limit`` -
    ``overlap``, and only nodes over that are descended into, so what is left of an oversized section is never merged
    with the next one; each piece but the first then begins ``overlap`` characters earlier. No piece is over the limit
    and their union is the text."""
    body = limit - overlap
    if body < 1 or overlap < 0:
        raise ValueError("overlap must be under the limit")
    done: list[tuple[int, int]] = []
    todo = [structure_tree(text)]
    while todo:  # in the order of the text; a run of small siblings stands in ``todo`` as one node without children
        node = todo.pop()
        if node.end - node.start <= body:
            done += [(node.start, node.end)] if node.end > node.start else []
        elif not node.children:
            done += [(n.start, n.end) for n in _runs([Node(s, e) for s, e in _split_leaf(node, text, body)], body)]
        else:
            todo += reversed(_runs(node.children, body))
    return [(max(0, s - overlap) if i else s, e) for i, (s, e) in enumerate(done)]


def _runs(nodes: list[Node], body: int) -> list[Node]:
    """Siblings in order, neighbours that fit together merged into one node; an oversized one stands by itself."""
    out: list[Node] = []
    for node in nodes:
        if out and not out[-1].children and node.end - out[-1].start <= body and out[-1].end - out[-1].start <= body:
            out[-1] = Node(out[-1].start, node.end)
        elif node.end - node.start <= body:
            out.append(Node(node.start, node.end))
        else:
            out.append(node)
    return out


def split(docs: DataFrame, how: Callable[[str, int, int], list[tuple[int, int]]] = window_pieces, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_pos, piece_no, char_start, char_end) for every content over ``limit`` characters.

    Null and blank contents and null keys are left out, a ``doc_pos`` counts once. Only the texts over the limit
    reach Python, whole, however long. Further columns of ``docs`` are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n, s, e) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for n, (s, e) in enumerate(how(t, limit, overlap))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_pos", "piece_no", "char_start", "char_end"])

    return texts(docs).where(F.length("content") > limit).mapInArrow(cut, PIECE_FIELDS)


def pieces_with_metadata(docs: DataFrame, how=tree_pieces, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces with their text and the document's ``metadata`` (of its latest arrival)."""
    whole = contents(docs, ("metadata",))
    return split(docs, how, limit, overlap).join(whole, "doc_pos").select(
        "doc_pos", "piece_no", "char_start", "char_end",
        F.expr("substring(content, cast(char_start + 1 as int), cast(char_end - char_start as int))").alias("piece"),
        "metadata",
    )
