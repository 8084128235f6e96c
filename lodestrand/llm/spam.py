"""Problem 9: pages of keywords, links, products or tags in place of sentences."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import blank
from lodestrand.session import stage

FUNCTION_WORDS = {
    "en": "the a an and of to for from by with is are was were be been it its this that which who as at on or has have had not no but than into between both when while where after although because under two their them he she they about more most than what how".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder von vom zu zur zum mit ist sind war wurde wird nach zwischen aus auf am im an als auch nicht noch kaum für über unter durch bei sich später heute".split(),
    "es": "el la los las un una unos unas de del y o que con por para en se es fue era son su sus al como más entre desde hasta cuando según sobre sin ya".split(),
    "fr": "le la les un une des de du et ou que qui dans par pour sur avec est fut était sont au aux ce cette son sa ses en à selon vers entre lors plus sans ne pas l d".split(),
}
#: By language: least share of function words in a unit taken for a sentence, where too little text is at hand to fit it.
SENTENCE_SHARE = {"en": 0.13, "de": 0.12, "es": 0.15, "fr": 0.13}
#: The shares are fitted on all pages labelled with the four languages: of the pages with half the median page's function words
#: or more, FIT_PART of the share that all but FIT_TAIL of their units of FIT_WORDS words reach. Fewer than FIT_UNITS units fit
#: nothing. Shares are counted in FIT_STEPS steps, and the median in USUAL_STEPS, so that few values are held.
FIT_TAIL, FIT_PART, FIT_WORDS, FIT_UNITS, FIT_STEPS, USUAL_STEPS = 0.01, 0.8, 8, 500, 1_000, 10_000
#: A page with a smaller share of function words of any known language is in none of them, or holds no sentences; which of
#: the two is told by the form of its lines: sentences that end as such, of FREE_WORDS words or more, FREE_SHORT of which
#: have up to three letters, and lines of code, which are CODE_SHARE of a program's.
UNKNOWN_SHARE, FREE_WORDS, FREE_SHORT, CODE_SHARE = 0.12, 6, 0.05, 0.6
LIST_SHARE = 0.5
REPEAT_SHARE = 1 / 3
LEAST_REPEATS = 4
LEAST_ITEMS = 5
LONGEST_PHRASE = 4
#: Share of lines that are copies of others, where one line fills REPEAT_SHARE of the words.
LINE_REPEAT_SHARE = 0.5
#: Separators by character outside links: items of so few characters hold no sentence, with function words or without.
SEPARATOR_DENSITY = 0.07

_WORDS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"[^\W_]+")
_LINK = re.compile(r"""<a\s[^<>]*>(?:(?!<a\s|</a>).)*</a>|!?\[[^\[\]\n]*\]\([^()\s]*\)|\(?(?:https?://|www\.)[^\s|,;<>)\]]+\)?|\([\w-]+(?:\.[\w-]+)*\.[a-z]{2,9}\)|(?<!\w)\#\w+|(?<!\w)tag:\S+""", re.I)
_LINK_SIGNS = ("http", "www.", "](", "<a ", "#", "tag:", "(")
#: Ends of units: lines, sentences, and links, which stand as \\0.
_UNIT = re.compile(r"[\n\0]+\s*|[.!?:][\"”)\]]*\s+")
#: No tabs, which stand for blanks in some texts.
_SEPARATORS = ",;|/·•#"
_ITEM_ENDS = ",;|/·•"
#: A row of a table of figures (number, figure and unit, single words) is no list of keywords within running text.
_RECORD = re.compile(r"\s*\d{3,4}\s*[|\t]\s*\d[\d.,]*\s+[^\W\d_]+\s*(?:[|\t]\s*[^\W\d_]*\s*)*$")


_END = re.compile(r"[.!?…](?=[\s\"”»)]|$)")
_CODE = re.compile(r"[{}=]|;\s*$|:\s*$|\w\([^)]*\)\s*$|->|::|^\s*(?:import|from|return|package|use)\s")


@dataclass
class Page:
    """What was measured of one text. Missing function words make ``list_share``; with it decide the shares of links, of the
    top word or phrase (``repeat_share``), of duplicate lines with ``top_line_share``, and the density of separators."""

    words: int = 0
    list_share: float = 0.0
    items: int = 0
    repeat_share: float = 0.0
    top_word_share: float = 0.0
    link_share: float = 0.0
    line_repeat_share: float = 0.0
    separator_density: float = 0.0
    function_share: float = 0.0
    top_line_share: float = 0.0
    separators: int = 0
    language: str = ""

    @property
    def spam(self) -> bool:
        listed = max(self.list_share, self.link_share) > LIST_SHARE and self.items >= LEAST_ITEMS
        parted = self.separator_density > SEPARATOR_DENSITY and self.separators >= LEAST_ITEMS
        lines = self.line_repeat_share > LINE_REPEAT_SHARE and self.top_line_share > REPEAT_SHARE
        return listed or parted or lines or self.repeat_share > REPEAT_SHARE


def language(counts: Counter[str]) -> str:
    """The language whose function words are most of a text; the column isn't relied upon, as it may be wrong."""
    return max(_WORDS, key=lambda k: sum(map(counts.__getitem__, counts.keys() & _WORDS[k])))


def repeat_share(words: list[str], counts: Counter[str], function: frozenset[str]) -> float:
    """Share of the words that the most repeated phrase of 1 to 4 words fills, if it occurs often enough. The phrase
    holds a content word; those of under 1/12 of all words can't be in a phrase that fills a third."""
    n = len(words)
    least = max(LEAST_REPEATS, n * REPEAT_SHARE / LONGEST_PHRASE)
    heavy = {w for w, c in counts.items() if c >= least and w not in function}
    if not heavy:
        return 0.0
    best = max(counts[w] for w in heavy)
    for k in range(2, LONGEST_PHRASE + 1):
        grams = Counter(zip(*(words[i:] for i in range(k))))
        for g, c in grams.items():
            if c >= LEAST_REPEATS and c * k > best and len(set(g)) == k and not heavy.isdisjoint(g):
                best = c * k
    return best / n


def _shared_ends(rows: list[tuple[str, ...]], function: frozenset[str], least: float) -> tuple[list[int], list[int]]:
    """By row: how many of its first, and of its last, words another row has too; 0 where they don't read as part of a
    sentence."""
    ends = []
    for step in (1, -1):
        turned = [row[::step] for row in rows]
        order, shared = sorted(range(len(rows)), key=turned.__getitem__), [0] * len(rows)
        for a, b in zip(order, order[1:]):
            x, y = turned[a], turned[b]
            same = next((i for i, (v, w) in enumerate(zip(x, y)) if v != w), min(len(x), len(y)))
            shared[a], shared[b] = max(shared[a], same), same
        ends.append([k if sum(map(function.__contains__, row[:k])) >= max(2, least * k) else 0 for row, k in zip(turned, shared)])
    return ends[0], ends[1]


def long_repeat_share(sentences: list[tuple[str, ...]], others: list[tuple[str, ...]], n: int, function: frozenset[str], least: float) -> float:
    """Share of ``n`` words that the most filling phrase of over 4 words takes within the units, if it occurs often enough;
    occurrences don't overlap. Where different sentences begin or end alike, in words that read as part of a sentence, a
    phrase isn't counted, as such repeats heed the sentences. Repeated 5-grams are extended word by word for as long as they repeat. The search ends
    once REPEAT_SHARE is exceeded, so above it the share is what was found until then."""
    rows = sentences + others
    k, best = LONGEST_PHRASE + 1, 0
    counts: Counter[tuple[str, ...]] = Counter()
    for row in rows:
        counts.update(zip(*(row[i:] for i in range(k))))
    grams: dict[tuple[str, ...], list[tuple[int, int]]] = {g: [] for g, c in counts.items() if c >= LEAST_REPEATS}
    if not grams:
        return 0.0
    for r, row in enumerate(rows):
        for i in range(len(row) - k + 1):
            if (at := grams.get(row[i : i + k])) is not None:
                at.append((r, i))
    opening, ending = _shared_ends(sentences, function, least)
    todo = [(k, at) for at in grams.values()]
    while todo and best <= n * REPEAT_SHARE:
        k, at = todo.pop()
        if all(i for _, i in at) and len({rows[r][i - 1] for r, i in at}) == 1:
            continue  # the phrase one word longer to the left is at the same places
        times, last, end = 0, -1, 0
        for r, i in at:
            if r < len(sentences) and (i + k <= opening[r] or i >= len(rows[r]) - ending[r]):
                continue
            if r != last or i >= end:
                times, last, end = times + 1, r, i + k
        if times >= LEAST_REPEATS:
            best = max(best, times * k)
        longer: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for r, i in at:
            if i + k < len(rows[r]):
                longer[rows[r][i + k]].append((r, i))
        todo += [(k + 1, x) for x in longer.values() if len(x) >= LEAST_REPEATS]
    return best / n


def _units(low: str) -> tuple[list[str], str, list[tuple[str, list[str]]]]:
    """The links of a lower-cased text, the text with \\0 for each of them, and its units outside them with their words."""
    links: list[str] = []

    def cut(m: re.Match) -> str:
        links.append(m[0])
        return "\0"

    outside = _LINK.sub(cut, low) if any(x in low for x in _LINK_SIGNS) else low
    return links, outside, [(unit, _WORD.findall(unit)) for unit in _UNIT.split(outside)]


def free_running(text: str) -> int:
    """Characters, white space left out, of what is no list by its form, in whatever language: sentences that begin with
    no small letter, end as sentences and hold some short words and few commas; or all of a program."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if len(lines) >= LEAST_ITEMS and sum(bool(_CODE.search(x)) for x in lines) >= CODE_SHARE * len(lines):
        return _solid(text)
    total = 0
    for line in lines:
        start = 0
        for m in _END.finditer(line):
            part, start = line[start : m.end()], m.end()
            own = _WORD.findall(part)
            if len(own) >= FREE_WORDS and not own[0][0].islower() and 4 * sum(map(part.count, _ITEM_ENDS)) <= len(own):
                if sum(len(w) <= 3 and w.isalpha() for w in own) >= FREE_SHORT * len(own):
                    total += _solid(part)
    return total


def measure(text: str, shares: dict[str, float] = SENTENCE_SHARE) -> Page:
    """The shares of one text, read whole; ``shares`` has the least share of function words of a sentence by language. A
    page most of which reads as sentences by its form, or is code, though it has hardly a function word, is of a language
    that isn't known: that part of it counts as no list."""
    low = text.lower()
    links, outside, units = _units(low)
    words = _WORD.findall(low) if links else list(chain.from_iterable(own for _, own in units))
    page = Page(words=len(words))
    if not words:
        return page
    counts = Counter(words)
    spoken = page.language = language(counts)
    function, least = _WORDS[spoken], shares[spoken]
    page.function_share = sum(map(counts.__getitem__, counts.keys() & function)) / len(words)
    page.repeat_share = repeat_share(words, counts, function)
    page.top_word_share = max(map(counts.__getitem__, counts.keys() - function), default=0) / len(words)
    lines = Counter(x.strip() for x in low.split("\n") if x and not x.isspace())
    page.line_repeat_share = 1 - len(lines) / lines.total()
    if page.line_repeat_share > LINE_REPEAT_SHARE:
        page.top_line_share = max((c * len(_WORD.findall(x)) for x, c in lines.items() if c >= LEAST_REPEATS), default=0) / len(words)
    total = _solid(low)
    page.separators = sum(map(outside.count, _SEPARATORS))
    page.separator_density = page.separators / total
    linked = sum(map(_solid, links))
    page.link_share = linked / total
    listed, items = 0, len(links)
    tabled, cells = 0, 0
    sentences: dict[tuple[str, ...], None] = {}
    others: list[tuple[str, ...]] = []
    for unit, own in units:
        loose = sum(map(function.__contains__, own)) < max(2, least * len(own))
        if len(own) > LONGEST_PHRASE:
            if loose:
                others.append(tuple(own))
            else:
                sentences[tuple(own)] = None
        if own and loose:
            size, parts = _solid(unit), 1 + sum(map(unit.count, _ITEM_ENDS)) + len(own) // 4
            if _RECORD.match(unit):
                tabled, cells = tabled + size, cells + parts
            else:
                listed, items = listed + size, items + parts
    if tabled / total > LIST_SHARE:
        listed, items = listed + tabled, items + cells
    if page.function_share < UNKNOWN_SHARE and 2 * (running := free_running(text)) > total:
        page.language, listed = "unknown", max(0, listed - running)
    # A sentence that returns as a whole counts once: repeats of it heed the sentences, unless they are the lines.
    page.repeat_share = max(page.repeat_share, long_repeat_share(list(sentences), others, len(words), function, least))
    page.list_share = (listed + linked) / total
    page.items = items
    return page


def _solid(text: str) -> int:
    """Characters but for white space."""
    return sum(map(len, text.split()))


def _page_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By page whose words and label tell the same language: its share of function words, and that of each longer unit."""
    for b in batches:
        out: list[list] = [[], [], [], []]
        for i, text, label in zip(*(c.to_pylist() for c in b.columns)):
            own = [w for _, w in _units(text.lower())[2]]
            counts = Counter(chain.from_iterable(own))
            if counts and (spoken := language(counts)) == label:
                share = lambda ws: sum(map(_WORDS[spoken].__contains__, ws)) / len(ws)
                every = sum(map(counts.__getitem__, counts.keys() & _WORDS[spoken])) / counts.total()
                for to, v in zip(out, (i, spoken, every, [share(ws) for ws in own if len(ws) >= FIT_WORDS])):
                    to.append(v)
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "language", "share", "units"])


def _least_share(units: np.ndarray) -> float:
    """From the number of units at each step of the share of function words: the least share of a sentence."""
    return int(np.searchsorted(np.cumsum(units), FIT_TAIL * units.sum())) / FIT_STEPS * FIT_PART


def fit_shares(docs: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(shares, errors) by language: the least share of function words of a sentence, fitted on all pages labelled with one
    of the four languages, and the part of the units that falls under such a share fitted on the other half of the pages.
    A page counts if its words tell the same language: lists in one language that look like another would lower its tail.
    Languages with too little text keep SENTENCE_SHARE and have no error."""
    label = F.lower(F.trim("lang")) if "lang" in docs.columns else F.lit("en")
    rows = docs.where(F.col("doc_id").isNotNull() & ~blank(F.col("text"))).where(label.isin(*FUNCTION_WORDS)).select(F.col("doc_id").cast("long"), "text", label.alias("label"))
    shares, errors = dict(SENTENCE_SHARE), {}
    told = stage(rows.mapInArrow(_page_units, "doc_id long, language string, share double, units array<double>"), "page-units")
    usual = told.groupBy("language").agg(F.percentile(F.floor(F.col("share") * USUAL_STEPS) / USUAL_STEPS, 0.5).alias("usual"))
    running = told.join(F.broadcast(usual), "language").where(F.col("share") >= F.col("usual") / 2)
    unit = running.select("language", (F.pmod("doc_id", F.lit(2)) == 0).alias("fit"), F.explode("units").alias("u"))
    counts = unit.groupBy("language", "fit", F.floor(F.col("u") * FIT_STEPS).cast("int").alias("at")).agg(F.count("*").alias("n")).collect()
    for spoken in FUNCTION_WORDS:
        half = {k: np.zeros(FIT_STEPS + 1, np.int64) for k in (True, False)}
        for r in counts:
            if r["language"] == spoken:
                half[r["fit"]][r["at"]] += r["n"]
        every = half[True] + half[False]
        if every.sum() >= FIT_UNITS:
            shares[spoken] = _least_share(every)
            under = [held[: int(_least_share(fit) * FIT_STEPS)].sum() for fit, held in (half.values(), reversed(half.values()))]
            errors[spoken] = float(sum(under) / every.sum())
    return shares, errors


def scan(docs: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Every document with its measures and ``spam``. Null and blank texts are no spam and give no row, nor do null ids.
    ``shares`` by language are fitted on all of ``docs`` where they aren't given."""
    names = ["words", "list_share", "items", "repeat_share", "top_word_share", "link_share", "line_repeat_share", "separator_density", "function_share"]
    shares = fit_shares(docs)[0] if shares is None else SENTENCE_SHARE | shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = [measure(t, shares) for t in b.column(1).to_pylist()]
            kinds = [pa.int64(), pa.float64(), pa.int64(), *[pa.float64()] * 6]
            cols = [pa.array([getattr(p, k) for p in pages], kind) for k, kind in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([p.spam for p in pages], pa.bool_())], ["doc_id", *names, "spam"])

    rows = docs.where(F.col("doc_id").isNotNull() & ~blank(F.col("text"))).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, words long, list_share double, items long, repeat_share double, top_word_share double, link_share double, line_repeat_share double, separator_density double, function_share double, spam boolean")
