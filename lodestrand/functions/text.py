"""Text as column expressions, all evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import vocab


#: A letter, digit or underscore of any script, and the two ends of a word.
_W = r"[\p{L}\p{N}_]"
BEGINS, ENDS = rf"(?<!{_W})", rf"(?!{_W})"


def lit_list(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def runs(c: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, stop words too."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


_TOKEN = "(?<![a-z0-9])(?!(?:" + "|".join(vocab.STOP_WORDS) + ")(?![a-z0-9]))[a-z0-9]+"


def tokens(c: Column) -> Column:
    """The runs but for the stop words."""
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once for the row however often ``body`` uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets: what they share, each as often as the rarer has it."""

    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    def shared(a: Column, b: Column) -> Column:
        each = F.transform(F.array_intersect(a, b), lambda x: F.least(count(a, x), count(b, x)))
        return F.aggregate(each, F.lit(0), lambda s, n: s + n)

    return let(a, lambda x: let(b, lambda y: shared(x, y)))


def _injected(c: Column, low: Column) -> list[Column]:
    """Whether each injection pattern matches; a pattern is only tried on a text that has one of its marks."""
    found = zip(vocab.INJECTION_PATTERNS, vocab.INJECTION_MARKS, strict=True)
    return [reduce(or_, [low.contains(m) for m in marks]) & c.rlike("(?i)" + p) for p, marks in found]


def injections(c: Column) -> Column:
    """Numbers (from 1) of the injection patterns that match."""
    text = F.coalesce(c, F.lit(""))
    hits = let(F.lower(text), lambda low: F.array(*[F.when(x, F.lit(i)) for i, x in enumerate(_injected(text, low), 1)]))
    return F.filter(hits, lambda x: x.isNotNull())


def suspicious(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return let(F.lower(text), lambda low: reduce(or_, _injected(text, low)))


def risk(c: Column) -> Column:
    return F.least(F.lit(1.0), F.size(injections(c)) * 0.25)


def injection_report(c: Column) -> Column:
    """(suspicious, risk, patterns) of one pass over the patterns."""

    def told(hits: Column) -> Column:
        return F.struct((F.size(hits) > 0).alias("suspicious"), F.least(F.lit(1.0), F.size(hits) * 0.25).alias("risk"), hits.alias("patterns"))

    return let(injections(c), told)


def safe_lines(c: Column) -> Column:
    """Nothing of a suspicious text, else its lines that aren't suspicious by themselves."""
    lines = F.filter(F.split(c, r"\R"), lambda x: ~suspicious(x))
    return F.when(suspicious(c), F.lit("")).otherwise(strip(F.array_join(lines, "\n")))


def secrets(c: Column) -> Column:
    """Labels of the kinds of keys and secrets that a text holds."""
    hits = [F.when(F.coalesce(c, F.lit("")).rlike(p), F.lit(k)) for k, p in vocab.SECRET_PATTERNS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def relevance(q: Column, d: Column, risk_of: Column | None = None) -> Column:
    """Lexical relevance of tokens ``d`` to tokens ``q``, from 0 to 1; a suspicious text loses up to half."""

    def score(q: Column, d: Column) -> Column:
        phrase = F.array_join(F.slice(q, 1, 3), " ")
        bonus = F.when(F.array_join(d, " ").contains(phrase), 0.15).otherwise(0.0)
        raw = let(overlap(q, d), lambda n: F.least(F.lit(1.0), n / F.size(q) * 0.85 + n / F.least(F.size(d), F.lit(200)) * 0.15 + bonus))
        if risk_of is not None:
            raw = raw * (F.lit(1.0) - risk_of * 0.5)
        return F.when((F.size(q) > 0) & (F.size(d) > 0), raw).otherwise(0.0)

    return let(q, lambda x: let(d, lambda y: score(x, y)))


def rounded(c: Column, places: int = 6) -> Column:
    """A double rounded as doubles are in SQL: the nearest whole number of its multiple, halves away from zero. F.round goes
    by the decimal digits, so what stands for 0.5146875 and is less times a million is rounded up by it."""
    return F.round(c * 10.0**places, 0) / 10.0**places


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays, as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def normalize_answer(c: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"{BEGINS}(a|an|the){ENDS}", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[^a-z0-9\s]", " "), r"(?U)\s+", " "))


def token_f1(p: Column, r: Column) -> Column:
    """F1 of the words of two normalized answers, as multisets; two empty ones agree."""
    pw, rw = (F.filter(F.split(x, " "), lambda w: w != "") for x in (p, r))

    def score(a: Column, b: Column, same: Column) -> Column:
        f1 = F.lit(2.0) * (same / a) * (same / b) / (same / a + same / b)
        return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0) | (same == 0), 0.0).otherwise(f1)

    return let(pw, lambda x: let(rw, lambda y: let(overlap(x, y), lambda n: score(F.size(x), F.size(y), n))))


def short_answer(c: Column) -> Column:
    return strip(F.get(F.split(strip(F.coalesce(c, F.lit(""))), r"\R"), F.lit(0)))


def truncate(c: Column, limit: int | Column, marker: str = vocab.TRUNCATED) -> Column:
    """At most ``limit`` characters: cut at the last blank, the marker included; a limit within the marker cuts hard."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(c, F.lit(1), n - len(marker))
    word = F.rtrim(F.regexp_replace(head, r" [^ ]*$", ""))
    kept = F.when(F.length(word) > 0, word).otherwise(F.rtrim(head))
    return (
        F.when(n <= 0, F.lit(""))
        .when(F.length(c) <= n, c)
        .when(n <= len(marker), F.substring(c, F.lit(1), n))
        .otherwise(F.concat(kept, F.lit(marker)))
    )


def label(c: Column, most: int = 160) -> Column:
    """Untrusted metadata as a single-line label: no control characters, delimiters replaced, suspicious ones redacted."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0A-\x1F]", ""), r"(?U)\s+", " "))

    def shown(p: Column) -> Column:
        safe = F.substring(F.translate(p, "[]{}|<>", "()()/()"), 1, most)
        return F.when(p == "", "unknown-source").when(suspicious(p), "redacted-untrusted-metadata").otherwise(safe)

    return let(plain, shown)


def first_truthy(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def csv_safe(c: Column) -> Column:
    """A text that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(F.regexp_replace(c, r"(?U)^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def abstention_form(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " "), r"\.+$", "")


def is_evidence_abstention(c: Column) -> Column:
    return abstention_form(c) == vocab.EVIDENCE_ABSTENTION.lower().rstrip(".")


def is_abstention(c: Column) -> Column:
    return abstention_form(c).isin(*[x.lower().rstrip(".") for x in (vocab.EVIDENCE_ABSTENTION, vocab.STATIC_ABSTENTION)])


def has_word(c: Column, words: list[str]) -> Column:
    """Any of ``words`` in the lower-cased text, no letter or digit next to it."""
    return c.rlike(r"(?<![a-z0-9])(?:" + "|".join(re.escape(w).replace(r"\-", "-") for w in words) + r")(?![a-z0-9])")


def has_text(c: Column, parts: list[str]) -> Column:
    return F.exists(lit_list(parts), lambda p: c.contains(p))


_CAPITAL = r"[A-Z][a-zA-Z0-9]+"


def entity_spans(c: Column) -> Column:
    """Capitalised spans of up to five words and numbers of 3 or 4 digits, without question words, the first five."""
    spans = F.regexp_extract_all(c, F.lit(rf"(?U){BEGINS}(?:{_CAPITAL}(?:\s+{_CAPITAL}){{0,4}}|\d{{3,4}}){ENDS}"), F.lit(0))
    asked = lit_list("what when where which who why how".split())
    return F.slice(F.array_distinct(F.filter(spans, lambda s: ~F.array_contains(asked, F.lower(s)))), 1, 5)


def fact_markers(c: Column) -> Column:
    """Numbers and capitalised spans that a context should bear out, by length and then by lower-cased text."""
    numbers = F.regexp_extract_all(c, F.lit(rf"(?U){BEGINS}\d{{1,4}}(?:[.,:]\d+)?(?:%(?={_W})|{ENDS})"), F.lit(0))
    word = rf"(?:{_CAPITAL}|[A-Z]{{2,}})"
    spans = F.regexp_extract_all(c, F.lit(rf"(?U){BEGINS}{word}(?:\s+{word}){{0,4}}{ENDS}"), F.lit(0))
    filler = lit_list(vocab.MARKER_FILLER)
    names = F.transform(spans, lambda s: F.array_join(F.filter(F.split(s, r"(?U)\s+"), lambda w: ~F.array_contains(filler, w)), " "))
    names = F.filter(names, lambda s: (s != "") & ~F.array_contains(lit_list(vocab.STOP_WORDS), F.lower(s)))
    keyed = F.transform(F.array_distinct(F.concat(numbers, names)), lambda s: F.struct(F.length(s).alias("n"), F.lower(s).alias("l"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def evidence_sentences(c: Column) -> Column:
    """Sentences of the safe lines: broken after . ! ? before a capital or digit, three characters at least."""

    def cut(safe: Column) -> Column:
        parts = F.flatten(F.transform(F.split(safe, "\n+"), lambda b: F.split(strip(b), r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])")))
        kept = F.filter(F.transform(parts, strip), lambda p: F.length(p) >= 3)
        return F.when(safe == "", F.array().cast("array<string>")).otherwise(let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(safe))))

    return let(safe_lines(c), cut)


def sentences(c: Column) -> Column:
    """Sentences for grounding: broken after . ! ? and at line breaks."""
    return F.filter(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+|\n+"), strip), lambda p: p != "")


def covered(query: Column, sentence: Column) -> tuple[Column, Column]:
    """Whether query and sentence both have a number, and how many capitalised terms of the query the sentence holds."""
    number = rf"(?U){BEGINS}\d{{2,4}}{ENDS}"
    terms = F.regexp_extract_all(query, F.lit(rf"{BEGINS}{_CAPITAL}{ENDS}"), F.lit(0))
    hits = let(F.lower(sentence), lambda low: F.size(F.filter(terms, lambda t: low.contains(F.lower(t)))))
    return query.rlike(number) & sentence.rlike(number), hits
