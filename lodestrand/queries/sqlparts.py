"""Pieces of SQL that the queries' oracles are put together from."""

from __future__ import annotations

from lodestrand.functions import vocab as V

WS = r"[\s\x0b\x{85}\pZ]"


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) or x is None else str(x) for x in r) + ")" for r in rows) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def runs(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def tokens(x: str) -> str:
    return f"list_filter({runs(x)}, lambda t: NOT list_contains({listed(V.STOP_WORDS)}, t))"


def suspicious(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted('(?i)' + p)})" for p in V.INJECTION_PATTERNS) + ")"


def matched(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, {quoted('(?i)' + p)}) THEN {i} END" for i, p in enumerate(V.INJECTION_PATTERNS, 1)) + "], lambda i: i IS NOT NULL)"


def overlap(a: str, b: str) -> str:
    count = lambda xs: f"len(list_filter({xs}, lambda y: y = x))"
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least({count(a)}, {count(b)}))), 0)"


def relevance(q: str, d: str, risk: str = "0") -> str:
    o = overlap(q, d)
    return (
        f"CASE WHEN len({q}) > 0 AND len({d}) > 0 THEN least(1.0, {o}::DOUBLE / len({q}) * 0.85 + {o}::DOUBLE / least(len({d}), 200) * 0.15 "
        f"+ CASE WHEN contains(array_to_string({d}, ' '), array_to_string({q}[1:3], ' ')) THEN 0.15 ELSE 0.0 END)::DOUBLE * (1 - 0.5 * {risk}) ELSE 0.0 END"
    )


def normalize_answer(x: str) -> str:
    article = lambda y: f"regexp_replace({y}, '(^|[^\\pL\\pN_])(a|an|the)($|[^\\pL\\pN_])', '\\1 \\3', 'g')"
    kept = f"regexp_replace({article(article(f'lower(coalesce({x}, {chr(39) * 2}))'))}, '[^a-z0-9\\s\\x0b\\x{{85}}\\pZ]', ' ', 'g')"
    return squeeze(kept)


def has_word(x: str, words: list[str]) -> str:
    import re

    return f"regexp_matches({x}, {quoted('(^|[^a-z0-9])(?:' + '|'.join(re.escape(w).replace(chr(92) + '-', '-') for w in words) + ')($|[^a-z0-9])')})"


def has_text(x: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(p)})" for p in parts) + ")"


def bounded(x: str) -> str:
    """The text with two marks at either end of every word, as RE2 knows no word bounds of other scripts: a match may end
    on the one and the next begin on the other."""
    return f"regexp_replace({x}, '([\\pL\\pN_]+)', chr(1) || chr(1) || '\\1' || chr(1) || chr(1), 'g')"


def found(x: str, pattern: str) -> str:
    """What the first group of ``pattern``, over a text with marks, finds in ``x``, the marks left out."""
    return f"list_transform(regexp_extract_all({bounded(x)}, '{pattern}', 1), lambda s: replace(s, chr(1), ''))"


def has_number(x: str, least: int) -> str:
    return f"regexp_matches({bounded(x)}, '\\x01\\p{{Nd}}{{{least},4}}\\x01')"


LATEST = "(SELECT * FROM corpus_docs WHERE doc_pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_pos ORDER BY ingested_at DESC) = 1)"


def label(x: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0A-\\x1F]', '', 'g'), '{WS}+', ' ', 'g'))"
    safe = f"substr(translate({plain}, '[]{{}}|<>', '()()/()'), 1, 160)"
    return f"CASE WHEN {suspicious(plain)} THEN 'redacted-untrusted-metadata' WHEN {safe} = '' THEN 'unknown-source' ELSE {safe} END"


#: A missing doc_id is made of the place among the documents with text.
CORPUS = f"""corpus AS (
  SELECT *, {label("coalesce(nullif(title, ''), nullif(source, ''), nullif(url, ''), nullif(doc_id, ''), pos::VARCHAR)")} AS label, coalesce(nullif(source, ''), nullif(title, ''), nullif(url, ''), pos::VARCHAR) AS origin FROM (
    SELECT doc_pos AS pos, {strip('content')} AS content, coalesce(doc_id, printf('corpus-doc-%04d', row_number() OVER (ORDER BY doc_pos) - 1)) AS doc_id, title, source, url, metadata
    FROM {LATEST} WHERE {strip('content')} <> ''))"""
#: Metadata as pairs in order of their keys: the record's own, its fields and its position.
METADATA = "list_sort(list_transform(list_concat(list_filter(map_entries(coalesce(metadata, MAP {})), lambda e: NOT list_contains(list_transform(own, lambda o: o.key), e.key)), own), lambda e: e.key || '=' || coalesce(e.value, chr(1))))"
WITH_METADATA = f"described AS (SELECT *, {METADATA} AS pairs FROM (SELECT *, list_filter([{{'key': 'doc_id', 'value': doc_id}}, {{'key': 'title', 'value': title}}, {{'key': 'source', 'value': source}}, {{'key': 'url', 'value': url}}, {{'key': 'index', 'value': pos::VARCHAR}}], lambda o: o.value IS NOT NULL) AS own FROM corpus))"

QUESTIONS = f"""asked AS (
  SELECT question_id AS query_id, {strip('question')} AS query, context,
    coalesce(list_filter(list_transform(list_filter(answers.text, lambda a: a IS NOT NULL), lambda a: {strip('a')}), lambda a: a <> ''), []) AS given
  FROM (SELECT * FROM questions WHERE question_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY asked_at) = 1))"""
#: Distinct in order: a place is kept if the value has no earlier one.
ANSWERS = "list_filter(given, lambda a, i: list_position(given, a) = i)"
