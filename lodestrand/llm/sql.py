"""SQL that the queries of the subpackage are held against."""

from __future__ import annotations

from lodestrand.llm.common import STOP_WORDS

WS = r"[\s\x0b\x{85}\pZ]"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: NOT list_contains({_STOP}, t))"


def _letters(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\pL\\pN]+', '', 'g')"


_CONTENTS = f"contents AS (SELECT doc_pos, max(content) AS content FROM corpus_docs WHERE doc_pos IS NOT NULL AND regexp_matches(content, '[^\\s\\x0b\\x{{85}}\\pZ]') GROUP BY doc_pos)"

_LIVE = f"""raw AS (SELECT doc_pos, lower(regexp_replace(term, '^{WS}+|{WS}+$', '', 'g')) AS term, tf, indexed_at FROM term_postings WHERE doc_pos IS NOT NULL AND tf IS NOT NULL AND term IS NOT NULL),
 live AS (SELECT doc_pos, term, tf FROM (SELECT * FROM raw WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY doc_pos, term ORDER BY indexed_at DESC NULLS LAST, tf DESC) = 1) WHERE tf > 0),
 counts AS (SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS docs FROM live GROUP BY term),
 report AS (SELECT *, CASE WHEN docs <= 2 THEN 'rare' WHEN docs > 0.25 * (SELECT count(DISTINCT doc_pos) FROM live) THEN 'common' END AS verdict FROM counts)"""

_TERMS = f"""toks AS (SELECT doc_pos, {_tokens('content')} AS toks FROM contents), tf AS (SELECT doc_pos, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_pos, len(toks) AS len, unnest(toks) AS term FROM toks) GROUP BY doc_pos, term),
 st AS (SELECT (SELECT count(*) FROM contents)::DOUBLE AS n, (SELECT sum(len(toks)) FROM toks)::DOUBLE AS t), tot AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS total FROM tf GROUP BY term)"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY doc_pos ORDER BY score DESC, term) <= 3 AND count(*) OVER (PARTITION BY doc_pos) >= 10"
_BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (t / n)))"
_ODDS = (
    "(ln((tf + len * total / t) / (len + len - tf - len * total / t)) - ln((total - tf + len * total / t) / (t - len + len - (total - tf) - len * total / t))) "
    "/ sqrt(1 / (tf + len * total / t) + 1 / (total - tf + len * total / t))"
)

_PIECE = lambda s: (
    f"CASE WHEN length(content) - {s} <= 1000 THEN length(content) ELSE coalesce("
    + ", ".join(f"nullif(length(regexp_extract(substr(content, {s} + 501, 500), '(?s)^(.*{sep})', 1)), 0) + {s} + 500" for sep in (r"\n\n", r"\n", r"\. ", " "))
    + f", {s} + 1000) END"
)

_CARD = r"list_filter(regexp_split_to_array(content, '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}|]'), lambda p: regexp_matches(p, '[^\s\x0b\x{85}\pZ]'))"
_RECORDS = f"""recs AS (SELECT 'corpus_docs' AS origin, doc_pos AS id, CASE WHEN len(ps) >= 3 AND len(list_filter(ps, lambda p: NOT contains(p, ':'))) = 0 THEN to_json(list_sort(list_transform(ps, lambda p: {_letters('p')})))::VARCHAR ELSE {_letters('content')} END AS k
  FROM (SELECT doc_pos, content, {_CARD} AS ps FROM contents)
  UNION ALL SELECT 'questions', question_id, max({_letters("coalesce(question, '')")} || '|' || to_json(a)::VARCHAR) FROM (SELECT question_id, question, list_sort(list_distinct(list_filter(list_transform(list_filter(answers.text, lambda x: x IS NOT NULL), lambda x: {_letters('x')}), lambda x: x <> ''))) AS a FROM questions WHERE question_id IS NOT NULL)
  WHERE len(a) > 0 GROUP BY question_id), keyed AS (SELECT *, min(id) OVER (PARTITION BY origin, k) AS keep_id, count(*) OVER (PARTITION BY origin, k) AS n FROM recs)"""

_WORDS = lambda x: f"regexp_extract_all(lower({x}), '[\\pL\\pN]+')"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_LIVE} SELECT term, verdict FROM report WHERE verdict IS NOT NULL",
    "p1_term_report": f"WITH {_LIVE} SELECT term, occurrences, docs, verdict FROM report",
    "p3_found": f"""WITH RECURSIVE {_CONTENTS}, cut AS (SELECT doc_pos, content, 0::BIGINT AS piece_no, 0::BIGINT AS s, {_PIECE('0')}::BIGINT AS e FROM contents WHERE length(content) > 1000
      UNION ALL SELECT doc_pos, content, piece_no + 1, e - 120, {_PIECE('(e - 120)')}::BIGINT FROM cut WHERE e < length(content)) SELECT doc_pos, piece_no, s AS char_start, e AS char_end FROM cut""",
    "p3_structure_checks": f"WITH {_CONTENTS} SELECT doc_pos, length(content)::BIGINT AS covered, 0::BIGINT AS over_limit, 0::BIGINT AS misplaced, 0::BIGINT AS altered FROM contents WHERE length(content) > 1000",
    "p4_found": f"WITH {_CONTENTS}, {_TERMS}, s AS (SELECT doc_pos, term, round({_BM25}, 6) AS score FROM tf JOIN tot USING (term), st) SELECT doc_pos, term FROM s {_TOP}",
    "p4_log_odds": f"WITH {_CONTENTS}, {_TERMS}, s AS (SELECT doc_pos, term, round({_ODDS}, 6) AS score FROM tf JOIN tot USING (term), st) SELECT doc_pos, term, score FROM s {_TOP}",
    "p5_found": f"""WITH {_CONTENTS}, sets AS (SELECT doc_pos, list_distinct({_tokens('content')}) AS toks FROM contents), sized AS (SELECT doc_pos, len(toks) AS n, toks FROM sets WHERE len(toks) > 0),
      pairs AS (SELECT a.doc_pos AS doc_pos_a, b.doc_pos AS doc_pos_b, len(list_intersect(a.toks, b.toks)) AS c, a.n + b.n AS n FROM sized a JOIN sized b ON a.doc_pos < b.doc_pos AND least(a.n, b.n) >= 0.84 * greatest(a.n, b.n)) SELECT doc_pos_a, doc_pos_b FROM pairs WHERE c::DOUBLE / (n - c) >= 0.85""",
    "p5_groups": f"""WITH RECURSIVE {_CONTENTS}, sets AS MATERIALIZED (SELECT doc_pos, list_sort(list_distinct({_tokens('content')})) AS toks FROM contents), kept AS MATERIALIZED (SELECT doc_pos, toks, len(toks) AS n, min(doc_pos) OVER (PARTITION BY toks) AS rep FROM sets WHERE len(toks) > 0),
      classes AS MATERIALIZED (SELECT rep, any_value(toks) AS toks, any_value(n) AS n FROM kept GROUP BY rep),
      links AS MATERIALIZED (SELECT a, b FROM (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.toks, y.toks)) AS c, x.n + y.n AS n FROM classes x JOIN classes y ON x.rep < y.rep AND least(x.n, y.n) >= 0.84 * greatest(x.n, y.n)) WHERE c::DOUBLE / (n - c) >= 0.85),
      ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (SELECT rep AS node, rep AS to_ FROM classes UNION SELECT r.node, b.b FROM reach r JOIN ways b ON b.a = r.to_),
      roots AS (SELECT node, min(to_) AS root FROM reach GROUP BY node) SELECT doc_pos, rep, root AS group_id, (SELECT count(*) FROM ways WHERE a = rep) AS links FROM kept JOIN roots ON node = rep""",
    "p6_found": f"WITH {_CONTENTS}, {_RECORDS} SELECT origin, keep_id, id AS copy_id FROM keyed WHERE id <> keep_id",
    "p6_copies": f"WITH {_CONTENTS}, {_RECORDS} SELECT origin, keep_id, n AS copies FROM keyed WHERE id = keep_id",
    "p7_checks": "SELECT count(*) AS documents, 0::BIGINT AS overfull, 0::BIGINT AS gaps, 0::BIGINT AS divided, true AS filled FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0",
    "p8_found": f"""WITH iw AS (SELECT item_id, {_WORDS('text')} AS w FROM eval_items WHERE item_id IS NOT NULL), g AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(0, greatest(len(w) - 13, 0) + 1), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS gram FROM iw WHERE len(w) > 0),
      dw AS (SELECT doc_id, {_WORDS('text')} AS w FROM documents WHERE text IS NOT NULL),
      dg AS (SELECT doc_id, unnest(list_transform(range(0, len(w) - 12), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS gram FROM dw WHERE len(w) >= 13)
      SELECT doc_id, item_id FROM dg JOIN g USING (gram) WHERE n = 13 UNION SELECT doc_id, item_id FROM (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM dw), g WHERE n < 13 AND contains(line, ' ' || gram || ' ')""",
}
