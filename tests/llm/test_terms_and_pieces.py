"""Problems 1, 3 and 4 against brute force and on rows that are null, empty, repeated, tied or oddly named."""

import collections
import datetime as dt
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.llm import distinctive, pieces, term_counts
from lodestrand.llm.common import STOP_WORDS

POSTINGS = "segment_no int, doc_pos long, source string, term string, tf int, indexed_at timestamp, block int, docs string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def postings(spark, rows):
    return spark.createDataFrame([(0, p, None, t, f, at(h) if h is not None else None, 1, "x") for p, t, f, h in rows], POSTINGS)


def test_latest_state_counts(spark):
    rows = [(1, " Canal ", 2, 1), (1, "canal", 5, 2), (1, "canal", 5, 2), (2, "canal", 1, 1), (2, "canal", 0, 3), (3, "canal", 4, None), (1, None, 1, 1), (1, "  ", 1, 1), (1, "x", None, 9), (1, "x", 3, 1), (None, "y", 1, 1)]
    got = {r["term"]: (r["occurrences"], r["docs"], r["verdict"]) for r in term_counts.term_report(postings(spark, rows)).collect()}
    assert got == {"canal": (9, 2, "rare"), "x": (3, 1, "rare")}


def test_hot_term_and_verdicts(spark):
    rows = [(d, t, d % 3 + 1, 1) for d in range(40) for t in ["hot", f"t{d % 20}", f"u{d % 7}"]]
    got = {r["term"]: r for r in term_counts.term_report(postings(spark, rows)).collect()}
    assert got["hot"]["docs"] == 40 and got["hot"]["occurrences"] == sum(d % 3 + 1 for d in range(40)) and got["hot"]["verdict"] == "common"
    assert got["t3"]["verdict"] == "rare" and got["u3"]["verdict"] is None


def test_ids_are_dense_and_ranges_add_up(spark):
    live = spark.createDataFrame([(d, f"w{t}", 1) for d in range(9) for t in range(d, 50)], "doc_pos long, term string, tf long")
    ids = term_counts.term_dictionary(live, 5).collect()
    assert sorted(r["term_id"] for r in ids) == list(range(50))
    got = {r["term"]: r["docs"] for r in term_counts.term_counts(live, blocks=3, width=7).collect()}
    assert got == {f"w{t}": min(t + 1, 9) for t in range(50)}


def test_no_postings(spark):
    assert term_counts.term_report(postings(spark, [])).count() == 0


def brute_pieces(text, limit=1000, overlap=120):
    out, s = [], 0
    while len(text) - s > limit:
        w, e = text[s + limit // 2 : s + limit], s + limit
        for sep in ("\n\n", "\n", ". ", " "):
            i = w.rfind(sep)
            if i >= 0:
                e = s + limit // 2 + i + len(sep)
                break
        out.append((s, e))
        s = e - overlap
    return out + [(s, len(text))] if text else []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400))
def test_window_pieces_match_brute_force(text):
    assert pieces.window_pieces(text, 40, 7) == brute_pieces(text, 40, 7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "## Sub\n", "- item one. More of it.\n", "  - inner\n", "A sentence here. Another one!\n", "\n", "w" * 70, "é x "]), max_size=30).map("".join))
def test_tree_pieces_cover_the_text(text):
    got = pieces.tree_pieces(text, 60, 10)
    assert all(0 < e - s <= 60 for s, e in got)
    at_ = 0
    for s, e in got:
        assert s <= at_ < e or not text
        at_ = e
    assert at_ == len(text)


def test_tree_keeps_sections_whole():
    text = "# One\n" + "a b c. " * 10 + "\n# Two\n" + "d e f. " * 10
    assert [text[s:e].lstrip()[:5] for s, e in pieces.tree_pieces(text, 100, 0)] == ["# One", "# Two"]


def test_what_is_left_of_a_section_stays_apart():
    text = "# One\n" + "a b c d. " * 13 + "\n# Two\nshort.\n"
    got = [text[s:e] for s, e in pieces.tree_pieces(text, 100, 0)]
    assert got[-1] == "# Two\nshort.\n" and "".join(got) == text


def test_trees_of_any_depth():
    text = "".join(" " * i + "- item\n" for i in range(3000))
    got = pieces.tree_pieces(text, 5000, 0)
    assert "".join(text[s:e] for s, e in got) == text and max(e - s for s, e in got) <= 5000


DOCS = "doc_pos long, content string, metadata map<string,string>, ingested_at timestamp, term string, piece_no int, score int"


def docs(spark, rows):
    return spark.createDataFrame([(p, c, {"k": "v", "n": None}, at(0), "clash", 1, 2) for p, c in rows], DOCS)


def test_split_edge_rows(spark):
    long = "Wort um Wort. " * 5000
    rows = docs(spark, [(1, None), (2, ""), (3, " \n"), (4, "short"), (None, long), (5, long), (5, long), (6, "x" * 1000), (7, "x" * 1001)])
    got = collections.defaultdict(list)
    for r in pieces.split(rows).orderBy("doc_pos", "piece_no").collect():
        got[r["doc_pos"]].append((r["char_start"], r["char_end"]))
    assert got == {5: brute_pieces(long), 7: [(0, 1000), (880, 1001)]}
    assert pieces.split(docs(spark, [])).count() == 0
    first = pieces.pieces_with_metadata(rows).where("doc_pos = 7").orderBy("piece_no").first()
    assert first["metadata"] == {"k": "v", "n": None} and first["piece"] == "x" * (first["char_end"] - first["char_start"])


def toks(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if t not in STOP_WORDS]


def test_bm25_matches_brute_force(spark):
    texts = {i: " ".join(f"w{(i * j) % 17} w{j % 5} the" for j in range(1, 14)) for i in range(12)}
    counts = {i: collections.Counter(toks(t)) for i, t in texts.items()}
    n, avg = len(texts), sum(sum(c.values()) for c in counts.values()) / len(texts)
    df = collections.Counter(t for c in counts.values() for t in c)
    want = set()
    for i, c in counts.items():
        size = sum(c.values())
        ranked = sorted((-round(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * size / avg)), 6), t) for t, f in c.items())
        want |= {(i, t) for _, t in ranked[:3]} if len(c) >= 10 else set()
    got = distinctive.top_terms(docs(spark, [*texts.items(), (99, None), (98, " "), (0, texts[0])]), method="bm25")
    assert {(r["doc_pos"], r["term"]) for r in got.collect()} == want


def test_log_odds_prefers_what_marks_off(spark):
    common = " ".join(f"c{i}" for i in range(12))
    rows = docs(spark, [(i, f"{common} {common} own{i} own{i}") for i in range(6)])
    top = {r["doc_pos"]: r["term"] for r in distinctive.top_terms(rows, k=1).collect()}
    assert top == {i: f"own{i}" for i in range(6)}


@pytest.mark.parametrize("method", ["log_odds", "bm25"])
def test_scores_of_edge_collections(spark, method):
    assert distinctive.scored_terms(docs(spark, []), method).count() == 0
    assert distinctive.scored_terms(docs(spark, [(1, "the of"), (2, None)]), method).count() == 0
    assert [r["df"] for r in distinctive.scored_terms(docs(spark, [(1, "solo")]), method).collect()] == [1]
    assert distinctive.scored_terms(docs(spark, [(1, "solo"), (2, "solo")]), method).where(F.col("score").isNull() | F.isnan("score")).count() == 0


def test_hot_terms_join_alike(spark):
    terms = spark.createDataFrame([(d, t, 1, 2) for d in range(1500) for t in ("hot", f"t{d}")], "doc_pos long, term string, tf long, len long")
    totals = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    got = distinctive.with_term_totals(terms, totals, 3000)
    assert got.count() == 3000 and got.where("term = 'hot' and df = 1500").count() == 1500
