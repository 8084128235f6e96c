"""Problems 5 and 6 against brute force, with weak fingerprints, hot buckets and odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import format_dup, near_dup
from lodestrand.llm.common import pairs_within
from lodestrand.llm.components import components


def docs(spark, rows):
    return spark.createDataFrame([(p, c, 7, "x") for p, c in rows], "doc_pos long, content string, rep int, toks string")


def edited(n, seed):
    rng = random.Random(seed)
    out = []
    for g in range(n):
        base = [f"g{g}w{i}" for i in range(40)] + [f"shared{i}" for i in range(10)]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randrange(5)):
                words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
            rng.shuffle(words)
            out.append(" ".join(words))
    return list(enumerate(out))


def brute(rows, threshold=0.85):
    sets = {i: frozenset(t.split()) for i, t in rows if t and t.strip()}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def found(spark, rows, **kw):
    return {tuple(r) for r in near_dup.document_pairs(*near_dup.near_duplicates(docs(spark, rows), **kw)).collect()}


def test_pairs_match_brute_force(spark):
    rows = edited(25, 3)
    rows += [(900, rows[0][1]), (901, rows[0][1].upper()), (902, None), (903, "  "), (904, "the of"), (None, rows[0][1])]
    want = brute([(i, t.lower()) for i, t in rows if i is not None and t and i != 904])
    assert found(spark, rows) == want and len(want) > 20


def test_hot_buckets_lose_nothing(spark):
    rows = edited(12, 5)
    assert found(spark, rows, hot=1) == brute(rows)


@pytest.mark.parametrize("block", [3, 5, None])
def test_squares_pair_everything_once(spark, block):
    rows = spark.createDataFrame([(i % 3 if i < 20 else 9, i, 1 + i % 7) for i in range(30)], "k int, rep long, size int")
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * 0.7
    got = sorted(tuple(r) for r in pairs_within(rows, ["k"], "rep", near, "size", 0.7, block).collect())
    known = [r.asDict() for r in rows.collect()]
    assert got == [(x["rep"], y["rep"]) for x in known for y in known if x["k"] == y["k"] and x["rep"] < y["rep"] and min(x["size"], y["size"]) >= max(x["size"], y["size"]) * 0.7]


def test_templates_in_crowded_buckets(spark, monkeypatch):
    """All tokens are common: what the texts differ by is common too."""
    rows = [(i, " ".join([f"t{j}" for j in range(30)] + [f"v{(i + j) % 6}" for j in range(4)])) for i in range(40)]
    monkeypatch.setattr(near_dup, "pairs_within", lambda *a: pairs_within(*a, 4) if len(a) == 6 else pairs_within(*a))
    assert found(spark, rows, hot=1) == brute(rows)


def test_no_documents(spark):
    assert found(spark, []) == set()


def test_groups(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "a b c d e f g h"), (4, "x y z")]
    got = {r["id"]: (r["rep"], r["group_id"], r["links"]) for r in near_dup.document_groups(*near_dup.near_duplicates(docs(spark, rows))).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (3, 1, 1), 4: (4, 4, 0)}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**62, n) for n in (80, 20, 20))
    sig = near_dup.super_min_hash(np.concatenate([common, a, common, b]), np.array([100, 100]), 512)
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.06
    again = near_dup.super_min_hash(np.concatenate([a, common])[::-1].copy(), np.array([100]), 512)
    assert (again[0] == sig[0]).all()
    one = near_dup.super_min_hash(np.array([5]), np.array([1]), 64)
    assert np.isfinite(one).all()


def test_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.where("a < 0")).count() == 0


CARD = "name: Ann\nrole: clerk\ncity: Wigan"


def links(spark, rows, bits=64):
    return {(r["keep_id"], r["copy_id"]) for r in format_dup.duplicate_links(format_dup.corpus_records(docs(spark, rows)), bits).collect()}


ROWS = [
    (5, "The Canal, 1821!"), (6, "the canal 1821"), (9, "THE  CANAL\n1821"), (7, "the canal 1822"), (10, CARD), (11, "City: WIGAN | name: ann | role : clerk"), (12, "name: Ann\nname: Ann\ncity: Wigan\nrole: clerk"),
    (13, "role clerk, name ann, city wigan"), (14, None), (15, " "), (None, "the canal 1821"), (5, "The Canal, 1821!"), (20, "!!!"), (21, "???"),
]
WANT = {(5, 6), (5, 9), (10, 11), (20, 21)}


def test_writing_does_not_matter(spark):
    assert links(spark, ROWS) == WANT


def test_collisions_are_told_apart(spark):
    assert links(spark, ROWS, bits=1) == WANT


def test_copies_are_counted(spark):
    records = format_dup.corpus_records(docs(spark, ROWS))
    got = {r["keep_id"]: r["copies"] for r in format_dup.copy_counts(records, format_dup.duplicate_links(records)).collect()}
    assert got == {5: 3, 7: 1, 10: 2, 12: 1, 13: 1, 20: 2}
    assert links(spark, []) == set()


def test_questions(spark):
    rows = [
        (1, "Who dug it?", (["Ann", "Bob"],)), (2, "who dug IT", (["bob.", " ANN", "ann", None, ""],)), (3, "Who dug it?", (["Ann"],)), (4, "Who dug it?", None), (5, "Who dug it?", ([],)),
        (6, "Who dug it?", (["..."],)), (7, None, (["x"],)), (8, "", (["X!"],)), (1, "Who dug it?", (["Ann", "Bob"],)), (None, "Who dug it?", (["Ann", "Bob"],)),
    ]
    table = spark.createDataFrame(rows, "question_id long, question string, answers struct<text: array<string>>").withColumn("origin", F.lit("clash"))
    got = {tuple(r) for r in format_dup.duplicate_links(format_dup.question_records(table)).collect()}
    assert got == {("questions", 1, 2), ("questions", 7, 8)}
