"""Problem 2 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import neighbours


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 12, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    return x * rng.uniform(0.5, 2, (n, 1))


def brute(x, k=5, least=0.82):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(i, int(j)), max(i, int(j))))
    return out


def rows(spark, vectors, space="s", key=True):
    data = [(space, i, str(i) if key else "k", len(v) if v is not None else 4, v) for i, v in vectors]
    return spark.createDataFrame(data, "space string, id long, key string, dim int, vec array<double>").withColumn("cell", F.lit("clash"))


def pairs(df, **kw):
    return {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(neighbours.usable(df), **kw).collect()}


def test_recall(spark):
    x = clustered(1500, 32, 4)
    want, got = brute(x), pairs(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)]))
    assert len(want & got) / len(want) >= 0.97 and len(got - want) <= 0.03 * len(want)


def test_blocks_give_the_same(spark, monkeypatch):
    x = clustered(300, 16, 9)
    table = rows(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    one = pairs(table)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    assert pairs(table) == one


@pytest.mark.parametrize("model_bytes", [1 << 25, 0])
def test_levels_of_cells(spark, model_bytes):
    """Cells are divided three times over, with models broadcast and with models joined to blocks of rows."""
    x = clustered(2000, 32, 6)
    shape = neighbours.Shape(fill=20, fan=4, split_at=60, model_bytes=model_bytes)
    want, got = brute(x), pairs(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)]), shape=shape)
    assert len(want & got) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)
    table = neighbours.usable(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)])).select("space", "id", "v")
    cells, heads = neighbours.index(table, shape=shape)
    held = cells.where("held")
    assert held.count() == held.select("id").distinct().count() == 2000 and held.where("codes is null").count() == 0
    assert cells.groupBy("space", "cell").count().join(heads, ["space", "cell"], "left_anti").count() == 0
    assert held.groupBy("cell").count().agg(F.max("count")).first()[0] <= 200


def test_equal_hashes_of_different_vectors(spark):
    """Copies are told by the vector, not by its hash."""
    x = clustered(120, 8, 3)
    table = neighbours.usable(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)])).withColumn("hash", F.lit(1).cast("long"))
    got = {(r["id_a"], r["id_b"]) for r in neighbours.similar_pairs(table).collect()}
    want = brute(x)
    assert len(want & got) / len(want) >= 0.97


def test_scans_of_one_and_two_parts_agree():
    rng = np.random.default_rng(5)
    books, codes, q = rng.normal(size=(8, 16, 2)).astype(np.float32), rng.integers(0, 16, (1500, 8)).astype(np.uint8), rng.normal(size=(3, 16)).astype(np.float32)
    full = np.concatenate([books[p][codes[:, p]] for p in range(8)], axis=1)
    assert np.allclose(neighbours.scan(q, codes, books), q @ full.T, atol=1e-4) and np.allclose(neighbours.scan(q, codes[:50], books), q @ full[:50].T, atol=1e-4)
    assert (neighbours.unpack_codes(neighbours.pack_codes(codes[:, :7]), 7) == codes[:, :7]).all()


def test_unusable_vectors(spark):
    good = [1.0, 2.0, 3.0, 4.0]
    odd = [None, [], [1.0, 2.0], [0.0] * 4, [1.0, float("nan"), 1.0, 1.0], [1.0, float("inf"), 1.0, 1.0], [1.0, None, 1.0, 1.0]]
    table = rows(spark, [(i, v) for i, v in enumerate([good, good, [1e300, 2e300, 3e300, 4e300], *odd])]).withColumn("dim", F.lit(4))
    assert pairs(table) == {(0, 1), (0, 2), (1, 2)}
    assert pairs(table.where("id > 2")) == set()


def test_the_last_of_a_key_is_in_force(spark):
    table = rows(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], key=False).unionByName(rows(spark, [(3, [1.0, 0.0]), (4, [0.0, 2.0])]))
    assert pairs(table) == {(2, 4)}


def test_hot_vector(spark):
    """A vector that a third of the rows hold: each copy is linked to the five smallest ids, and so are others."""
    x = clustered(300, 8, 2)
    same = x[0] * 3
    table = rows(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, same.tolist()) for i in range(150)])
    got = pairs(table)
    copies = {p for p in got if p[0] >= 1000 or p[0] == 0}
    assert {(0, 1000 + i) for i in range(150)} <= copies
    assert all(p[0] == 0 or p[0] <= 1005 for p in copies)


def test_codes_prefer_small_errors_along_the_vector():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = np.zeros_like(x)
    errors = []
    for eta in (1.0, 8.0):
        books = neighbours._books(x, base, 2, eta, np.random.default_rng(1))
        codes = neighbours.encode(x, base, books, eta)
        assert codes.max() < 16
        back = np.concatenate([books[p][codes[:, p]] for p in range(8)], axis=1)
        errors.append(np.abs(((x - back) * x).sum(1)).mean())
    assert errors[1] < errors[0]


def test_pairs_that_few_cells_are_near_to_both(spark):
    """A space of loose cells, in which hardly a pair has the nearest cell of both in common."""
    rng = np.random.default_rng(8)
    a = rng.normal(size=(3000, 64))
    x = np.concatenate([a, a + 0.6 * rng.normal(size=a.shape)])
    want = brute(x)
    got = pairs(rows(spark, [(i, v.tolist()) for i, v in enumerate(x)]), shape=neighbours.Shape(fill=6, fan=64, split_at=500))
    assert len(want) > 2000 and len(want & got) / len(want) >= 0.98 and len(got - want) <= 0.02 * len(want)
