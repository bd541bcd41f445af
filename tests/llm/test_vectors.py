"""Operators 1 and 3 against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gravelsift.llm import forest, knn

ODD = [(900, None, 0), (901, [], 0), (902, [float("nan")] * 8, 0), (903, [0.0] * 8, 0), (904, [None] * 8, 0), (905, [1.0, 2.0], 0), (906, [float("inf")] * 8, 0)]
SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 8))
    many = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 8)), base[0] + 0.02 * rng.standard_normal((80, 8)), np.repeat(base[1:2], 30, axis=0)])
    return many.astype(np.float32)


def frame(spark, vectors):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)] + ODD + [(5, vectors[5].tolist(), 0)], SCHEMA)


def test_top_k_with_clashing_columns_and_null_ids(spark, vectors):
    df = frame(spark, vectors).union(spark.createDataFrame([(None, vectors[0].tolist(), 0)], SCHEMA))
    plain = knn.top_k(frame(spark, vectors), F.col("vec_id") % 10 == 0, k=3)
    wide = df.selectExpr("*", "'x' id", "'y' q", "1 v", "2 dim", "3 cell", "4 d", "5 score", "6 rank")
    assert sorted(map(tuple, knn.top_k(wide, F.col("vec_id") % 10 == 0, k=3).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("k", [3, 500])
def test_top_k(spark, vectors, k, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES_A_BLOCK", 7)
    got = knn.top_k(frame(spark, vectors), F.col("vec_id") % 10 == 0, k=k, pivots=9).where("query_id < 900").orderBy("query_id", "rank").collect()
    m = np.concatenate([np.floor(vectors.astype(float) * 1024).astype(np.int64), np.zeros((1, 8), np.int64)])
    ids = np.array([*range(len(vectors)), 903])
    want = []
    for q in range(0, len(vectors), 10):
        s = m @ m[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        want += [(q, r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    assert [tuple(r) for r in got] == want


def test_top_k_of_nothing(spark, vectors):
    assert knn.top_k(frame(spark, vectors).where("false"), F.col("vec_id") % 10 == 0).count() == 0
    assert knn.top_k(frame(spark, vectors), F.lit(False)).count() == 0


def linked(vectors):
    """Links and components by brute force."""
    x = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(root, np.where(near, root[None], len(x)).min(axis=1))
        if (new == root).all():
            break
        root = new
    return near.sum(axis=1), root


@pytest.mark.parametrize("sizes", [{"LEAF": 16, "TILE": 32}, {"LEAF": 16, "TILE": 8, "BIG": 24, "SAMPLE": 40, "REFIT": 48, "SLICE": 20}])
def test_forest(spark, vectors, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(forest, name, value)
    df = frame(spark, vectors).dropDuplicates(["vec_id"]).selectExpr("vec_id", "embedding", "label", "'x' u", "0L w", "1 leaf", "2 v", "3 k1")
    got = {r.vec_id: r for r in forest.near_duplicates(df).collect()}
    n, root = linked(vectors)
    assert [got[i].component_id for i in range(len(vectors))] == root.tolist()
    assert [got[i].n_links for i in range(len(vectors))] == n.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(vectors)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in ODD)
    assert forest.near_duplicates(frame(spark, vectors).where("false")).count() == 0


def test_forest_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [0.0, 1.0], 0), (None, [1.0, 0.0], 0), (None, None, 0), (3, [1.0, 0.0], 0)]
    got = sorted(map(tuple, forest.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (3, 3, 1, False), (None, 0, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_hard_pairs_meet_in_the_forest():
    """Pairs that just reach the threshold, among vectors of many clusters."""
    rng = np.random.default_rng(3)
    x = forest._units(np.repeat(rng.standard_normal((80, 64)), 50, axis=0) + 0.6 * rng.standard_normal((4000, 64)))
    away = rng.standard_normal(x.shape)
    away = forest._units(away - (away * x).sum(axis=1)[:, None] * x)
    y = 0.9 * x + np.sqrt(1 - 0.81) * away
    both, missed = np.concatenate([x, y]), np.ones(len(x), bool)
    for t in range(forest.TREES):
        tree = forest.Tree(both, 1.0, 7000 + t)
        rows, leaves = tree.descend(both)
        held = np.zeros((len(both), tree.leaves), dtype=bool)
        held[rows, leaves] = True
        missed &= ~(held[: len(x)] & held[len(x) :]).any(axis=1)
    assert missed.mean() <= 0.01


def test_vectors_of_extreme_numbers_link(spark):
    """Doubles whose squares overflow or vanish have a cosine all the same."""
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.1e200]), (3, [1e-200, 1e-200]), (4, [-1e-200, 3e-200]), (5, [1.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}
