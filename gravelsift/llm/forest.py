"""Near-duplicate vectors by a forest of random-projection trees.

1. Equal vectors are collapsed to one with a weight, by a partial aggregation.
2. A node projects its vectors on a random direction and cuts them where few lie within SPILL of the cut, among the
   middle quantiles; both sides keep the vectors within SPILL. A node that no cut divides (a dense group) stays whole. The
   upper nodes are fitted on a bounded sample of all vectors; every vector goes down every tree, into each leaf that it
   spills to.
3. Recursion: leaves that hold over BIG vectors though they could be divided are split again, each by a tree fitted on a
   bounded sample of its own members, in tasks of one leaf for the fit and of at most SLICE members for the descent, until
   none is left. So leaves don't grow with the table, and neither do the rows and comparisons for each vector.
4. Leaves are compared whole: a dense leaf of more than TILE vectors is dealt to blocks by a hash, and each pair of blocks
   is a task of its own, so one of any size is compared in bounded memory. Nothing is capped.
5. A pair counts in the first of the leaves that it shares, so each link counts once over all trees; a task returns a
   count for each vector and a spanning set of links, never all pairs.
6. Links are verified by the cosine in double precision and united to components.

Null vectors, zero vectors and ones with null or non-finite components (or no component) link with nothing and are
returned alone; so do vectors of different lengths with each other. Repeated ids: a row each, of which the links are
those of its vector; a component is named by its smallest id. Rows with a null id: a row each, without links, kept. Empty
table: no rows. Further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gravelsift.llm.common import (
    bounded_batches, broadcast_if_small, components, group_slices, hashed_sample, local_roots, materialize, parallelism, stable_bucket, whole_groups,
)
from gravelsift.llm.shingles import mix

#: Trees, vectors in the first sample, wished-for vectors in a leaf, vectors in a block of a dense leaf.
TREES, SAMPLE, LEAF, TILE = 4, 20_000, 256, 1024
#: Leaves of over BIG vectors are split again, on about REFIT of them, SLICE members at a time, in at most ROUNDS rounds.
BIG, REFIT, SLICE, ROUNDS = 1024, 4096, 8192, 12
#: Vectors of length 1 whose projections are this near to a cut go to both sides.
SPILL = 0.03


class Tree:
    """Nodes as arrays: direction, cut, children (negative: leaf -1 - k)."""

    def __init__(self, sample: np.ndarray, share: float, seed: int):
        self.rng = np.random.default_rng(seed)
        self.directions: list[np.ndarray] = []
        self.cuts: list[float] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.dense: list[bool] = []
        self.root = self._grow(sample, share, 0)

    def _grow(self, x: np.ndarray, share: float, depth: int) -> int:
        best, large = None, len(x) * share > LEAF
        if large and len(x) >= 16 and depth < 40:
            for _ in range(3):  # directions from one vector to another follow the data
                a, b = x[self.rng.integers(len(x), size=2)]
                d = a - b + 0.1 * self.rng.standard_normal(x.shape[1])
                d /= np.linalg.norm(d)
                p = np.sort(x @ d)
                for q in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
                    cut = p[int(q * len(p))]
                    near = np.searchsorted(p, cut + SPILL) - np.searchsorted(p, cut - SPILL)
                    if best is None or near + abs(q - 0.5) * len(p) * 0.2 < best[0]:
                        best = (near + abs(q - 0.5) * len(p) * 0.2, d, cut)
            if best[0] > 0.4 * len(x):
                best = None
        if best is None:
            self.leaves += 1
            self.dense.append(large and len(x) >= 16)
            return -self.leaves
        _, d, cut = best
        k = len(self.cuts)
        self.directions.append(d)
        self.cuts.append(float(cut))
        self.children.append([0, 0])
        p = x @ d
        self.children[k] = [self._grow(x[p <= cut + SPILL], share, depth + 1), self._grow(x[p >= cut - SPILL], share, depth + 1)]
        return k

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row of x reaches."""
        rows, leaves, todo = [], [], [(self.root, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), -1 - node))
                continue
            p = x[own] @ self.directions[node] - self.cuts[node]
            todo += [(self.children[node][0], own[p <= SPILL]), (self.children[node][1], own[p >= -SPILL])]
        return np.concatenate(rows), np.concatenate(leaves)


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme numbers would overflow or vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _read(column: pd.Series, dtype: str) -> np.ndarray:
    """Vectors of one length from their bytes, as unit vectors."""
    return _units(np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1))


def near_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, seed: int = 7) -> DataFrame:
    """vec_id, n_links (rows linked directly), component_id (smallest id reachable), kept (it is its component's id)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    dtype = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    d = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~F.coalesce(F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(good & F.exists(d, lambda x: x != 0), d).alias("v"))
    rows = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(5), "v")})
    rows, _ = materialize(rows, "forest-rows")
    linkable = rows.where("v is not null")
    classes = linkable.groupBy("k1", "k2", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    classes, _ = materialize(classes.withColumn("dim", F.size("v")), "forest-classes")
    parts = [r.dim for r in classes.select("dim").distinct().orderBy("dim").collect()]  # lengths, as a rule one
    found = [_links(classes.where(F.col("dim") == dim).select("id", "v", "w"), least, trees, seed, dtype) for dim in parts]
    counts, edges = spark.createDataFrame([], "id long, n long"), spark.createDataFrame([], "a long, b long")
    for c, e in found:
        counts, edges = counts.unionByName(c), edges.unionByName(e)
    roots, _ = components(edges, "forest-cc")
    named = (
        classes.select("id", "k1", "k2", "w").join(counts.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(roots, F.col("id") == F.col("node"), "left")
        .select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    )
    named, _ = materialize(named, "forest-named")
    # by the vectors' keys, not the vectors; rows without one meet nothing
    out = linkable.select("vec_id", "k1", "k2").join(broadcast_if_small(named), ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, least: float, n_trees: int, seed: int, dtype: str) -> tuple[DataFrame, DataFrame]:
    """(id, n) linked weights as found by each task, and (a, b) spanning links."""
    spark = classes.sparkSession
    total = classes.count()
    sample = [r.v for r in hashed_sample(classes.select("id", "v"), "id", SAMPLE).select("v").collect()]  # bounded by SAMPLE
    x = _units(np.array(sample))
    forest = [Tree(x, total / len(x), seed * 1000 + t) for t in range(n_trees)]
    first = np.concatenate([[0], np.cumsum([t.leaves for t in forest])])
    shared = spark.sparkContext.broadcast((forest, first))  # bounded: SAMPLE vectors make so many nodes at most

    def plant(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, first = shared.value
        dense = np.concatenate([t.dense for t in forest])
        for frame in frames:
            for k in range(0, len(frame), 2000):
                part = frame.iloc[k : k + 2000]
                raw = np.stack(part.v.to_numpy()).astype(dtype)
                u = _units(raw)
                reached = [t.descend(u) for t in forest]
                rows = np.concatenate([r for r, _ in reached])
                leaves = np.concatenate([leaf + first[t] for t, (_, leaf) in enumerate(reached)])
                leaves = np.where(dense[leaves], -1 - leaves, leaves)
                order = np.lexsort((leaves, rows))
                cut = np.searchsorted(rows[order], np.arange(len(part) + 1))
                yield pd.DataFrame({
                    "id": part.id.to_numpy(), "w": part.w.to_numpy(), "u": [r.tobytes() for r in raw],
                    "leaves": [leaves[order[a:b]] for a, b in zip(cut, cut[1:], strict=False)],
                })

    planted, _ = materialize(classes.mapInPandas(plant, "id long, w long, u binary, leaves array<long>"), "forest-leaves")
    for round_ in range(ROUNDS):  # leaves below 0 are dense
        big = planted.select(F.explode("leaves").alias("leaf")).where("leaf >= 0").groupBy("leaf").count().where(F.col("count") > BIG)
        big, _ = materialize(big, "forest-big")
        if big.isEmpty():
            break
        planted, _ = materialize(_split_again(planted, big, seed * 1000 + 500 + round_, dtype), "forest-leaves")

    by_leaf = planted.select("id", "w", "u", "leaves", F.explode("leaves").alias("leaf"))
    sizes = planted.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    sizes = sizes.where("count > 1").select("leaf", F.when(F.col("count") > 2 * TILE, F.ceil(F.col("count") / TILE)).otherwise(1).cast("int").alias("blocks"))
    sizes, _ = materialize(sizes, "forest-sizes")
    tiled = (
        by_leaf.join(broadcast_if_small(sizes), "leaf").withColumn("own", stable_bucket("id", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "w", "u", "leaves")
    )
    keys = ["leaf", "lo", "hi"]

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            out = []
            for s in group_slices(frame, keys):
                g = frame.iloc[s]
                if len(g) > 1 and (got := _tile(g, least, dtype)) is not None:
                    out.append(got)
            if out:
                yield pd.concat(out)

    dealt = tiled.repartition(4 * parallelism(spark), *keys).sortWithinPartitions(*keys)
    found, _ = materialize(dealt.mapInPandas(compare, "id long, n long, a long, b long"), "forest-links")
    return found.where("n > 0").select("id", "n"), found.where("a is not null").select("a", "b")


def _split_again(planted: DataFrame, big: DataFrame, seed: int, dtype: str) -> DataFrame:
    """planted, the leaves of `big` (leaf, count) replaced by those of a tree of their own, or marked dense (below 0)."""
    members = planted.select("id", "u", F.explode("leaves").alias("leaf")).join(broadcast_if_small(big), "leaf")
    chosen = members.where(stable_bucket(F.struct("id", "leaf"), 1 << 30) < REFIT / F.col("count") * (1 << 30))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x = _read(g.sort_values("id").u, dtype)
        leaf = int(g.leaf.iloc[0])
        tree = Tree(x, int(g["count"].iloc[0]) / len(x), (seed * 1_000_003 + leaf) % (1 << 62))
        return pd.DataFrame({"leaf": [leaf], "tree": [pickle.dumps((tree.directions, tree.cuts, tree.children, tree.dense, tree.root))]})

    trees, _ = materialize(chosen.groupBy("leaf").applyInPandas(fit, "leaf long, tree binary"), "forest-trees")
    slices = F.ceil(F.col("count") / SLICE).cast("int")
    trees = trees.join(broadcast_if_small(big), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "tree")
    dealt = members.select("leaf", stable_bucket("id", slices).cast("int").alias("slice"), "id", "u")

    def descend(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(trees):  # too few members were chosen for a tree: they stay
            return pd.DataFrame({"id": own.id, "leaf": own.leaf, "into": [[-1 - x] for x in own.leaf]})
        tree, leaf = Tree.__new__(Tree), int(own.leaf.iloc[0])
        tree.directions, tree.cuts, tree.children, dense, tree.root = pickle.loads(trees.tree.iloc[0])
        rows, leaves = tree.descend(_read(own.u, dtype))
        if tree.root < 0:
            names = np.array([-1 - leaf if dense[0] else leaf])
        else:
            made = (mix(np.uint64(leaf) + np.arange(1, len(dense) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)).astype(np.int64)
            names = np.where(dense, -1 - made, made)
        order = np.argsort(rows, kind="stable")
        cut = np.searchsorted(rows[order], np.arange(len(own) + 1))
        return pd.DataFrame({"id": own.id, "leaf": own.leaf, "into": [names[leaves[order[a:b]]] for a, b in zip(cut, cut[1:], strict=False)]})

    keys = ["leaf", "slice"]
    moved = dealt.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInPandas(descend, "id long, leaf long, into array<long>")
    by_id = moved.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "into"))).alias("into"))  # a vector's leaves
    leaves = F.flatten(F.transform("leaves", lambda x: F.coalesce(F.col("into")[x], F.array(x))))
    return planted.join(by_id, "id", "left").select("id", "w", "u", F.when(F.col("into").isNull(), F.col("leaves")).otherwise(F.array_sort(leaves)).alias("leaves"))


def _tile(g: pd.DataFrame, least: float, dtype: str) -> pd.DataFrame | None:
    """The links within a block, or between two blocks, that belong to this leaf."""
    leaf, lo, hi = (int(g[c].iloc[0]) for c in ("leaf", "lo", "hi"))
    u = _read(g.u, dtype)
    if lo == hi:
        near = u @ u.T >= least
    else:
        near = np.zeros((len(g), len(g)), dtype=bool)
        a, b = (np.flatnonzero(g.own.to_numpy() == x) for x in (lo, hi))
        near[np.ix_(a, b)] = u[a] @ u[b].T >= least
        near |= near.T
    np.fill_diagonal(near, False)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    near = near[np.ix_(rows, rows)]
    earlier = [a[a < leaf] for a in g.leaves.to_numpy()[rows]]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True)
    if len(names):
        member = np.zeros((len(rows), len(names)), dtype=np.float32)
        member[np.repeat(np.arange(len(rows)), [len(e) for e in earlier]), at] = 1
        near &= member @ member.T == 0
    i, j = np.nonzero(np.triu(near))
    if not len(i):
        return None
    ids, w = g.id.to_numpy()[rows], g.w.to_numpy()[rows]
    order = np.argsort(ids, kind="stable")
    place = np.argsort(order, kind="stable")
    root = order[local_roots(len(ids), place[i], place[j])][place]
    n = near.astype(np.int64) @ w
    out = pd.DataFrame({"id": ids, "n": n, "a": pd.array(ids, dtype="Int64"), "b": pd.array(ids[root], dtype="Int64")})
    out.loc[root == np.arange(len(ids)), ["a", "b"]] = pd.NA
    return out
