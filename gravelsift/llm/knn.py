"""Exact top-k search by inner product: a Voronoi join.

Inner products are turned into distances: with M at least every candidate's norm, a candidate x becomes
(x, sqrt(M^2 - |x|^2)) and a query q becomes (q, 0), so |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the k largest products are the
k nearest neighbours. Then, as in the Voronoi kNN join:

1. pivots: about the square root of the number of candidates, at most PIVOTS, taken in the order of a hash;
2. every vector goes to its nearest pivot's cell, with its distance to that pivot;
3. summaries by cell: queries' count and radius; candidates' k smallest distances to the pivot;
4. bounds: a query cell's k-th neighbour is no further than theta = the k-th smallest of
   radius + |pivot, pivot'| + |pivot', candidate| over all cells' summaries;
5. a candidate is needed by a query cell only if its distance to its own pivot is at least
   |pivot, pivot'| - radius - theta (triangle inequality), and is sent only to groups of query cells that need it;
6. candidates lie in blocks of whole cells, and a query goes only to blocks of cells that its group's bound reaches; a
   block's k best are merged.

Queries are taken in blocks of at most QUERIES_A_BLOCK rows, candidates in blocks of about ROWS_A_BLOCK; a cell of more
rows is dealt to blocks of its own by a hash of the id, so one that holds a third of all rows is as even as any other.
Scores are exact integer products; distances only prune, with a slack for rounding.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of other lengths than a query's
aren't its candidates. A row isn't its own candidate (same id); of rows with one id the smallest vector counts. Rows with
a null id take no part. Ties go to the smaller id.
Fewer candidates than k: all of them. Empty table: no rows. Further columns are ignored. Scores must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.llm.common import hashed_sample, materialize, parallelism, stable_bucket

PIVOTS = 512
QUERIES_A_BLOCK = 4096
ROWS_A_BLOCK = 32_768
#: Scores are held for so many queries at a time.
SCORED = 128
#: Relative slack of the pruning bounds.
SLACK = 1e-9


def whole_components(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as array<long>; null where the vector takes no part."""
    d = vector.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(d, lambda x: F.floor(x * scale).cast("long")))


def _matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype)


def _lifted(m: np.ndarray, top: float, query: bool) -> np.ndarray:
    x = m.astype(np.float64)
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, last])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of each query row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), whole_components(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where("v is not null and id is not null")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():  # vectors move only if ids do repeat
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = rows.withColumn("dim", F.size("v"))
    rows, _ = materialize(rows, "knn-rows")
    found = None
    dims = [r.dim for r in rows.select("dim").distinct().orderBy("dim").collect()]
    for dim in dims:  # as a rule one; the lengths of the vectors in a table, not rows
        part = _one_length(rows.where(F.col("dim") == dim).select("id", "v", "q"), k, pivots)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


def _one_length(rows: DataFrame, k: int, n_pivots: int | None) -> DataFrame:
    spark = rows.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = rows.agg(F.count("*").alias("n"), F.sum(F.col("q").cast("int")).alias("nq"), F.max(norm).alias("top")).first()
    top = size.top * (1 + SLACK)
    n_pivots = n_pivots or min(PIVOTS, max(16, int(size.n**0.5)))
    chosen = hashed_sample(rows.select("id", "v"), "id", n_pivots).select("v").collect()  # bounded by PIVOTS
    centers = _lifted(np.array([r.v for r in chosen]), top, False)
    between = _distances(centers, centers)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                m = _matrix(frame.v)
                for role in (True, False):  # every row is a candidate; a query is also one of the other rows'
                    some = frame[frame.q] if role else frame
                    if len(some):
                        d = _distances(_lifted(m[frame.q.to_numpy()] if role else m, top, role), centers)
                        cell = d.argmin(axis=1)
                        yield pd.DataFrame({"id": some.id, "v": some.v, "q": role, "cell": cell, "d": d[np.arange(len(d)), cell]})

    celled = rows.mapInPandas(assign, "id long, v array<long>, q boolean, cell int, d double")
    celled, _ = materialize(celled, "knn-cells")

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task's counts, radii and k + 1 smallest distances by cell (one of them may be the query itself)."""
        n, far = np.zeros((2, len(centers)), dtype=np.int64), np.zeros((2, len(centers)))
        near: dict[int, np.ndarray] = {}
        for frame in frames:
            for (q, c), g in frame.groupby(["q", "cell"]):
                n[int(q), c] += len(g)
                far[int(q), c] = max(far[int(q), c], g.d.max())
                if not q:
                    near[c] = np.sort(np.concatenate([near.get(c, np.empty(0)), g.d.to_numpy()]))[: k + 1]
        yield pd.DataFrame(
            {"q": q == 1, "cell": c, "n": n[q, c], "far": far[q, c], "near": near.get(c, np.empty(0)) if not q else np.empty(0)}
            for q in (0, 1) for c in range(len(centers)) if n[q, c]
        )

    partial = celled.select("q", "cell", "d").mapInPandas(summarise, "q boolean, cell int, n long, far double, near array<double>")
    summary = partial.groupBy("q", "cell").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")
    )
    by = summary.collect()  # at most two rows for each pivot
    cells = sorted((r.cell, r.n, r.far) for r in by if r.q)
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    own = sorted((r.cell, r.n, r.far, np.array(r.near)) for r in by if not r.q)
    slack = SLACK * (1 + np.sqrt(top)) + 1e-6

    # blocks of candidates, filled cell by cell; a cell of more rows than a block has several of its own
    wished = min(ROWS_A_BLOCK, max(128, ceil(size.n / parallelism(spark))))
    block, held, places = 0, 0, {}
    for cell, n, _, _ in own:
        if held and held + n > wished:
            block, held = block + 1, 0
        places[cell] = (block, ceil(n / wished))
        held += n
        if n > wished:
            block, held = block + ceil(n / wished), 0

    # groups of query cells, filled one after the other; a cell that is larger than a block has several blocks
    blocks, groups, low = {}, {}, {}
    group, held = 0, 0
    for cell, n, far in cells:
        if held and held + n > QUERIES_A_BLOCK:
            group, held = group + 1, 0
        held += n
        groups[cell] = group
        blocks[group] = ceil(held / QUERIES_A_BLOCK)
        bound = np.sort(np.concatenate([far + between[cell, c] + x for c, _, _, x in own]))
        theta = bound[k] if len(bound) > k else np.inf
        for c, _, reach, _ in own:
            least = max(0.0, float(between[cell, c] - far - theta - slack))
            if least <= reach:  # else no candidate of that cell is needed
                low[group, c] = min(least, low.get((group, c), np.inf))

    sent = [(g, c, v, blocks[g], *places[c]) for (g, c), v in low.items()]  # at most a row for each pair of pivots
    pairs = F.broadcast(spark.createDataFrame(pd.DataFrame(sent, columns=["grp", "cell", "least", "blks", "first", "parts"]), "grp int, cell int, least double, blks int, first int, parts int"))
    visits = sorted({(g, *places[c]) for g, c in low})
    visits = F.broadcast(spark.createDataFrame(pd.DataFrame(visits, columns=["grp", "first", "parts"]), "grp int, first int, parts int"))
    of_cell = F.broadcast(spark.createDataFrame([(c, g, blocks[g]) for c, g in groups.items()], "cell int, grp int, blks int"))
    queries = (
        celled.where("q").join(of_cell, "cell").withColumn("blk", stable_bucket("id", F.col("blks")).cast("int")).join(visits, "grp")
        .withColumn("part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1))).select("grp", "blk", "part", "id", "v")
    )
    candidates = (
        celled.where("not q").join(pairs, "cell").where("d >= least")
        .withColumn("part", (F.col("first") + stable_bucket("id", F.col("parts"))).cast("int"))
        .withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1)))
        .select("grp", "blk", "part", F.col("id").alias("cid"), F.col("v").alias("cv"))
    )

    def solve(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(qs) and len(cs):
            ids, b = cs.cid.to_numpy(), _matrix(cs.cv, np.int64)
            top_b = float(np.abs(b).max())
            real = b.astype(float)
            for at in range(0, len(qs), SCORED):
                a = _matrix(qs.v.iloc[at : at + SCORED], np.int64)
                small = float(np.abs(a).max()) * top_b * a.shape[1] < 2**52
                scores = (a.astype(float) @ real.T).astype(np.int64) if small else a @ b.T
                for q, s in zip(qs.id.iloc[at : at + SCORED].tolist(), scores, strict=True):
                    names = ids
                    if (same := ids == q).any():
                        s, names = s[~same], ids[~same]
                    keep = np.arange(len(s))
                    if len(s) > k:  # all that reach the k-th score, so that ties are settled by id
                        keep = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        keep = keep[np.lexsort((names[keep], -s[keep]))][:k]
                    out.append((q, names[keep], s[keep]))
        if not out:
            return pd.DataFrame(columns=["query_id", "vec_id", "score"])
        query, names, scores = zip(*out, strict=True)
        return pd.DataFrame({"query_id": np.repeat(query, [len(n) for n in names]), "vec_id": np.concatenate(names), "score": np.concatenate(scores)})

    best = queries.groupBy("grp", "blk", "part").cogroup(candidates.groupBy("grp", "blk", "part")).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
