"""Self-join of documents by the Jaccard similarity of their word shingles: a chosen-path join.

1. Each document becomes the set of its distinct five-word shingles, and gets a fingerprint of the set, a sketch of BINS
   bytes and, for each of RUNS runs, the paths of length 1 that it takes: a token is chosen if a hash of it is below
   1 / (least * size of the set), so sets that share enough tokens meet in some bucket. Equal sets are collapsed.
2. Buckets are counted with a partial aggregation and those of one set dropped. A bucket of more than SMALL sets is split
   again: its members read their tokens once more and choose the next token of the path, and so on down to DEPTH tokens, or
   until a split leaves over half of a bucket together (copies of each other, which no token parts). Pairs meet less often
   on deeper levels: sets of split buckets take further runs, until RECALL is reached on the deepest level used.
3. Small buckets, and those that are large still (dealt to pairs of blocks), are compared by brute force on sketches, whose estimate must reach `least` less SLACK; only a spanning set of candidate links leaves a task.
4. Candidates are united to clusters; the sets of a cluster's classes meet in tasks of at most two blocks of BLOCK sets,
   where the exact similarity of every pair is computed. A task returns counts of links and a spanning set of them.
5. The verified links are united to components.

A pair of sets meets in a run on level k with probability p(k) = 1 - exp(-m p(k - 1)), p(0) = 1, where m is the common tokens
over `least` times the larger set. At a similarity of `least` m is at its least, 1, when one set lies in the other: p is 0.63
on the first level (ten runs miss one in 22,000) and 0.27 on the fifth (23 runs miss one in 1,300). A pair of which one
set was in no split bucket takes no further runs; that and no meeting in its other buckets happens once in 22,000 at most.
A sketch loses a pair only if it reads SLACK below the similarity, over six standard deviations of BINS bins: one in some
10 ** 7, which is less than the ten thousandth of what RECALL leaves. No bucket is capped.

Words are runs of letters and digits in lower case. A text of one to four words has one shingle of them all; a text
without words (null, empty) links with nothing. Rows of one id are one document: the text of the smallest fingerprint
stands for it on every step, so the rows' order has no part in the result; it has one row. Rows with a null id are no documents and have no row. Long texts: whole. Empty table: no rows. Ties: a component is named by its smallest id. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import bounded_batches, broadcast_if_small, components, group_slices, local_roots, materialize, parallelism, stable_bucket, whole_groups
from gravelsift.llm.shingles import compacted, fingerprints, mix, parts, shingles, token_sets

RUNS, SMALL, DEPTH, BINS, SLACK, BLOCK, TILE = 10, 512, 5, 64, 0.3, 256, 1024
#: A pair of the least similarity, of sets of any sizes, meets with this probability.
RECALL = 0.999
TOP = float(2**64 - 2**11)
#: A task compares so many pairs of sketches at a time.
PAIRS = 100_000
#: Bits of a hash in the sorted keys of the sketches.
TOKEN = 40


def _choose(owner: np.ndarray, token: np.ndarray, limit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that are chosen under their seed, and their buckets."""
    h = mix(token ^ seed)
    chosen = np.flatnonzero(h <= limit[owner])
    return chosen, mix(h[chosen] + np.uint64(0x632BE59BD9B4E019)).astype(np.int64)


def runs_needed(level: int, recall: float = RECALL) -> int:
    """Runs after which a pair whose buckets are all split down to that level has met with probability `recall`."""
    meet = 1.0
    for _ in range(level):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _limits(sizes: np.ndarray, least: float) -> np.ndarray:
    return (np.minimum(1.0, 1 / (least * np.maximum(sizes, 1))) * TOP).astype(np.uint64)


def _seed(path: np.ndarray) -> np.ndarray:
    return mix(path.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _sketches(owner: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """One byte for each bin of each set: from the least hash that falls there; 0 if none does."""
    h = mix(token + np.uint64(0x5851F42D4C957F2D))
    key = np.sort(owner.astype(np.uint64) << np.uint64(TOKEN) | h >> np.uint64(64 - TOKEN))
    slot = (key >> np.uint64(TOKEN - 6)).astype(np.int64)  # text and bin
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, bool)
    out = np.zeros(n * BINS, dtype=np.uint8)
    out[slot[first]] = (mix(key[first] & np.uint64((1 << (TOKEN - 6)) - 1)) % np.uint64(255)).astype(np.uint8) + 1
    return out.reshape(n, BINS)


def describe(docs: DataFrame, least: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, f1, f2 (fingerprint), n (size of the set), sketch, buckets of all runs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start, texts in parts(frame.text.tolist()):
                n = len(texts)
                owner, token = token_sets(texts)
                cut = np.searchsorted(owner, np.arange(n + 1))
                sizes = np.diff(cut)
                limit = _limits(sizes, least)
                f1, f2 = fingerprints(token, cut)
                rows, buckets = [], []
                for r in range(RUNS):
                    chosen, b = _choose(owner, token, limit, _seed(np.array([r])))
                    rows.append(owner[chosen])
                    buckets.append(b)
                rows, buckets = np.concatenate(rows), np.concatenate(buckets)
                order = np.argsort(rows, kind="stable")
                at = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
                yield pd.DataFrame({
                    "doc_id": frame.doc_id.to_numpy()[start : start + n],
                    "f1": f1, "f2": f2, "n": sizes, "sketch": [s.tobytes() for s in _sketches(owner, token, n)],
                    "buckets": [buckets[order[a:b]] for a, b in zip(at, at[1:], strict=False)],
                })

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(run, "doc_id long, f1 long, f2 long, n long, sketch binary, buckets array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _children(docs: DataFrame, nodes: DataFrame, least: float, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    """The next buckets of documents in large buckets: doc_id, f1, f2, sketch, bucket, parent (that bucket's size).

    repeats: whether rows of one id may have to be told apart: only texts of the fingerprint go on, and once.
    """
    paths = F.collect_set(F.struct("bucket", "cnt")).alias("paths")  # at most a document's paths
    own = nodes.groupBy("doc_id", "f1", "f2").agg(paths, F.first("sketch").alias("sketch"))
    own, _ = materialize(own, "paths-split")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in parts(frame.text.tolist()):
                some, out = frame.iloc[first : first + len(texts)], []
                owner, tokens = token_sets(texts)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                limits, (a, b) = _limits(np.diff(cut), least), fingerprints(tokens, cut)
                real = ((a == some.f1) & (b == some.f2)).tolist()
                for k, (doc_id, f1, f2, sketch, paths) in enumerate(zip(some.doc_id, some.f1, some.f2, some.sketch, some.paths, strict=True)):
                    if not real[k]:
                        continue
                    token = tokens[cut[k] : cut[k + 1]]
                    for path in paths:
                        _, b = _choose(np.zeros(len(token), np.int64), token, limits[k : k + 1], _seed(np.array([path["bucket"]])))
                        out += [(doc_id, f1, f2, sketch, x, path["cnt"]) for x in b.tolist()]
                yield pd.DataFrame(out, columns=["doc_id", "f1", "f2", "sketch", "bucket", "parent"])

    joined = _texts(docs, id_col, text_col).join(broadcast_if_small(own), "doc_id")
    found = joined.mapInPandas(run, "doc_id long, f1 long, f2 long, sketch binary, bucket long, parent long")
    return found.dropDuplicates(["doc_id", "bucket"]) if repeats else found


def _candidates(rows: DataFrame, least: float) -> DataFrame:
    """Spanning candidate links (a, b) of rows (bucket, cnt, doc_id, sketch): the buckets of all levels in one shuffle."""
    blocks = F.ceil(F.col("cnt") / TILE).cast("int")
    tiled = (
        rows.withColumn("blocks", F.when(F.col("cnt") > TILE, blocks).otherwise(F.lit(1)))
        .withColumn("own", stable_bucket("doc_id", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "sketch")
    )
    keys = ["bucket", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            k = frame[keys].to_numpy()
            group = np.concatenate([[0], np.cumsum((k[1:] != k[:-1]).any(axis=1))])
            sketch = np.frombuffer(b"".join(frame.sketch), dtype=np.uint8).reshape(len(frame), BINS)
            ids, root, at, a, b, held = frame.doc_id.to_numpy(), np.arange(len(frame)), np.arange(len(frame)), [], [], 0
            for shift in range(1, len(frame)):
                at = at[at + shift < len(frame)]
                at = at[group[at] == group[at + shift]]
                if not len(at):
                    break
                for s in range(0, len(at), PAIRS):
                    i = at[s : s + PAIRS]
                    x, y = sketch[i], sketch[i + shift]
                    some = (x != 0) | (y != 0)
                    same = ((x == y) & some).sum(axis=1)
                    hit = (same >= (least - SLACK) * some.sum(axis=1)) & (root[i] != root[i + shift])
                    a.append(i[hit])
                    b.append(i[hit] + shift)
                    held += len(a[-1])
                    if held > PAIRS:  # only what isn't yet connected is kept
                        root = local_roots(len(frame), np.concatenate([*a, np.arange(len(frame))]), np.concatenate([*b, root]))
                        a, b, held = [], [], 0
            if a:
                root = local_roots(len(frame), np.concatenate([*a, np.arange(len(frame))]), np.concatenate([*b, root]))
            far = np.flatnonzero(root != np.arange(len(frame)))
            if len(far):
                yield pd.DataFrame({"a": ids[far], "b": ids[root[far]]}).drop_duplicates()

    return tiled.repartition(2 * parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def _member_sets(docs: DataFrame, members: DataFrame, id_col: str, text_col: str, repeats: bool) -> DataFrame:
    """members with their tokens: the distinct shingles of the text that has the member's fingerprint, and once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in parts(frame.text.tolist()):
                some = frame.iloc[first : first + len(texts)]
                owner, made = shingles(texts)
                short_owner, token = compacted(owner, made)
                a, b = fingerprints(token, np.searchsorted(short_owner, np.arange(len(texts) + 1)))
                order = np.lexsort((made, owner))
                owner, made = owner[order], made[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (made[1:] != made[:-1])])[: len(owner)]
                owner, made = owner[new], made[new].view(np.int64)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                held = some.drop(columns="text").assign(tokens=[made[x:y] for x, y in zip(cut, cut[1:], strict=False)])
                yield held[((a == some.f1) & (b == some.f2)).to_numpy()]

    joined = _texts(docs, id_col, text_col).join(broadcast_if_small(members), "doc_id")
    columns = ["doc_id", "text", "f1", "f2", "w", "root", "size"]
    found = joined.select(*columns).mapInPandas(run, "doc_id long, f1 long, f2 long, w long, root long, size long, tokens array<long>")
    return found.dropDuplicates(["doc_id"]) if repeats else found


def _verify(sets: DataFrame, least: float) -> DataFrame:
    """(id, n, a, b): linked weights and spanning links of sets (doc_id, w, root, size, tokens), compared exactly."""
    rows = (
        sets.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("own", stable_bucket("doc_id", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "w", "tokens")
    )
    keys = ["root", "lo", "hi"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, keys):
            out = [g for s in group_slices(frame, keys) if (g := _compare(frame.iloc[s], least)) is not None]
            if out:
                yield pd.concat(out)

    return rows.repartition(2 * parallelism(sets.sparkSession), *keys).sortWithinPartitions(*keys).mapInPandas(run, "id long, n long, a long, b long")


def _compare(g: pd.DataFrame, least: float) -> pd.DataFrame | None:
    if len(g) < 2:
        return None
    g = g.sort_values("doc_id", ignore_index=True)
    owner, token = np.repeat(np.arange(len(g)), g.tokens.map(len)), np.concatenate(g.tokens.to_list())
    m = len(g)
    sizes = np.bincount(owner, minlength=m)
    _, name, times = np.unique(token, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times[name] > 1)  # only tokens of two documents count
    _, col = np.unique(name[common], return_inverse=True)
    row = owner[common]
    both = np.zeros((m, m), dtype=np.int64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = max(256, 8_000_000 // m)
    for c in range(0, (col[-1] + 1) if len(col) else 0, width):
        a, b = np.searchsorted(col, [c, c + width])
        dense = np.zeros((m, min(width, col[-1] + 1 - c)), dtype=np.float32)
        dense[row[a:b], col[a:b] - c] = 1
        both += (dense @ dense.T).astype(np.int64)
    union = sizes[:, None] + sizes[None] - both
    near = (both >= least * union - 1e-9) & (union > 0)
    np.fill_diagonal(near, False)
    if g.lo.iloc[0] != g.hi.iloc[0]:
        near &= g.own.to_numpy()[:, None] != g.own.to_numpy()[None]
    if not near.any():
        return None
    i, j = np.nonzero(np.triu(near))
    ids, root = g.doc_id.to_numpy(), local_roots(m, i, j)
    out = pd.DataFrame({"id": ids, "n": near.astype(np.int64) @ g.w.to_numpy(), "a": pd.array(ids, dtype="Int64"), "b": pd.array(ids[root], dtype="Int64")})
    out.loc[root == np.arange(m), ["a", "b"]] = pd.NA
    return out[(out.n > 0)]


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_links (other documents of at least that similarity), component_id (smallest id reachable), kept."""
    bounded_batches(docs.sparkSession)
    described, _ = materialize(describe(docs, least, id_col, text_col), "paths-sets")
    repeats = not described.groupBy("doc_id").count().where("count > 1").isEmpty()
    least_row = F.min(F.struct("f1", "f2", "n", "sketch", "buckets")).alias("x")
    one = described.groupBy("doc_id").agg(least_row).select("doc_id", "x.*")
    one, _ = materialize(one, "paths-docs")
    classes = one.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"))
    classes, _ = materialize(classes, "paths-classes")
    reps, _ = materialize(one.join(classes.select(F.col("rep").alias("doc_id"), "w"), "doc_id"), "paths-reps")

    level = reps.select("doc_id", "f1", "f2", "sketch", F.explode("buckets").alias("bucket"), F.lit(None).cast("long").alias("parent"))
    leaves, runs, deepest, again = None, RUNS, 1, None
    while True:
        for depth in range(1, DEPTH + 1):
            counts, _ = materialize(level.groupBy("bucket").agg(F.count("*").alias("cnt")).where("cnt > 1"), f"paths-counts-{depth}")
            counted = level.join(broadcast_if_small(counts), "bucket")
            together = F.coalesce(F.col("cnt") > 0.5 * F.col("parent"), F.lit(False))
            counted, _ = materialize(counted.withColumn("split", (F.col("cnt") > SMALL) & ~together & F.lit(depth < DEPTH)), f"paths-{depth}")
            found = counted.where("not split").select("bucket", "cnt", "doc_id", "sketch")
            leaves = found if leaves is None else leaves.unionByName(found)
            split = counted.where("split")
            if split.isEmpty():
                break
            deepest = max(deepest, depth + 1)
            if depth == 1:
                some = split.select("doc_id", "f1", "f2", "sketch")
                again = some if again is None else again.unionByName(some)
            level, _ = materialize(_children(docs, split, least, id_col, text_col, repeats), f"paths-level-{depth}")
        if (wanted := runs_needed(deepest)) <= runs:
            break
        again, _ = materialize(again.dropDuplicates(["doc_id"]), "paths-again")
        seeds = F.explode(F.sequence(F.lit(runs).cast("long"), F.lit(wanted - 1).cast("long"))).alias("bucket")
        nodes = again.select("doc_id", "f1", "f2", "sketch", seeds, F.lit(None).cast("long").alias("cnt"))
        level, _ = materialize(_children(docs, nodes, least, id_col, text_col, repeats), f"paths-run-{runs}")
        runs = wanted

    clusters, _ = components(_candidates(leaves, least), "paths-clusters")
    clusters = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    members = (
        clusters.join(sizes, "root").withColumnRenamed("node", "doc_id")
        .join(reps.select("doc_id", "f1", "f2", "w"), "doc_id")
        .select("doc_id", "f1", "f2", "w", "root", "size")
    )
    members, _ = materialize(members, "paths-members")
    links, _ = materialize(_verify(_member_sets(docs, members, id_col, text_col, repeats), least), "paths-links")
    roots, _ = components(links.where("a is not null").select("a", "b"), "paths-cc")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    named = (
        classes.select("f1", "f2", F.col("n").alias("set_size"), "rep", "w")
        .join(counts, F.col("rep") == F.col("id"), "left").join(roots, F.col("rep") == F.col("node"), "left")
        .select("f1", "f2", "set_size", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = one.select("doc_id", "f1", "f2", F.col("n").alias("set_size")).join(named, ["f1", "f2", "set_size"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
