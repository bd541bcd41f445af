"""What the training-data operators share: table access, shared scratch tables, whole-group batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Arrow batches of texts hold so many bytes at most.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, an own temporary folder in local mode (tests, one machine); on a cluster an error, as executors
    wouldn't see each other's files there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gravelsift-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches, which else hold 10,000 rows, hold at most BATCH_BYTES of whole texts (or one row)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: the lineage is cut and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def hashed_sample(rows: DataFrame, column: str, most: int) -> DataFrame:
    """The `most` rows that come first by the hash of a column (then by the column): the same at every run.

    Of a large table only rows below a hash that leaves a few more than `most` are sorted, so that no task merges
    `most` rows of each of many others.
    """
    n, h = rows.count(), F.xxhash64(column)
    if n > 2 * most:
        rows = rows.where(h < int(-(2**63) + 2**64 * (1.2 * most + 1000) / n) if 1.2 * most + 1000 < n else F.lit(True))
    return rows.orderBy(h, column).limit(most)


def agreed_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """doc_id, y (0 or 1) of the ids whose rows of labels all agree; ids with conflicting labels, null ids and labels go."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null")
    return marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other").drop("_other")


def labelled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, y, text of a bounded table of labels: a row for each id, of repeated ids the smallest text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _width(df: DataFrame) -> Column:
    """About the bytes of a row: 8 for a number and for each number in an array, the length of strings and binaries."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        kind, column = field.dataType, F.col(field.name)
        if kind.typeName() in ("string", "binary"):
            size = 8 + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.typeName() == "array":
            size = 8 + 8 * len(getattr(kind.elementType, "fields", "x")) * F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0))
        else:
            size = F.lit(8 * len(getattr(kind, "fields", "x")))
        total = total + size
    return total


def broadcast_if_small(df: DataFrame, limit: int = 48 << 20) -> DataFrame:
    """Hint a broadcast only for a table whose measured size is at most `limit` bytes; beyond it the join shuffles.

    df should be a written table: it is read once more to be measured.
    """
    measured = df.agg(F.sum(_width(df))).first()[0] or 0
    return F.broadcast(df) if measured <= limit else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stable_bucket(column: Column | str, n: int | Column) -> Column:
    """A deterministic bucket in [0, n) that doesn't follow the partitioner's own hash."""
    return F.pmod(F.xxhash64(F.lit(77), column), F.lit(n) if isinstance(n, int) else n)


def whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Cut a partition sorted by integer keys into frames that hold whole groups only."""
    tail: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        if tail and (tail[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(tail, ignore_index=True)
            tail = []
        change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if len(change):
            yield pd.concat([*tail, frame.iloc[: change[-1]]], ignore_index=True)
            tail = [frame.iloc[change[-1] :]]
        else:
            tail.append(frame)
    if tail:
        yield pd.concat(tail, ignore_index=True)


def group_slices(frame: pd.DataFrame, keys: list[str]) -> Iterator[slice]:
    """The row ranges of the groups of a frame sorted by keys."""
    k = frame[keys].to_numpy()
    cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
    return (slice(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes over the links a-b: label propagation with pointer jumps."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def components(edges: DataFrame, label: str = "cc", rounds: int = 60) -> tuple[DataFrame, str]:
    """Connected components of edges(a long, b long) as (node, root), root the smallest node of each component.

    Alternates large-star and small-star steps; each is a min by node and a join, so a hub's neighbours are never
    gathered in one task. Each round is written to the shared folder. Nodes without an edge to another aren't listed.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), label)
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .unionByName(now)
            .distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after, new_path = materialize(small, label)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        now, path = after, new_path
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.selectExpr("a node", "b root"), path
