"""A module's head over token vectors: attention pooling, a classifier, and what each token adds to its logit.

score of a token: w2 . tanh(W1 h + b1) + b2. Weights: the softmax of a group's scores. Pooled: the weighted sum of h. Logit:
c2 . relu(C1 pooled + d1) + d2.

A group's softmax is a state of (largest score, sum of exp(score - largest), weighted sum of the vectors, rows), and two
states merge to one, so a group may be any number of rows: tasks merge theirs as they read, states are shuffled by
group, and merged again as they are read. No task holds a group's rows; a group of a third of all rows is a state for each
batch of them.

Rows that are masked (mask false or null) or whose vector is null, of another length than the head's, or holds null or
non-finite components, take no part: their weight is 0. A group of none but such rows has no result. A null key is a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Head:
    """Weights of a trained head: W1 (a x h), b1, w2, b2 of the attention; C1 (c x h), d1, c2, d2 of the classifier."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    c1: np.ndarray
    d1: np.ndarray
    c2: np.ndarray
    d2: float

    @property
    def width(self) -> int:
        return self.w1.shape[1]

    def scores(self, h: np.ndarray) -> np.ndarray:
        return np.tanh(h @ self.w1.T + self.b1) @ self.w2 + self.b2

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled @ self.c1.T + self.d1, 0) @ self.c2 + self.d2

    def pooled_gradient(self, pooled: np.ndarray) -> np.ndarray:
        """d logit / d pooled, a row for each."""
        return ((pooled @ self.c1.T + self.d1 > 0) * self.c2) @ self.c1

    def times_input(self, h: np.ndarray, weight: np.ndarray, gradient: np.ndarray, pooled: np.ndarray) -> np.ndarray:
        """The gradient of the logit with respect to each token's vector, times that vector.

        A token moves the pooled vector by its own weight, and by what its score does to all weights: the softmax's
        derivative is weight x (g . h - g . pooled), the score's is w2 (1 - tanh^2) W1.
        """
        direct = np.einsum("ij,ij->i", gradient, h)
        z = h @ self.w1.T
        by_score = (z * (1 - np.tanh(z + self.b1) ** 2)) @ self.w2
        return weight * (direct + (direct - np.einsum("ij,ij->i", gradient, pooled)) * by_score)


def usable(vector: Column, width: int) -> Column:
    """vector as array<double>, null where it takes no part."""
    d = vector.cast("array<double>")
    return F.when((F.size(d) == width) & ~F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), d)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def merged(top: np.ndarray, total: np.ndarray, vectors: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """States that lie side by side, merged from each start to the next."""
    most = np.maximum.reduceat(top, starts)
    scale = np.exp(top - np.repeat(most, np.diff([*starts, len(top)])))
    return most, np.add.reduceat(total * scale, starts), np.add.reduceat(vectors * scale[:, None], starts), np.add.reduceat(rows, starts)


def _merged(batch: pa.RecordBatch, width: int, keys: list[str], head: Head | None) -> pa.RecordBatch:
    """A batch's states merged by key, in the order in which keys come. With a head the rows are tokens: a score and a vector."""
    v = _matrix(batch.column("v"), width)
    if head is None:
        top, total, rows = (batch.column(c).to_numpy() for c in ("top", "total", "rows"))
    else:
        top, total, rows = head.scores(v), np.ones(len(v)), np.ones(len(v), np.int64)
    own = [batch.column(k).to_pandas() for k in keys]
    code, _ = pd.factorize(own[0] if len(own) == 1 else pd.MultiIndex.from_arrays(own), use_na_sentinel=False)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    most, total, v, rows = merged(top[order], total[order], v[order], rows[order], starts)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * width, pa.int32()), pa.array(v.ravel()))
    first = pa.array(order[starts])
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in keys), pa.array(most), pa.array(total), lists, pa.array(rows)], [*keys, "top", "total", "v", "rows"])


def pool(tokens: DataFrame, head: Head, keys: list[str], vector_col: str = "embedding", mask: Column | None = None) -> DataFrame:
    """keys, n (rows that count), top, total, pooled, logit and score of each group."""
    given = tokens if mask is None else tokens.where(mask)
    rows = given.select(*keys, usable(F.col(vector_col), head.width).alias("v")).where("v is not null")
    fields = ", ".join(f"{k} {tokens.schema[k].dataType.simpleString()}" for k in keys)
    schema, width = f"{fields}, top double, total double, v array<double>, rows long", head.width

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _merged(batch, width, keys, head)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """States sorted by key: the last key of a batch may go on in the next, so its state is held back."""
        held = None
        for batch in batches:
            if len(batch):
                if held is not None:
                    batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                batch = _merged(batch, width, keys, None)
                yield batch.slice(0, len(batch) - 1)
                held = batch.slice(len(batch) - 1)
        if held is not None:
            yield held

    states = rows.mapInArrow(begin, schema).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(finish, schema)
    pooled = states.select(*keys, F.col("rows").alias("n"), "top", "total", F.transform("v", lambda x: x / F.col("total")).alias("pooled"))

    @F.arrow_udf("double")
    def logit(p: pa.Array) -> pa.Array:
        return pa.array(head.logits(_matrix(p, width)))

    return pooled.withColumn("logit", logit("pooled")).withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))


def attribute(tokens: DataFrame, head: Head, keys: list[str], vector_col: str = "embedding", mask: Column | None = None) -> DataFrame:
    """tokens that count, with attention (weight), raw_attr (gradient times input of the group's logit) and score (its size)."""
    groups = pool(tokens, head, keys, vector_col, mask)
    groups = groups.select(*(F.col(k).alias(f"_{k}") for k in keys), "top", "total", "pooled")
    given = tokens if mask is None else tokens.where(mask)
    rows = given.withColumn("_v", usable(F.col(vector_col), head.width)).where("_v is not null")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    width = head.width

    @F.arrow_udf("struct<attention:double,raw_attr:double>")
    def backward(v: pa.Array, top: pa.Array, total: pa.Array, pooled: pa.Array) -> pa.Array:
        h, p = _matrix(v, width), _matrix(pooled, width)
        weight = np.exp(head.scores(h) - top.to_numpy()) / total.to_numpy()
        raw = head.times_input(h, weight, head.pooled_gradient(p), p)
        return pa.StructArray.from_arrays([pa.array(weight), pa.array(raw)], ["attention", "raw_attr"])

    joined = rows.join(groups, same).withColumn("_x", backward("_v", "top", "total", "pooled"))
    return joined.select(*tokens.columns, "_x.attention", "_x.raw_attr", F.abs("_x.raw_attr").alias("score"))
