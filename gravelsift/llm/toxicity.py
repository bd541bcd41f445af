"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: the n-grams of 3 to 6 characters of the text that lie in one word, a space standing for each of its ends, hashed to 2^22 numbers; their values are their counts by the text's length (plus HALF characters, so that a short
text isn't judged by one n-gram). Training, on a bounded sample of labelled rows (max_rows, taken in the order of a hash
of the id, so that the sample is the same at every run): r = log of the ratio of a feature's smoothed shares of all
n-grams of the two classes; features seen in fewer than MIN_DOCS rows or with |r| < MIN_RATIO drop out; logistic
regression with an L2 penalty over the features scaled by r. The sample is featurised in tasks, the fit on its reduced
matrix runs on the driver; scoring sums weights from one bounded table over every n-gram of the whole text.

Null or empty text: no features; its score is that of the intercept. Labels null or other than 0 and 1, ids whose
labels conflict, and null ids: not trained on. No labelled row, or only one class: every score is that class's share.
Repeated rows or ids: a row each (an id is trained on once, with its smallest text). Very long texts: whole, read in
parts cut at spaces. Empty table: no rows. Further columns of the input are ignored; columns named keep pass through
`score` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import agreed_labels, bounded_batches, hashed_sample, labelled_texts

BITS = 22
ORDERS = (3, 4, 5, 6)
MAX_ROWS, MIN_DOCS, MIN_RATIO = 16_000, 4, 1.0
#: Values are counts * UNIT / (characters + HALF).
UNIT, HALF = 200.0, 240
#: Texts are featurised so many characters at a time.
CHARS = 300_000


@dataclass
class Model:
    """Feature numbers (sorted), their weights, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float


def _letters() -> np.ndarray:
    """For each code point below 2^16 itself if it may stand in a word, else a space; others stand for themselves."""
    table = np.arange(1 << 16, dtype=np.uint32)
    table[[c for c in range(1 << 16) if not chr(c).isalnum()]] = 32
    return table


_LETTERS = _letters()


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) pairs of each order, not yet distinct; the texts are read as one row of code points."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return
    sizes = np.array([len(t) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[: len(points)]
    points = np.where(points < 1 << 16, _LETTERS[np.minimum(points, 0xFFFF)], points)
    points = np.concatenate([[32], points, [32]]).astype(np.uint64)
    owner = np.concatenate([owner[:1], owner, owner[-1:]])
    space = points == 32
    keep = ~(space & np.concatenate([[False], space[:-1]]))  # one space for each gap
    points, owner, space = points[keep], owner[keep], space[keep]
    gaps = np.concatenate([[0], np.cumsum(space)])
    rolled = points.copy()
    for order in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(1_000_003) + points[order - 1 :] if len(rolled) > 1 else rolled[:0]
        if order in ORDERS and len(rolled):
            inner = gaps[order - 1 : order - 1 + len(rolled)] - gaps[1 : 1 + len(rolled)]
            ok = np.flatnonzero(inner == 0)
            mixed = (rolled[ok] ^ np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
            yield owner[ok + 1], (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _cut(text: str) -> Iterator[str]:
    """A long text in parts of at most CHARS characters, cut at spaces (a longer word stays whole): the n-grams are the same."""
    start = 0
    while len(text) - start > CHARS:
        at = max(text.rfind(" ", start + 1, start + CHARS), text.rfind("\n", start + 1, start + CHARS))
        if at < 0:
            at = min((x for x in (text.find(" ", start + CHARS), text.find("\n", start + CHARS)) if x >= 0), default=len(text))
        yield text[start:at]
        start = at
    if start < len(text):
        yield text[start:]


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers of texts, their parts) of about CHARS characters at a time; a text's parts follow each other."""
    own: list[int] = []
    parts: list[str] = []
    chars = 0
    for i, text in enumerate(texts):
        for part in [text] if len(text) <= CHARS else _cut(text):
            if chars + len(part) > CHARS and parts:
                yield np.array(own), parts
                own, parts, chars = [], [], 0
            own.append(i)
            parts.append(part)
            chars += len(part)
    if parts:
        yield np.array(own), parts


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHARS characters (or one longer text), each with its first place."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > CHARS:
            yield start, texts[start:i]
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, texts[start:]


def fit(docs: DataFrame, labels: DataFrame, train_on: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from labelled rows; train_on: a condition on the id column that rows must meet."""
    bounded_batches(docs.sparkSession)
    marked = agreed_labels(labels, id_col, label_col)
    if train_on is not None:
        marked = marked.where(train_on)
    rows = labelled_texts(docs, hashed_sample(marked, "doc_id", max_rows), id_col, text_col)  # at most max_rows rows

    def featurise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, texts in _groups(frame.text.tolist()):
                held: list[tuple[np.ndarray, np.ndarray]] = []
                for own, parts in _parts(texts):
                    pairs = [own[o] << BITS | f for o, f in features(parts)]
                    held.append(np.unique(np.concatenate(pairs) if pairs else np.empty(0, np.int64), return_counts=True))
                keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                both, back = np.unique(keys, return_inverse=True)  # a text that was cut has its n-grams in several parts
                tf = np.bincount(back, counts, minlength=len(both)).astype(np.int32)
                cut = np.searchsorted(both >> BITS, np.arange(len(texts) + 1)).tolist()
                names = (both & ((1 << BITS) - 1)).astype(np.int32)
                spans = list(zip(cut, cut[1:], strict=False))
                yield pd.DataFrame({
                    "y": frame.y.to_numpy()[first : first + len(texts)], "chars": [len(t) for t in texts],
                    "f": [names[a:b] for a, b in spans], "tf": [tf[a:b] for a, b in spans],
                })

    sample = rows.select("text", "y").mapInPandas(featurise, "y int, chars long, f array<int>, tf array<int>").persist(StorageLevel.DISK_ONLY)
    n = dict(sample.groupBy("y").count().collect())
    if len(n) < 2:
        share = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        sample.unpersist()
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    of_toxic = F.col("y") * F.col("tf")
    listed = sample.select("y", F.explode(F.arrays_zip("f", "tf")).alias("x")).select("y", "x.f", "x.tf")
    counts = listed.groupBy("f").agg(F.sum(of_toxic).alias("p"), F.sum("tf").alias("n"), F.count("*").alias("rows"))
    total = listed.agg(F.sum(of_toxic).alias("p"), F.sum("tf").alias("n")).first()
    share = F.log((F.col("p") + 0.5) / (total.p + 1)) - F.log((F.col("n") - F.col("p") + 0.5) / (total.n - total.p + 1))
    counts = counts.withColumn("r", share).where((F.col("rows") >= MIN_DOCS) & (F.abs("r") >= MIN_RATIO))
    table = counts.select("f", "r").toPandas().sort_values("f")  # bounded by 2^BITS and the sample
    names, ratio = table.f.to_numpy(np.int64), table.r.to_numpy()
    if not len(names):
        sample.unpersist()
        return Model(names, ratio, float(np.log(n[1] / n[0])))
    shared = sample.sparkSession.sparkContext.broadcast(names)

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value
        for frame in frames:
            at = [np.searchsorted(names, f) for f in frame.f]
            hit = [(a < len(names)) & (names[np.minimum(a, len(names) - 1)] == f) for a, f in zip(at, frame.f, strict=True)]
            yield frame.assign(
                f=[a[h].astype(np.int32) for a, h in zip(at, hit, strict=True)], tf=[t[h] for t, h in zip(frame.tf, hit, strict=True)]
            )

    rows = sample.mapInPandas(reduce, sample.schema).toPandas()
    sample.unpersist()
    own = np.repeat(np.arange(len(rows)), rows.f.str.len())
    at = np.concatenate(rows.f.to_list()).astype(np.int64)
    value = ratio[at] * np.concatenate(rows.tf.to_list()) * (UNIT / (rows.chars.to_numpy() + HALF))[own]
    weights, intercept = _regress(own, at, value, rows.y.to_numpy(float), len(names))
    return Model(names, weights * ratio, intercept)


def _regress(own: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, n: int, penalty: float = 3e-5, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on a sparse matrix (row, column, value), by accelerated gradient descent."""
    rows = len(y)
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    step = 4 / (np.bincount(own, value**2, minlength=rows).mean() + 1)  # the trace bounds the curvature
    pw, pb = w, b
    for t in range(steps):
        m = t / (t + 3)
        mw, mb = w + m * (w - pw), b + m * (b - pb)
        z = np.bincount(own, value * mw[at], minlength=rows) + mb
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / rows
        pw, pb = w, b
        w = mw - step * (np.bincount(at, value * e[own], minlength=n) + penalty * mw)
        b = mb - step * e.sum()
    return w, b


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """The columns `keep` and the score (0 to 1) of every whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.features, model.weights))  # at most 2^BITS numbers
    intercept = model.intercept
    plain = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_scored_text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << BITS, dtype=np.float32)
        table[shared.value[0]] = shared.value[1]
        for frame in frames:
            texts = frame._scored_text.tolist()
            sums = np.zeros(len(texts))
            for own, parts in _parts(texts):
                for o, f in features(parts):
                    sums += np.bincount(own[o], table[f], minlength=len(texts))
            z = intercept + sums * UNIT / (np.array([len(t) for t in texts]) + HALF)
            frame = frame.drop(columns="_scored_text")
            frame[name] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield frame

    schema = docs.select(*keep).schema.add(name, "double")
    return plain.mapInPandas(run, schema)
