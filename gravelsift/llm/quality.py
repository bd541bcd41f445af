"""Document quality by hierarchical empirical Bayes.

1. Evidence: a logistic regression over plain shape features of the whole text, counted in Arrow batches, fitted on a bounded
   sample of labelled rows (max_rows, in the order of a hash of the id). It is computed once for each row and written.
2. Sites: for each path (host and section) and each host, the number of documents and the sum of their probabilities,
   by grouped aggregation over all documents (partial sums before the shuffle, so a hot host costs nothing more).
3. Shrinkage: a host's mean is drawn to the global one, a path's to its host's, each with the strength that the
   variance between sites suggests (method of moments), so sparse sites follow their prior.
4. Score: the evidence's log-odds plus how much the path's log-odds, without the document itself, exceed the global ones.

Null or empty text: features of an empty text. Null host or section: a site of their own. Null ids: decided on like
others, never trained on. Labels null or other than 0 and 1, and ids whose labels conflict: not trained on. No labelled
rows, or one class only: the evidence is that class's share. Repeated rows or ids: a row each (an id is trained on once,
with its smallest text). Very long texts: whole. Equal scores: decided on alike. Empty table: no rows. Columns of the
input pass through `decide` whatever their names, but for those that begin with _gq_.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelsift.llm.common import agreed_labels, bounded_batches, broadcast_if_small, hashed_sample, labelled_texts, materialize

MAX_ROWS = 20_000
#: Documents of a score below this go.
LEAST = 0.5


@dataclass
class Evidence:
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float


#: Kinds of characters that are counted.
UPPER, SYMBOL, PIPE, BANG, DIGIT, STOP, SPACE, OTHER = range(8)


def _kinds() -> np.ndarray:
    """The kind of each code point below 2^16."""
    kind = np.full(1 << 16, OTHER, dtype=np.int64)
    for c in range(1 << 16):
        x = chr(c)
        if x in "|!.,":
            kind[c] = {"|": PIPE, "!": BANG}.get(x, STOP)
        elif x.isspace():
            kind[c] = SPACE
        elif x.isdigit():
            kind[c] = DIGIT
        elif x.isupper():
            kind[c] = UPPER
        elif not x.isalnum():
            kind[c] = SYMBOL
    return kind


_KIND = _kinds()
FEATURES = 10


def shape_features(texts: list[str]) -> np.ndarray:
    """A row for each text: shares of kinds of characters, of repeated words and lines, and lengths."""
    out = np.zeros((len(texts), FEATURES))
    for i, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        count = np.bincount(_KIND[np.minimum(points, 0xFFFF)], minlength=8)
        words, lines = text.split(), text.split("\n")
        n, w = max(len(points), 1), max(len(words), 1)
        again = sum(map(eq, words, words[1:]))
        out[i] = (
            count[UPPER] / n, count[SYMBOL] / n, np.log1p(count[PIPE]), count[BANG] / w, count[DIGIT] / n, count[STOP] / w,
            len(words) / n, np.log1p(len(words)), again / w, len(set(lines)) / len(lines),
        )
    return out


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Evidence:
    bounded_batches(docs.sparkSession)
    chosen = hashed_sample(agreed_labels(labels, id_col, label_col), "doc_id", max_rows)
    own = labelled_texts(docs, chosen, id_col, text_col)

    def shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"y": frame.y, "x": list(shape_features(frame.text.tolist()))})

    rows = own.select("y", "text").mapInPandas(shape, "y int, x array<double>").toPandas()  # at most max_rows rows of numbers
    n, y = FEATURES, rows.y.to_numpy(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Evidence([0.0] * n, [1.0] * n, [0.0] * n, float(np.log(share / (1 - share))))
    x = np.stack(rows.x.to_numpy())
    order = np.lexsort((*x.T, y))  # the same sums at every run
    x, y = x[order], y[order]
    means, scales = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - means) / scales, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1.0] * n + [1e-6])
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - ridge @ w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, g)
    return Evidence(means.tolist(), scales.tolist(), w[:-1].tolist(), float(w[-1]))


def evidence_logit(text: Column, model: Evidence) -> Column:
    """The evidence's log-odds, within 12 of 0."""

    @F.pandas_udf("double")
    def logit(texts: pd.Series) -> pd.Series:
        x = (shape_features(texts.fillna("").tolist()) - model.means) / model.scales
        return pd.Series(np.clip(x @ np.array(model.weights) + model.intercept, -12, 12))

    return logit(text)


def _strength(groups: DataFrame, total: str = "s", count: str = "n") -> float:
    """The prior's weight in documents: variance within a site over the variance between sites' means."""
    n, s = F.col(count), F.col(total)
    r = groups.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum(s * s / n).alias("ss"), F.sum(n * n).alias("nn"), F.count("*").alias("g")).first()
    if not r.n or r.g < 2:
        return 1e6
    mean = r.s / r.n
    within = max(mean * (1 - mean), 1e-6)
    between = (r.ss - r.n * mean * mean - (r.g - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(1e6, max(1.0, within / max(between, 1e-9))))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def sites(evidence: DataFrame) -> tuple[DataFrame, float, float, int]:
    """Path table (host, section, sum, count, host's posterior mean), the paths' strength, the global mean, its rows.

    evidence: _gq_host, _gq_section, _gq_p.
    """
    paths, _ = materialize(evidence.groupBy("_gq_host", "_gq_section").agg(F.sum("_gq_p").alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = paths.groupBy("_gq_host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    whole = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    mean = whole.s / whole.n if whole.n else 0.5
    host_strength, path_strength = _strength(hosts, "hs", "hn"), _strength(paths)
    named = hosts.select("_gq_host", ((F.col("hs") + host_strength * mean) / (F.col("hn") + host_strength)).alias("_gq_host_mean"))
    out = paths.join(named, "_gq_host").select("_gq_host", "_gq_section", F.col("s").alias("_gq_s"), F.col("n").alias("_gq_n"), "_gq_host_mean")
    out, _ = materialize(out, "quality-sites")
    return out, path_strength, float(mean), paths.count()


def _name(x: Column) -> Column:
    """A site's name: null is none that a string has, so null and the empty string are two sites."""
    return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), x.cast("string")))


def decide(
    docs: DataFrame, model: Evidence, host: Column, section: Column, text_col: str = "text", least: float = LEAST, keep: list[str] | None = None
) -> DataFrame:
    """The columns `keep` of docs (by default all) with _gq_evidence, _gq_host_mean, _gq_path_mean (without the row itself), _gq_score, _gq_keep."""
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    found = docs.select(
        *keep, _name(host).alias("_gq_host"), _name(section).alias("_gq_section"),
        evidence_logit(F.col(text_col), model).alias("_gq_z"),
    )
    found, _ = materialize(found, "quality-evidence")  # the classifier reads each text once
    found = found.withColumn("_gq_p", 1 / (1 + F.exp(-F.col("_gq_z"))))
    paths, strength, mean, _ = sites(found.select("_gq_host", "_gq_section", "_gq_p"))
    joined = found.join(broadcast_if_small(paths), ["_gq_host", "_gq_section"])
    alone = (F.col("_gq_s") - F.col("_gq_p") + strength * F.col("_gq_host_mean")) / (F.col("_gq_n") - 1 + strength)
    z = F.col("_gq_z") + _logit(alone) - _logit(F.lit(mean))
    out = joined.withColumns({"_gq_path_mean": alone, "_gq_score": 1 / (1 + F.exp(-z))}).withColumn("_gq_keep", F.col("_gq_score") >= least)
    return out.select(*keep, F.col("_gq_p").alias("_gq_evidence"), "_gq_host_mean", "_gq_path_mean", "_gq_score", "_gq_keep")
