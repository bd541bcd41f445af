"""A trained gate: which modules a text is worth asking. TF-IDF of words and a logistic regression for each module.

Fits and counts run in Spark over all labelled rows; a model is `features` weights and inverse document frequencies a module, all of one number of features.
Words are runs of letters in lower case, hashed to `features` places. Null texts are empty ones: the probability of no words.
Labels other than 0 and 1, null ids and ids whose labels conflict aren't learnt from; an id with several texts is learnt
with its smallest. A module with labels of one class only has that class's share as its probability, as one without
labels has none and isn't in the model.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 15
#: Labelled rows are dealt into parts of about so many, at least 8.
PART_ROWS = 20_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"))


def hashed(rows: DataFrame, features: int, words_col: str = "words") -> DataFrame:
    return HashingTF(inputCol=words_col, outputCol="tf", numFeatures=features).transform(rows).drop(words_col)


def fit(docs: DataFrame, labels: DataFrame, features: int = FEATURES, strength: float = 1e-4, iterations: int = 40) -> dict[str, PipelineModel | float]:
    """module -> model, of docs (doc_id, text) and labels (doc_id, module, y).

    Rows are dealt by their ids and sorted, so that sums are made in one order and runs agree.
    """
    agreed = labels.where("y in (0, 1) and doc_id is not null").groupBy("doc_id", "module").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other")
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(agreed.drop("_other"), "doc_id").groupBy("doc_id", "module", "y").agg(F.min("text").alias("text"))
    rows = rows.select("module", "doc_id", F.col("y").cast("double").alias("label"), words(F.col("text")).alias("words"))
    found: dict[str, PipelineModel | float] = {}
    for module in [r.module for r in agreed.select("module").distinct().orderBy("module").collect()]:  # a handful
        own = rows.where(F.col("module") == module)
        share, n = own.agg(F.avg("label"), F.count("*")).first()
        if share is None:
            continue
        if share in (0.0, 1.0):
            found[module] = share
            continue
        parts = own.repartition(max(8, math.ceil(n / PART_ROWS)), "doc_id").sortWithinPartitions("doc_id")
        counted = hashed(parts.select("label", "words"), features).persist(StorageLevel.MEMORY_AND_DISK)  # read for frequencies, then for the regression
        stages = [
            IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2), Normalizer(inputCol="tfidf", outputCol="features"),
            LogisticRegression(regParam=strength, maxIter=iterations, aggregationDepth=2),
        ]
        found[module] = Pipeline(stages=stages).fit(counted)
        counted.unpersist()
    return found


def scores(docs: DataFrame, model: dict[str, PipelineModel | float]) -> DataFrame:
    """docs' columns, module and score (six places), a row for each module: what operators.ai.gate takes."""
    kept, made = docs.columns, docs
    sizes = [one.stages[0].idf.size for one in model.values() if not isinstance(one, float)]
    if sizes:  # texts are read and their words counted once for all modules
        made = hashed(docs.withColumn("_words", words(F.col("text"))), sizes[0], "_words")
    for k, one in enumerate(model.values()):
        if isinstance(one, float):
            made = made.withColumn(f"_p{k}", F.lit(one))
        else:
            made = one.transform(made).withColumn(f"_p{k}", vector_to_array("probability")[1]).drop("tfidf", "features", "rawPrediction", "probability", "prediction")
    each = [F.struct(F.lit(module).alias("module"), (F.floor(F.col(f"_p{k}") * 1e6 + 0.5) / 1e6).alias("score")) for k, module in enumerate(model)]
    if not each:
        return docs.select(*kept, F.lit("").alias("module"), F.lit(0.0).alias("score")).where("false")
    return made.select(*kept, F.explode(F.array(*each)).alias("_m")).select(*kept, "_m.module", "_m.score")
