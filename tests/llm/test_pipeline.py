"""The pipeline's stages, one after the other."""

import corpus_pipeline
import duckdb
import pytest

from pyspark.sql import functions as F

from gravelsift.llm import chosen_path, line_dedup, quality, registry, toxicity
from gravelsift.llm.common import table

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, DATA)
        assert left.columns == docs.columns, name
        assert left.join(docs, "doc_id", "left_anti").count() == 0 and 0 < left.count() <= docs.count()
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_take_their_operators_decisions(spark):
    """Each stage on its own input against what its operator says of each row of that input."""
    docs = table(spark, DATA, "documents")
    labels = table(spark, DATA, "labels")
    kept = corpus_pipeline.keep_quality(spark, docs, DATA)
    found = quality.decide(docs, quality.fit_evidence(docs, labels), F.col("source"), F.col("lang"))
    assert ids(kept) == ids(found.where("_gq_keep"))
    clean = corpus_pipeline.drop_toxic(spark, docs, DATA)
    said = toxicity.score(docs, toxicity.fit(docs, labels, ~registry.held_out()), ["doc_id"])
    assert ids(clean) == ids(said.where("score < 0.3"))
    lines = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_lines(spark, docs, DATA).collect()}
    assert all(lines[i] == t and n == len(t) for i, (t, n) in got.items()) and all(not lines[i].strip() for i in lines.keys() - got.keys())
    near = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert ids(near) == ids(chosen_path.near_duplicates(docs).where("kept"))
    pieces = corpus_pipeline.pack(spark, docs, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("tokens")).collect()
    assert len(pieces) == docs.count() and all(r.n == r.tokens for r in pieces)


def test_pipeline_of_odd_documents(spark, odd_docs, no_docs):
    """Repeated rows, nulls, empty and long texts and clashing columns: what each stage leaves of them."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, DATA).count() == 0
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.drop_toxic):
        left = stage(spark, odd_docs, DATA)
        assert left.columns == odd_docs.columns and left.exceptAll(odd_docs).count() == 0
        assert ids(left).count(1) in (0, 2)  # equal rows, one decision
    lines = corpus_pipeline.drop_lines(spark, odd_docs, DATA)
    assert ids(lines) == [1, 1, 3, 4, 5, 6, 7, 8] and lines.drop("n").exceptAll(odd_docs.drop("n")).count() == 0  # 2 is a copy of 1
    near = corpus_pipeline.drop_near_copies(spark, odd_docs, DATA)
    assert ids(near) == [1, 1, 3, 4, 5, 7, 8] and near.exceptAll(odd_docs).count() == 0  # 6 is 5 with a word more
    pieces = corpus_pipeline.pack(spark, odd_docs, DATA).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.tokens * (2 if r.doc_id == 1 else 1) for r in pieces} and {r.doc_id for r in pieces if r.n == 1} == {3, 4} and len(pieces) == 8


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, registry.queries()[name](spark, DATA).select(*columns).collect())) == sorted(want.fetchall())
