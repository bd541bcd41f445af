"""The operators' queries over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.llm import chosen_path, forest, knn, licenses, line_dedup, merkle, oracle, packing, pieces, quality, ranking, sharding, token_files, toxicity
from gravelsift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def held_out() -> Column:
    """The rows that no toxicity model learns from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.split_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, longest=2048)
    return packing.number_sequences(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.drop_repeated_lines(docs, max_edits=2, min_chars=24)
    return found.select("doc_id", "text", F.col("_gl_lines").alias("n_lines"), F.col("_gl_dropped").alias("n_dropped"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), least=0.8)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = quality.fit_evidence(docs, table(spark, sf_dir, "labels"))
    found = quality.decide(docs, model, F.col("source"), F.col("lang"), keep=["doc_id"])
    names = {"_gq_evidence": "evidence", "_gq_host_mean": "host_mean", "_gq_path_mean": "path_mean", "_gq_score": "score", "_gq_keep": "keep"}
    return found.select("doc_id", *(F.col(k).alias(v) for k, v in names.items()))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = token_files.read_token_files(spark, manifest)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = {"text": F.when(tampered, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    return merkle.manifest(table(spark, sf_dir, "documents"), found=found)


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), shards=8, seed=42)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    return placed.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def queries() -> dict[str, Query]:
    return {
        "op1_voronoi_knn": op1_voronoi_knn,
        "op2_toxicity": op2_toxicity,
        "op3_forest": op3_forest,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_packing": op5_packing,
        "op6_line_dedup": op6_line_dedup,
        "op7_chosen_path": op7_chosen_path,
        "op8_licenses": op8_licenses,
        "op9_quality": op9_quality,
        "op10_token_files": op10_token_files,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_stratified_shards": op12_stratified_shards,
        "op13_ranked_search": op13_ranked_search,
    }


OP1_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.c, d.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND len(q.c) = len(d.c)
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP3_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k >= 0.8 * (x.c + y.c - k) - 1e-9),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS low FROM reach GROUP BY a), m AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_links, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN m ON m.a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_voronoi_knn": OP1_SQL,
        "op3_forest": OP3_SQL,
        "op7_chosen_path": OP7_SQL,
        "op11_merkle_manifest": oracle.merkle(),
        "op12_stratified_shards": oracle.shards(),
        "op13_ranked_search": oracle.RANKED,
    }
