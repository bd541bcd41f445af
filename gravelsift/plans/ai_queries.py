"""Rules over module scores; scores are derived from document ids, in both engines alike."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.operators import ai, attention, gate, tokens
from gravelsift.plans.registry import query, table

_K = {m: k for k, m in enumerate(ai.MODULES)}
SCORES_SQL = "sc AS (SELECT doc_id, m.module, ((doc_id * 37 + m.k * 11 * (doc_id % 5 + 1)) % 100) / 100.0::DOUBLE AS score FROM documents, (VALUES " + ", ".join(f"('{m}', {k})" for m, k in _K.items()) + ") m(module, k))"


def score_of(k: Column) -> Column:
    return ((F.col("doc_id") * 37 + k * 11 * (F.col("doc_id") % 5 + 1)) % 100) / F.lit(100.0)


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules = F.array(*(F.struct(F.lit(m).alias("module"), F.lit(k).alias("k")) for m, k in _K.items()))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(modules).alias("m"))
    return rows.select("doc_id", "m.module", score_of(F.col("m.k")).alias("score"))


def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [x for m, k in _K.items() for x in (F.lit(m), score_of(F.lit(k)))]
    return table(spark, sf_dir, "documents").select("doc_id", F.create_map(*pairs).alias("scores"))


HIT_SQL = "score >= CASE module WHEN 'spam' THEN 0.70::DOUBLE ELSE 0.80::DOUBLE END"


@query(f"WITH {SCORES_SQL} SELECT doc_id, coalesce(string_agg(module, ',' ORDER BY module) FILTER (WHERE {HIT_SQL}), '') AS hits FROM sc GROUP BY doc_id")
def ai_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_map(spark, sf_dir).select("doc_id", F.array_join(ai.hits(F.col("scores")), ",").alias("hits"))


_P = ", ".join(f"max(CASE WHEN module = '{m}' THEN {HIT_SQL} END) AS {m}, max(score) FILTER (WHERE module = '{m}') AS s_{m}" for m in ai.MODULES)
CONFLICTS_SQL = f"""{SCORES_SQL}, p AS (SELECT doc_id, {_P} FROM sc GROUP BY doc_id),
a AS (SELECT * REPLACE (criticism AND NOT x AS criticism, sexual AND NOT x AS sexual) FROM (SELECT *, basic AND (criticism OR sexual) AND NOT spam AND NOT pii AS x FROM p)),
b AS (SELECT * REPLACE (criticism AND (NOT sexual OR s_criticism >= s_sexual) AS criticism, sexual AND (NOT criticism OR s_criticism < s_sexual) AS sexual) FROM a),
c AS (SELECT * REPLACE (criticism AND NOT (basic OR family OR pii OR politics OR sexual OR spam) AS criticism) FROM b),
d AS (SELECT * REPLACE (sexual AND NOT (basic OR family OR pii OR politics OR criticism OR spam) AS sexual) FROM c),
e AS (SELECT * REPLACE (politics AND (NOT family OR s_politics >= s_family) AS politics, family AND (NOT politics OR s_politics < s_family) AS family) FROM d),
r AS (SELECT doc_id, list_filter([{", ".join(f"CASE WHEN {m} THEN '{m}' END" for m in ai.MODULES)}], lambda x: x IS NOT NULL) AS mods FROM e)"""


@query(f"WITH {CONFLICTS_SQL} SELECT doc_id, array_to_string(mods, ',') AS modules FROM r")
def ai_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_map(spark, sf_dir)
    return rows.select("doc_id", F.array_join(ai.resolve(ai.hits(F.col("scores")), F.col("scores")), ",").alias("modules"))


@query(f"WITH {SCORES_SQL} SELECT doc_id, module, score, 'PENDING' AS review_status FROM sc WHERE score BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE")
def uncertainty_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ai.uncertain(score_rows(spark, sf_dir))


@query(f"WITH {SCORES_SQL} SELECT doc_id, count(*) AS n, string_agg(module, ',' ORDER BY module) AS modules FROM sc WHERE score >= 0.3::DOUBLE AND module <> 'spam' GROUP BY doc_id")
def module_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    enabled = spark.createDataFrame([(m,) for m in ai.MODULES if m != "spam"], "module string")
    return ai.gate(score_rows(spark, sf_dir), enabled).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("module")), ",").alias("modules"))


_EV = """ev AS (
    SELECT user_id AS doc_id, CASE event_type WHEN 'click' THEN 'basic' WHEN 'view' THEN 'family' ELSE 'politics' END AS module,
        CASE WHEN event_id % 3 = 0 THEN '##x' ELSE 'x' END AS token, event_id % 997 AS s, event_id % 997 + event_id % 4 AS e, (event_id % 50) / 100.0::DOUBLE AS evidence, event_id FROM events)"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = F.when(F.col("event_type") == "click", "basic").when(F.col("event_type") == "view", "family").otherwise("politics")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), module.alias("module"), F.when(F.col("event_id") % 3 == 0, "##x").otherwise("x").alias("token"),
        (F.col("event_id") % 997).alias("s"), (F.col("event_id") % 997 + F.col("event_id") % 4).alias("e"), ((F.col("event_id") % 50) / F.lit(100.0)).alias("evidence"),
    )


@query(f"""
WITH {_EV}, f AS (SELECT *, CASE WHEN starts_with(token, '##') OR s <= max(e) OVER (PARTITION BY doc_id, module ORDER BY s, e, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    THEN 0 ELSE 1 END AS fresh, row_number() OVER (PARTITION BY doc_id, module ORDER BY s, e, token) AS rn FROM ev WHERE e > s),
g AS (SELECT *, sum(CASE WHEN rn = 1 THEN 1 ELSE fresh END) OVER (PARTITION BY doc_id, module ORDER BY s, e, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
h AS (SELECT doc_id, module, min(s) AS s, max(e) AS e, greatest(max(evidence), sum(evidence) / pow(count(*), 0.25)) AS evidence FROM g GROUP BY doc_id, module, run)
SELECT doc_id, module, count(*) AS n, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends FROM h
WHERE evidence >= CASE module WHEN 'basic' THEN 0.15::DOUBLE WHEN 'family' THEN 1.50::DOUBLE ELSE 0.20::DOUBLE END GROUP BY doc_id, module
""")
def ai_evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tokens.evidence_spans(_evidence(spark, sf_dir), ai.MASK)
    return spans.groupBy("doc_id", "module").agg(F.count("*").alias("n"), F.sum("s").alias("starts"), F.sum("e").alias("ends"))


_TK = "tk AS (SELECT user_id AS doc_id, event_type AS module, event_id AS pos, (event_id * 13 % 17)::DOUBLE AS score FROM events)"


@query(f"""
WITH {_TK}, s AS (SELECT *, CASE WHEN sum(score) OVER (PARTITION BY doc_id, module) > 0 THEN score / sum(score) OVER (PARTITION BY doc_id, module) ELSE 0.0 END AS share FROM tk),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, module ORDER BY share DESC, pos) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 10)
SELECT doc_id, module, pos, share, CAST(rank AS INTEGER) AS rank,
    CASE WHEN max(share) OVER (PARTITION BY doc_id, module) >= 0.15::DOUBLE THEN share >= 0.15::DOUBLE ELSE rank = 1 END AS selected FROM t
""")
def attribution_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("module"), F.col("event_id").alias("pos"), (F.col("event_id") * 13 % 17).cast("double").alias("score"))
    return ai.attribution_share(toks)


def _matrix(rows: int, columns: int, k: int) -> list[list[float]]:
    """Weights by a rule: multiples of 1/64 between -1/4 and 1/4."""
    return [[((7 * i + 13 * j + k * (i + 1)) % 33 - 16) / 64 for j in range(columns)] for i in range(rows)]


_HEAD = dict(w1=_matrix(8, 64, 3), b1=_matrix(1, 8, 5)[0], w2=_matrix(1, 8, 11)[0], b2=0.125, c1=_matrix(8, 64, 17), d1=_matrix(1, 8, 19)[0], c2=_matrix(1, 8, 23)[0], d2=-0.25)


def head() -> attention.Head:
    return attention.Head(**{k: np.array(v) if isinstance(v, list) else v for k, v in _HEAD.items()})


_DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))"
_TANH = "list_transform(list_zip(z, {b1}), lambda p: tanh(p[1] + p[2]))".format(**_HEAD)
HEAD_SQL = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS h FROM embeddings WHERE vec_id % 11 <> 0),
z AS (SELECT *, list_transform({_HEAD["w1"]}, lambda w: {_DOT.format("CAST(w AS DOUBLE[])", "h")}) AS z FROM v),
a AS (SELECT *, {_DOT.format(_TANH, f"CAST({_HEAD['w2']} AS DOUBLE[])")} + {_HEAD["b2"]} AS a FROM z),
w AS (SELECT *, exp(a - max(a) OVER (PARTITION BY label)) / sum(exp(a - m)) OVER (PARTITION BY label) AS w FROM (SELECT *, max(a) OVER (PARTITION BY label) AS m FROM a)),
p AS (SELECT label, list(x ORDER BY j) AS pooled, max(n) AS n FROM (SELECT label, j, sum(w * h[j]) AS x, count(*) AS n FROM (SELECT label, w, h, unnest(range(1, 65)) AS j FROM w) GROUP BY label, j) GROUP BY label),
y AS (SELECT *, list_transform(list_zip({_HEAD["c1"]}, {_HEAD["d1"]}), lambda c: {_DOT.format("CAST(c[1] AS DOUBLE[])", "pooled")} + c[2]) AS y FROM p),
g AS (SELECT *, {_DOT.format("list_transform(y, lambda x: greatest(x, 0))", f"CAST({_HEAD['c2']} AS DOUBLE[])")} + {_HEAD["d2"]} AS logit FROM y)"""
_SIX = "floor({} * 1e6 + 0.5) / 1e6"


def _six(x: Column) -> Column:
    return F.floor(x * 1e6 + 0.5) / 1e6


@query(f"WITH {HEAD_SQL} SELECT label, n, {_SIX.format('logit')} AS logit, {_SIX.format('1 / (1 + exp(-logit))')} AS score, j AS dim, {_SIX.format('pooled[j]')} AS pooled FROM (SELECT *, unnest(range(1, 65)) AS j FROM g)")
def attention_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of a label as the tokens of one text, every eleventh one masked: the pooled vector, a row for each of its numbers."""
    found = attention.pool(table(spark, sf_dir, "embeddings"), head(), ["label"], mask=F.col("vec_id") % 11 != 0)
    rows = found.select("label", "n", "logit", "score", F.posexplode("pooled").alias("dim", "pooled"))
    return rows.select("label", "n", _six(F.col("logit")).alias("logit"), _six(F.col("score")).alias("score"), (F.col("dim") + 1).cast("long").alias("dim"), _six(F.col("pooled")).alias("pooled"))


_BACK = f"""{HEAD_SQL},
d AS (SELECT label, pooled, list_transform(range(1, 65), lambda j: list_sum(list_transform(range(1, 9), lambda k: CASE WHEN y[k] > 0 THEN CAST({_HEAD["c2"]} AS DOUBLE[])[k] * CAST({_HEAD["c1"]} AS DOUBLE[][])[k][j] ELSE 0 END))) AS grad FROM g),
r AS (SELECT vec_id, label, w, {_DOT.format("grad", "h")} AS direct, {_DOT.format("grad", "pooled")} AS mean,
    list_sum(list_transform(range(1, 9), lambda k: z[k] * CAST({_HEAD["w2"]} AS DOUBLE[])[k] * (1 - pow(tanh(z[k] + CAST({_HEAD["b1"]} AS DOUBLE[])[k]), 2)))) AS s FROM w JOIN d USING (label)),
t AS (SELECT vec_id, label, w, w * (direct + (direct - mean) * s) AS raw FROM r)"""
_NINE = "floor({} * 1e9 + 0.5) / 1e9"


@query(f"WITH {_BACK} SELECT vec_id, label, {_NINE.format('w')} AS attention, {_NINE.format('raw')} AS raw_attr FROM t")
def input_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attention.attribute(table(spark, sf_dir, "embeddings"), head(), ["label"], mask=F.col("vec_id") % 11 != 0)
    nine = lambda c: F.floor(F.col(c) * 1e9 + 0.5) / 1e9
    return found.select("vec_id", "label", nine("attention").alias("attention"), nine("raw_attr").alias("raw_attr"))


@query(f"""WITH {_BACK}, u AS (SELECT *, vec_id % 3 = 1 AND row_number() OVER (PARTITION BY label ORDER BY vec_id) > 1 AS joins, CASE WHEN vec_id % 3 = 1 THEN '##' ELSE '' END || 'v' || vec_id AS token FROM t),
q AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id) AS run FROM u),
m AS (SELECT label, min(vec_id) AS pos, string_agg(CASE WHEN joins THEN token[3:] ELSE token END, '' ORDER BY vec_id) AS token, sum(abs(raw)) AS score FROM q GROUP BY label, run),
s AS (SELECT *, score / sum(score) OVER (PARTITION BY label) AS share FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY share DESC, pos) AS rank FROM s)
SELECT label, pos, token, {_NINE.format('share')} AS share, CAST(rank AS INTEGER) AS rank, CASE WHEN max(share) OVER (PARTITION BY label) >= 0.02::DOUBLE THEN share >= 0.02::DOUBLE ELSE rank = 1 END AS selected FROM k WHERE rank <= 10""")
def attribution_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is attributed to word pieces, joined to words, and the words that a mask takes."""
    found = attention.attribute(table(spark, sf_dir, "embeddings"), head(), ["label"], mask=F.col("vec_id") % 11 != 0)
    piece = F.concat(F.when(F.col("vec_id") % 3 == 1, "##").otherwise(""), F.lit("v"), F.col("vec_id").cast("string"))
    words = tokens.merge_word_pieces(found.select(F.col("label").alias("doc_id"), F.lit("basic").alias("module"), F.col("vec_id").alias("pos"), piece.alias("token"), "score"))
    shares = ai.attribution_share(words, top=10, least=0.02)
    return shares.select(F.col("doc_id").alias("label"), "pos", "token", (F.floor(F.col("share") * 1e9 + 0.5) / 1e9).alias("share"), "rank", "selected")


_W = [round(0.5 - k / 64, 6) for k in range(64)]


@query(f"""
WITH d AS (SELECT label, list_sum(list_transform(list_zip(embedding, {_W}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS d FROM embeddings)
SELECT label, count(*) AS n, floor(sum(exp(tanh(d)) * d) / sum(exp(tanh(d))) * 1e6 + 0.5) / 1e6 AS pooled FROM d GROUP BY label
""")
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = ai.attention_pool(table(spark, sf_dir, "embeddings"), _W)
    return pooled.select("label", "n", (F.floor(F.col("pooled") * 1e6 + 0.5) / 1e6).alias("pooled"))


@query()
def trained_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gate trained on labels, one row in four held out, and the modules that it selects for every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    long = learnt.select("doc_id", F.explode(F.create_map(F.lit("basic"), F.col("toxic"), F.lit("spam"), 1 - F.col("quality"))).alias("module", "y"))
    selected = ai.gate(gate.scores(docs, gate.fit(docs, long)))
    return selected.select("doc_id", "module", "score")
