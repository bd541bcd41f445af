"""Rules over module scores. Scores are rows (doc_id, module, score) or one map column module -> score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.functions.text import keyword_ratio, span_mask, star_all, strip

#: The modules and their thresholds.
MODULES = ("basic", "criticism", "family", "pii", "politics", "sexual", "spam")
HIT = {"spam": 0.70, "pii": 0.80}
MASK = {"basic": 0.15, "sexual": 0.20, "criticism": 0.40, "politics": 0.20, "family": 1.50}
BLOCKING = ("spam", "pii")
GATE, UNSURE = 0.3, (0.3, 0.7)
#: The share of stars from which the first pass stands alone, and what a blocked message shows.
RATIO, BLOCK_TEXT = 0.30, "[안전 정책에 따라 차단된 메시지]"


def should_run(masked_ratio: Column, text: Column) -> Column:
    """The second pass reads texts whose first-pass stars cover less than 0.3 of them."""
    return (masked_ratio < RATIO) & (F.length(strip(text)) > 0)


def service_should_run(opted_in: Column, modules: Column, blacklist: Column, trigger: Column) -> Column:
    """Whether a user has asked for module scores, of some module, and the words found don't decide already."""
    return opted_in & (F.length(strip(F.coalesce(modules, F.lit("")))) > 0) & ~blacklist & ~trigger


def hits(scores: Column, threshold: float = 0.8) -> Column:
    """The modules of a score map that reach their threshold, sorted; null scores (a failed model) give none."""
    least = F.create_map(*(F.lit(x) for kv in HIT.items() for x in kv))
    return F.array_sort(F.map_keys(F.map_filter(F.coalesce(scores, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, v: v >= F.coalesce(least[k], F.lit(threshold)))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def resolve(found: Column, scores: Column) -> Column:
    """Drop modules by the conflict rules, in their order: a fixed row of conditions over seven flags."""
    return once(F.struct(found.alias("found"), scores.alias("scores")), lambda x: _resolved(x["found"], x["scores"]))


def _resolved(found: Column, scores: Column) -> Column:
    on = {m: F.array_contains(found, m) for m in MODULES}

    def others(m: str) -> Column:
        out = F.lit(False)
        for x in MODULES:
            out = out if x == m else out | on[x]
        return out

    both = on["basic"] & (on["criticism"] | on["sexual"]) & ~on["spam"] & ~on["pii"]
    on |= {"criticism": on["criticism"] & ~both, "sexual": on["sexual"] & ~both}
    pair, first = on["criticism"] & on["sexual"], scores["criticism"] >= scores["sexual"]
    on |= {"criticism": on["criticism"] & ~(pair & ~first), "sexual": on["sexual"] & ~(pair & first)}
    on["criticism"] = on["criticism"] & ~others("criticism")
    on["sexual"] = on["sexual"] & ~others("sexual")
    pair, first = on["politics"] & on["family"], scores["politics"] >= scores["family"]
    on |= {"politics": on["politics"] & ~(pair & ~first), "family": on["family"] & ~(pair & first)}
    return F.array_compact(F.array(*(F.when(on[m], F.lit(m)) for m in MODULES)))


def left_scores(scores: Column, found: Column, resolved: Column) -> Column:
    """The score map without the modules that the conflict rules dropped."""
    dropped = F.array_except(found, resolved)
    return F.map_filter(scores, lambda k, v: ~F.array_contains(dropped, k))


def mean_over(scores: Column, threshold: float = 0.8) -> Column:
    """The mean of the scores that reach the threshold; null if none does."""
    over = F.filter(F.map_values(scores), lambda x: x >= threshold)
    return F.when(F.size(over) > 0, F.aggregate(over, F.lit(0.0), lambda a, x: a + x) / F.size(over))


def apply_second_pass(rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows with ai_modules (null: the second pass didn't count), override, what is detected and masked after all, ai_mean.

    rows: text, masked, detected array<string>, scores map, spans (evidence, e inclusive, sorted), has_details. Null or empty
    scores, blank texts and texts whose stars reach RATIO keep the first pass; no hit clears it; a blocking module blocks the
    whole text; else the evidence is masked, white space apart, or the whole text if a model gave no details.
    """
    counts = should_run(keyword_ratio(F.col("masked"), F.col("text")), F.col("text")) & F.col("scores").isNotNull() & (F.size("scores") > 0)
    every = hits(F.col("scores"), threshold)
    out = rows.withColumn("ai_modules", F.when(counts, resolve(every, F.col("scores"))))
    block = F.arrays_overlap("ai_modules", F.array(*map(F.lit, BLOCKING)))
    evidence = F.when(F.coalesce(F.size("spans"), F.lit(0)) > 0, span_mask(F.col("text"), F.col("spans"), keep_spaces=True, spare_laughter=True)).otherwise(F.col("text"))
    mask = F.when(F.col("ai_modules").isNull(), F.col("masked")).when(F.size("ai_modules") == 0, F.col("text")).when(block, F.lit(BLOCK_TEXT))
    mask = mask.when(~F.coalesce("has_details", F.lit(False)), star_all(F.col("text"))).otherwise(evidence)
    left = F.when(F.size("ai_modules") == 0, left_scores(F.col("scores"), every, F.col("ai_modules")))
    return out.withColumns({
        "detected": F.coalesce("ai_modules", "detected"), "override": F.when(block, F.lit("FULL_BLOCK")), "masked": mask, "ai_mean": mean_over(left),
    })


def uncertain(scores: DataFrame) -> DataFrame:
    """Rows worth a human label."""
    return scores.where(F.col("score").between(*UNSURE)).withColumn("review_status", F.lit("PENDING"))


def gate(scores: DataFrame, enabled: DataFrame | None = None) -> DataFrame:
    """Rows of modules that the gate selects; enabled (module): of those only."""
    found = scores.where(F.col("score") >= GATE)
    return found if enabled is None else found.join(enabled.select("module").distinct(), "module", "left_semi")


def attribution_share(tokens: DataFrame, top: int = 10, least: float = 0.15) -> DataFrame:
    """doc_id, module, pos, share, rank, selected (and token, if there is one): each token's share of its module's scores, the
    best `top`, selected from `least` on, else the first."""
    group = Window.partitionBy("doc_id", "module")
    total = F.sum("score").over(group)
    shared = tokens.withColumn("share", F.when(total > 0, F.col("score") / total).otherwise(F.lit(0.0)))
    ranked = shared.withColumn("rank", F.row_number().over(group.orderBy(F.desc("share"), "pos"))).where(F.col("rank") <= top)
    some = F.max((F.col("share") >= least).cast("int")).over(group)
    return ranked.withColumn("selected", F.when(some == 1, F.col("share") >= least).otherwise(F.col("rank") == 1)).select("doc_id", "module", "pos", *(c for c in ("token",) if c in tokens.columns), "share", "rank", "selected")


def selected_tokens(shares: DataFrame) -> DataFrame:
    """doc_id, tokens: the distinct selected tokens of attribution_share (with token), as analyze(profile="service") masks them."""
    return shares.where("selected").groupBy("doc_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def attention_pool(vectors: DataFrame, weights: list[float]) -> DataFrame:
    """label, n, pooled score: softmax attention of tanh(w . h) over the vectors of a label, in exact aggregates."""
    w = F.array(*map(F.lit, weights))
    dot = F.aggregate(F.zip_with("embedding", w, lambda h, x: F.coalesce(h.cast("double") * x, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    scored = vectors.select("label", dot.alias("d"), F.exp(F.tanh(dot)).alias("e"))
    return scored.groupBy("label").agg(F.count("*").alias("n"), (F.sum(F.col("e") * F.col("d")) / F.sum("e")).alias("pooled"))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def token_evidence(attention: Column, logit: Column) -> Column:
    return attention * F.greatest(logit, F.lit(0.0))
