"""Moderation of texts from end to end: match, shadow, mask, module scores, score, decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gravelsift.functions import scoring, text
from gravelsift.operators import ai, matching
from gravelsift.operators import tokens as tok

LEVELS = ("LOW", "MEDIUM", "HIGH")


def first_pass(docs: DataFrame, lexicon: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """doc_id, s, e, word, wtype of what counts: words and evasions, unshadowed, longest (matching.hits_of)."""
    return matching.exploded(matching.with_hits(docs.select("doc_id", "text"), lexicon, tokens))


def judged(rows: DataFrame, triggers: tuple[str, ...]) -> DataFrame:
    """rows (text, hits) with masked, detected, length, n_detected, has_blacklist, has_general and contains (a trigger word)."""
    words, kinds = F.col("hits.word"), F.col("hits.wtype")
    return rows.withColumns({
        "masked": F.col("hits.masked"), "detected": words, "n_detected": F.size(words), "length": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)),
        "has_blacklist": F.array_contains(kinds, "USER_BLACKLIST"), "has_general": F.array_contains(kinds, "SYSTEM_KEYWORD"),
        "contains": F.coalesce(text.any_contains(F.col("text"), list(triggers)), F.lit(False)),
    }).drop("hits")


def scored(rows: DataFrame, by_ai: Column | None = None, ai_mean: Column | None = None) -> DataFrame:
    """judged rows with has_trigger and score."""
    found = F.col("n_detected") > 0
    rows = rows.withColumn("has_trigger", (F.col("has_blacklist") | F.col("has_general")) & found & F.col("contains"))
    general = F.col("has_general") & found
    points = scoring.risk_score(F.col("text"), F.col("length"), F.col("has_blacklist"), general if by_ai is None else general | by_ai, F.col("has_trigger"), ai_mean)
    return rows.withColumn("score", F.coalesce(scoring.pack_score(points), F.lit(0.0)))


def _evidence(rows: DataFrame, scores: DataFrame, evidence: DataFrame | Column | None, threshold: float) -> DataFrame:
    """rows with scores, has_details, spans of the evidence of modules that count."""
    given = scores.select("doc_id", "scores")
    if evidence is None:
        return rows.join(given, "doc_id", "left").withColumns({"has_details": F.lit(False), "spans": F.lit(None).cast("array<struct<s:int,e:int>>")})
    modules = ai.resolve(ai.hits(F.col("scores"), threshold), F.col("scores"))
    if isinstance(evidence, Column):
        counted = rows.join(given, "doc_id", "left").withColumn("modules", modules)
        return counted.withColumns({"has_details": F.lit(True), "spans": tok.evidence_marks(evidence, ai.MASK)}).drop("modules")
    counted = given.select("doc_id", F.explode(modules).alias("module"))
    spans = tok.evidence_spans(evidence.join(counted, ["doc_id", "module"], "left_semi"), ai.MASK)
    spans = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(F.col("s").cast("int").alias("s"), (F.col("e") - 1).cast("int").alias("e")))).alias("spans"))
    return rows.join(given.join(spans, "doc_id", "left").withColumn("has_details", F.lit(True)), "doc_id", "left")


def analyze(
    docs: DataFrame, lexicon: DataFrame, levels: tuple[str, ...] = LEVELS, triggers: tuple[str, ...] = (), profile: str = "sdk", tokens: DataFrame | None = None,
    scores: DataFrame | None = None, evidence: DataFrame | Column | None = None, attribution: DataFrame | None = None, threshold: float = 0.8,
    opted_in: Column | None = None, modules: Column | None = None,
) -> DataFrame:
    """doc_id, level, action, processed_text, score, has_blacklist, has_general, has_trigger, n_detected, ai_modules.

    A row for each row of docs and level: words are found, chosen and masked in one pass over the texts, without a shuffle,
    so rows of null and of repeated ids are judged by their own texts. A null text has no words and scores 0. All levels
    are decided in one pass. tokens: see matching.with_hits.

    scores: (doc_id, scores map) of the second pass, a row for each id; a missing, null or empty map is a model that failed,
    and so it is for a null id. They and what goes with them are joined by doc_id, the only shuffle of texts, before words
    are found.

    profile "sdk": spans are masked by position; module scores replace the first pass where they count (see
    ai.apply_second_pass), with the evidence (doc_id, module, token, s, e, evidence) masked; evidence of a model that reads a text where it is, so that
    nothing of it is shuffled, is a column: tokens.PIECES over doc_id, text and modules, those of the row that count. profile "service": words are
    replaced everywhere, in the order in which they were found; scores count where ai.service_should_run (opted_in and
    modules are columns of docs, by default true and ALL) and no word was found, by their own matrix; of those that it masks
    the attribution (doc_id, tokens) is masked, and without one they are reviewed.
    """
    if profile not in ("sdk", "service"):
        raise ValueError(f"no such profile: {profile}")
    sdk = profile == "sdk"
    rows = docs.select("doc_id", "text", *(() if sdk else ((F.lit(True) if opted_in is None else opted_in).alias("_opted"), (F.lit("ALL") if modules is None else modules).alias("_asked"))))
    if scores is not None and sdk:
        rows = _evidence(rows, scores, evidence, threshold)
    elif scores is not None:
        own = scores.select("doc_id", "scores")
        own = own.withColumn("tokens", F.lit(None).cast("array<string>")) if attribution is None else own.join(attribution.select("doc_id", "tokens"), "doc_id", "left")
        rows = rows.join(own, "doc_id", "left")
    rows = judged(matching.with_hits(rows, lexicon, tokens, "place" if sdk else "word"), triggers)
    rows = rows.withColumns({"ai_modules": F.lit(None).cast("array<string>"), "override": F.lit(None).cast("string"), "ai_mean": F.lit(None).cast("double"), "by_ai": F.lit(False)})
    if scores is not None and sdk:
        rows = ai.apply_second_pass(rows, threshold)
        counts = F.col("ai_modules").isNotNull()  # what is detected are modules then, typed as such
        names = F.aggregate("ai_modules", F.lit(0).cast("long"), lambda a, m: a + F.length(m))
        rows = rows.withColumns({
            "length": F.when(counts, names).otherwise(F.col("length")), "n_detected": F.when(counts, F.size("ai_modules")).otherwise(F.col("n_detected")),
            **{c: F.when(counts, F.lit(False)).otherwise(F.col(c)) for c in ("has_blacklist", "has_general")}, "by_ai": counts & (F.size("ai_modules") > 0),
        })
    elif scores is not None:
        trigger = (F.col("has_blacklist") | F.col("has_general")) & F.col("contains")
        runs = ai.service_should_run(F.coalesce("_opted", F.lit(False)), F.col("_asked"), F.col("has_blacklist"), trigger)
        asked = text.parse_modules(F.col("_asked"), ai.MODULES)
        over = F.map_filter("scores", lambda k, v: (v >= threshold) & F.array_contains(asked, k))
        only = F.coalesce(runs & (F.col("n_detected") == 0) & (F.size(over) > 0), F.lit(False))
        rows = rows.withColumns({
            "ai_modules": F.when(only, F.array_sort(F.map_keys(over))), "ai_mean": F.when(only, ai.mean_over(over, threshold)), "has_general": F.col("has_general") | only,
        })
    rows = scored(rows, F.col("by_ai"), F.col("ai_mean")).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    action = scoring.decide(F.col("level"), F.col("n_detected") > 0, F.col("has_blacklist"), F.col("has_trigger"), F.col("override"))
    shown = scoring.render(F.col("action"), F.col("text"), F.col("masked"), F.col("override"))
    if scores is not None and not sdk:
        fails = (scoring.ai_action(F.col("level")) == "PARTIAL_MASK") & F.col("tokens").isNull()
        action = F.when(F.col("ai_modules").isNotNull(), F.when(fails, "REVIEW").otherwise(scoring.ai_action(F.col("level")))).otherwise(action)
        by_tokens = F.when(F.col("tokens").isNotNull(), text.token_mask(F.col("text"), F.col("tokens"))).otherwise(F.col("text"))
        shown = F.when(F.col("ai_modules").isNotNull(), scoring.render(F.col("action"), F.col("text"), by_tokens)).otherwise(shown)
    return rows.withColumn("action", action).select("doc_id", "level", "action", shown.alias("processed_text"), "score", "has_blacklist", "has_general", "has_trigger", "n_detected", "ai_modules")
