"""Risk scores and actions. Scores are rounded half up to two places, in every engine alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gravelsift.functions.text import lone_consonants, nonspace_length, specials

#: Action by security level and category.
MATRIX = {
    ("LOW", "general"): "REVIEW", ("LOW", "trigger"): "PARTIAL_MASK", ("LOW", "blacklist"): "PARTIAL_MASK",
    ("MEDIUM", "general"): "PARTIAL_MASK", ("MEDIUM", "trigger"): "PARTIAL_MASK", ("MEDIUM", "blacklist"): "FULL_BLOCK",
    ("HIGH", "general"): "PARTIAL_MASK", ("HIGH", "trigger"): "FULL_BLOCK", ("HIGH", "blacklist"): "FULL_BLOCK",
}
AI_ACTION = {"LOW": "REVIEW", "MEDIUM": "PARTIAL_MASK", "HIGH": "FULL_BLOCK"}


def round2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def normal_bucket(text: Column) -> Column:
    """0 to 25 by the share of lone consonants and special characters, full at a third."""
    n = nonspace_length(text)
    ratio = F.least((lone_consonants(text) + specials(text)) / n, F.lit(0.33))
    return F.when(n > 0, round2(ratio / 0.33 * 25)).otherwise(F.lit(0.0))


def _bucket(base: float, detected: Column, nonspace: Column) -> Column:
    ratio = F.greatest(F.least(detected / nonspace, F.lit(1.0)), F.lit(0.10))
    return F.when(nonspace > 0, F.lit(base) + (ratio - 0.10) / 0.90 * 24).otherwise(F.lit(base))


def caution_bucket(detected: Column, nonspace: Column) -> Column:
    return _bucket(26.0, detected, nonspace)


def warn_bucket(detected: Column, nonspace: Column) -> Column:
    return _bucket(51.0, detected, nonspace)


def pack_score(points: Column) -> Column:
    return round2(F.greatest(F.least(points, F.lit(100.0)), F.lit(0.0)) / 100)


def risk_score(text: Column, detected: Column, blacklist: Column, system: Column, trigger: Column, ai_mean: Column | None = None) -> Column:
    """Points 0 to 100: warn if a blacklisted word was found, else caution for a system word, else AI only, else normal."""
    n, hit = nonspace_length(text), blacklist | system
    base = F.when(blacklist, warn_bucket(detected, n)).when(system, caution_bucket(detected, n))
    if ai_mean is not None:
        base = base.when(ai_mean.isNotNull(), ai_mean * 100)
    base = base.otherwise(normal_bucket(text))
    return base + F.when(hit & trigger, 25.0).otherwise(0.0)


def category(blacklist: Column, trigger: Column) -> Column:
    return F.when(blacklist, "blacklist").when(trigger, "trigger").otherwise("general")


def matrix_action(level: Column, kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for (lv, k), action in MATRIX.items():
        out = out.when((level == lv) & (kind == k), F.lit(action))
    return out


def decide(level: Column, found: Column, blacklist: Column, trigger: Column, override: Column | None = None) -> Column:
    """The action of a level; an override (null: none) comes before all else."""
    action = F.when(~found, "NORMAL").otherwise(matrix_action(level, category(blacklist, trigger)))
    return action if override is None else F.coalesce(override, action)


def ai_action(level: Column) -> Column:
    return F.when(level == "LOW", AI_ACTION["LOW"]).when(level == "MEDIUM", AI_ACTION["MEDIUM"]).otherwise(AI_ACTION["HIGH"])


def render(action: Column, text: Column, masked: Column, override: Column | None = None) -> Column:
    """What is shown: nothing of a blocked text, but the masked one where the action was overridden."""
    shown = F.when(action == "FULL_BLOCK", "").when(action == "PARTIAL_MASK", masked).otherwise(text)
    return shown if override is None else F.when(override.isNotNull(), masked).otherwise(shown)


def derive_policy(level: Column, score: Column, text: Column, masked: Column, found: Column, ai: Column, blacklist: Column, trigger: Column, general: Column) -> Column:
    """struct<action, processed_text, score> as a client derives it from an analysed comment for its own level.

    ai: whether module names are attached; they come before words. found: whether words were detected.
    """
    action = F.when(ai, ai_action(level)).otherwise(decide(level, found, blacklist, trigger))
    raised = F.when(found | ai, client_score(score, level, ai, blacklist, general)).otherwise(score)
    return F.struct(action.alias("action"), render(action, text, masked).alias("processed_text"), raised.alias("score"))


def client_score(score: Column, level: Column, ai: Column, blacklist: Column, general: Column) -> Column:
    """The score that a client shows: a quarter more for AI hits at HIGH and word hits from MEDIUM on."""
    more = F.when(ai, F.when(level == "HIGH", 0.25).otherwise(0.0)).when((blacklist | general) & level.isin("MEDIUM", "HIGH"), 0.25).otherwise(0.0)
    return F.least(F.lit(1.0), score + more)


def latency_grade(p50: Column) -> Column:
    return F.when(p50 < 30, "great").when(p50 < 100, "good").when(p50 < 200, "fair").otherwise("poor")
