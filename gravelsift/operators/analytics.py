"""Reports over moderated comments and chat: keywords, distributions, latency, sessions, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.functions.scoring import latency_grade
from gravelsift.functions.text import text_key


def trending(units: DataFrame, top: int = 20, least: int = 2, min_length: int = 2) -> DataFrame:
    """word, n: the most frequent units (doc_id, pos or s, form) of at least min_length characters; of equally frequent ones
    the one first seen, by document and place, comes first (of documents without an id the others, then by word)."""
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("pos" if "pos" in units.columns else "s"))
    counted = units.where(F.length("form") >= min_length).groupBy(F.col("form").alias("word")).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    return counted.orderBy(F.desc("n"), "first", "word").limit(top).where(F.col("n") >= least).select("word", "n")


def filtered_keywords(detected: DataFrame, trend: DataFrame) -> DataFrame:
    """word, wtype, n of detected words that don't trend, the most frequent first; the trend is a top list, so it is small."""
    counted = detected.groupBy("word", "wtype").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(trend.select("word")), "word", "left_anti").orderBy(F.desc("n"), "word", "wtype")


def push_entries(decided: DataFrame) -> DataFrame:
    """id, action, key, masked (and what else decided has) of blocked and masked rows: the key finds a text on a page."""
    return decided.where(F.col("action").isin("FULL_BLOCK", "PARTIAL_MASK")).withColumn("key", text_key(F.col("text")))


def newest_first(sessions: DataFrame, owner: str | None = None) -> DataFrame:
    """The sessions (of one owner), the last begun first."""
    own = sessions if owner is None else sessions.where(F.col("owner") == owner)
    return own.orderBy(F.desc("started_at"), *(c for c in ("source", "channel_id") if c in sessions.columns))


def action_distribution(decisions: DataFrame, *by: str) -> DataFrame:
    blocked, review = F.count_if(F.col("action").isin("FULL_BLOCK", "PARTIAL_MASK")), F.count_if(F.col("action") == "REVIEW")
    counts = decisions.groupBy(*by).agg(F.count("*").alias("total"), blocked.alias("blocked"), review.alias("review"))
    counts = counts.withColumn("safe", F.col("total") - F.col("blocked") - F.col("review"))
    return counts.withColumns({f"{c}_pct": F.floor(F.col(c) * 100 / F.col("total") + 0.5).cast("long") for c in ("blocked", "review", "safe")})


def latency_stats(samples: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, min, max and the sorted values at floor(n p), counted from 0, for 0.5, 0.95 and 0.99; the grade of the first.

    Without keys and samples: one row of zeros. Values are counted first, so that a key with a third of all rows is as many
    rows as it has different values; positions come from running counts, never from a list or a sort of a group's rows.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    totals = counted.groupBy(*by).agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_v"))
    ranked = counted.withColumn("_upto", upto)
    ranked = ranked.crossJoin(totals.select("n")) if not by else ranked.join(totals.select(*by, "n"), list(by))  # one row beside each
    at = {name: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    points = ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > place, F.col("_v"))).alias(name) for name, place in at.items()))
    out = totals.crossJoin(points) if not by else totals.join(points, list(by))
    if not by:
        out = out.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "mean", "min", "max", "p50", "p95", "p99")))
    return out.withColumn("grade", latency_grade(F.col("p50")))


def last_n(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def reply_counts(comments: DataFrame) -> DataFrame:
    """comment_id, replies of the top-level comments; replies to a comment that isn't there don't show."""
    replies = comments.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("replies"))
    top = comments.where("parent_id is null").select("comment_id")
    return top.join(replies, top["comment_id"] == replies["parent_id"], "left").select("comment_id", F.coalesce("replies", F.lit(0)).alias("replies"))


def find_entries(items: DataFrame, entries: DataFrame, min_key: int = 2) -> DataFrame:
    """item_id, entry: by comment_id, else by text key of at least min_key characters; of several entries the last counts."""
    by_id = entries.groupBy("comment_id").agg(F.max_by("entry", "pos").alias("by_id"))
    by_key = entries.where(F.length("key") >= min_key).groupBy("key").agg(F.max_by("entry", "pos").alias("by_key"))
    return items.join(by_id, "comment_id", "left").join(by_key, "key", "left").select("item_id", F.coalesce("by_id", "by_key").alias("entry"))


def sessions(messages: DataFrame, keys: list[str], gap: str = "3 minutes") -> DataFrame:
    """started_at, last_message_at, message_count, filtered_count of runs of messages without a longer gap.

    One definition for batch and streams (give a stream a watermark first).
    """
    grouped = messages.groupBy(*keys, F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.max("ts").alias("last_message_at"), F.count("*").alias("message_count"), F.count_if(F.col("action") != "NORMAL").alias("filtered_count")).select(
        *keys, F.col("w.start").alias("started_at"), "last_message_at", "message_count", "filtered_count"
    )


def filter_dictionary(words: DataFrame) -> DataFrame:
    """norm, original, wtype of (norm, word, wtype): a blacklisted word overrides; else the smallest word counts."""
    best = F.struct((F.col("wtype") != "USER_BLACKLIST").alias("r"), "word", "wtype")
    return words.where("norm <> ''").groupBy("norm").agg(F.min(best).alias("x")).select("norm", F.col("x.word").alias("original"), "x.wtype")
