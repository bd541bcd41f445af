"""Chat as a stream: deduplicated messages, moderation, sessions. The batch operators are used as they are."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.functions import scoring, text
from gravelsift.operators import matching
from gravelsift.operators.analytics import sessions
from gravelsift.plans.analyze import judged, scored

MESSAGE = "id string, source string, channel_id string, author string, content string, ts timestamp"


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE, files_a_trigger: int = 100) -> DataFrame:
    """Messages from a folder of Parquet files; back pressure instead of dropped messages."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def sample_messages(spark: SparkSession, rows_a_second: int, samples: list[str]) -> DataFrame:
    """A rate source dressed as chat."""
    pick = F.element_at(F.array(*map(F.lit, samples)), (F.pmod(F.xxhash64("value"), F.lit(len(samples))) + 1).cast("int"))
    author = F.concat(F.lit("User"), (F.pmod(F.col("value") * 7919, F.lit(100)) + 1).cast("string"))
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_a_second).load()
    return rate.select(F.concat(F.lit("dummy-"), F.col("value").cast("string")).alias("id"), F.lit("DUMMY").alias("source"), F.lit("test").alias("channel_id"), author.alias("author"), pick.alias("content"), F.col("timestamp").alias("ts"))


def inject(spark: SparkSession, path: str, channel_id: str, content: str, author: str = "Tester", name: str | None = None) -> bool:
    """Land one message in the folder that read_messages reads. False, and nothing landed, if no stream (of that name) runs."""
    if not any(q.isActive and (name is None or q.name == name) for q in spark.streams.active):
        return False
    now = F.current_timestamp()
    made = spark.range(1).select(
        F.concat(F.lit("injected-"), F.uuid()).alias("id"), F.lit("DUMMY").alias("source"), F.lit(channel_id).alias("channel_id"),
        F.lit(author).alias("author"), F.lit(content).alias("content"), now.alias("ts"),
    )
    made.write.mode("append").parquet(path)
    return True


def once(messages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each message id once within the watermark."""
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def moderate(messages: DataFrame, config: DataFrame, lexicon: DataFrame, triggers: tuple[str, ...] = ()) -> DataFrame:
    """Messages with action, score, detected words (word, wtype), masked text, what their channel shows, and four times.

    The analysis is that of plans.analyze: words, evasions, white shadows and longest matches, score and policy, found
    within each message, so a stream needs no state for it. config: channel_id (once each), level, mode, placeholder; a
    channel without one has MEDIUM and MASK. The lexicon is read when the query is built and must be sent whole
    (matching.fits). Null content: no words, NORMAL, score 0.

    Times: ts_generated (the message's ts), ts_filter_start and ts_filter_end (of the batch that the message is in: when
    the batch was planned, and when the message has been judged), ts_sent (when it is rendered). They don't decrease.
    """
    find = matching.matcher(lexicon)
    begun = messages.withColumns({"text": F.col("content"), "ts_filter_start": F.current_timestamp()})
    joined = begun.join(config, "channel_id", "left").withColumn("level", F.coalesce("level", F.lit("MEDIUM")))
    rows = joined.withColumn("hits", find(F.col("text")))
    words = F.arrays_zip(F.col("hits.word").alias("word"), F.col("hits.wtype").alias("wtype"))
    rows = scored(judged(rows.withColumn("detected_words", words), triggers))
    action = scoring.decide(F.col("level"), F.col("n_detected") > 0, F.col("has_blacklist"), F.col("has_trigger"))
    out = rows.withColumns({"action": action, "ts_filter_end": judged_at(F.col("masked"))})
    shown = text.display_text(F.col("action"), F.coalesce("mode", F.lit("MASK")), F.col("content"), F.col("masked"), F.coalesce("placeholder", F.lit("")))
    out = out.withColumn("shown", shown).withColumn("ts_sent", judged_at(F.concat_ws("", "shown", F.col("ts_filter_end").cast("string"))))
    kept = [c for c in messages.columns if c != "text"]
    return out.select(*kept, "level", "action", "score", "detected_words", "masked", "shown", F.col("ts").alias("ts_generated"), "ts_filter_start", "ts_filter_end", "ts_sent")


@F.arrow_udf("timestamp")
def judged_at(done: pa.Array) -> pa.Array:
    """The time at which a value is there (current_timestamp is the same for a whole batch)."""
    return pa.array([datetime.now(UTC)] * len(done), pa.timestamp("us", "UTC"))


def latency(moderated: DataFrame) -> DataFrame:
    """id, action and milliseconds from one time to the next, as sources.readers.write_latency and analytics.latency_stats take them."""
    ms = lambda a, b: F.unix_micros(b) / 1000 - F.unix_micros(a) / 1000
    return moderated.select(
        "id", "action", ms("ts_filter_start", "ts_filter_end").alias("filter_ms"), ms("ts_generated", "ts_filter_start").alias("fetcher_to_filter_ms"),
        ms("ts_filter_end", "ts_sent").alias("server_to_client_ms"), F.lit(None).cast("double").alias("e2e_render_ms"), ms("ts_generated", "ts_sent").alias("total_ms"),
    )


def broadcast_sessions(moderated: DataFrame, gap: str = "3 minutes") -> DataFrame:
    """Sessions of a watermarked stream, by source and channel."""
    return sessions(moderated, ["source", "channel_id"], gap)


def fan_out(messages: DataFrame, sinks: list[Callable[[DataFrame], None]], checkpoint: str):
    """One query whose batches go to several sinks."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch)
        batch.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
