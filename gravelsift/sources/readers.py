"""Readers: lexicon files, text lines, chat landings, and the writers that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gravelsift.functions.text import strip

BOM = "\ufeff"
ROOT_SCORE, VARIANT_SCORE, DEFAULT_POS = 5.0, 3.0, "NNG"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """category, root, word, pos, score, is_root of a JSON file {category: {root: {pos, variants} or [variants]}}.

    Categories that begin with _ and values that are no objects are skipped, empty variants too. Bad JSON raises.
    """
    text = spark.read.text(path, wholetext=True)
    by_category = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    categories = text.select(F.explode(by_category).alias("category", "body")).where("not startswith(category, '_') and ltrim(body) like '{%'")
    roots = categories.select("category", F.explode(F.from_json("body", "map<string,string>")).alias("root", "payload"))
    listed = F.ltrim("payload").startswith("[")
    as_object = F.from_json("payload", "pos string, variants array<string>")
    variants = F.when(listed, F.from_json("payload", "array<string>")).otherwise(as_object["variants"])
    pos = F.coalesce(F.when(~listed, as_object["pos"]), F.lit(DEFAULT_POS))
    entries = F.concat(
        F.array(F.struct(F.col("root").alias("word"), pos.alias("pos"), F.lit(ROOT_SCORE).alias("score"), F.lit(True).alias("is_root"))),
        F.transform(
            F.filter(F.coalesce(variants, F.array().cast("array<string>")), lambda v: v != ""),
            lambda v: F.struct(v.alias("word"), F.lit(DEFAULT_POS).alias("pos"), F.lit(VARIANT_SCORE).alias("score"), F.lit(False).alias("is_root")),
        ),
    )
    return roots.select("category", "root", F.explode(entries).alias("x")).select("category", "root", "x.*")


def text_lines(rows: DataFrame, text_col: str = "value", *keep: str) -> DataFrame:
    """Stripped, non-blank lines of a text column, as `line`."""
    cut = rows.select(*keep, F.explode(F.split(text_col, "\n")).alias("line"))
    return cut.withColumn("line", strip(F.col("line"))).where("length(line) > 0")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return text_lines(spark.read.text(path))


def normalize_chat(raw: DataFrame) -> DataFrame:
    """id, author, content, ts of received messages; those with null or empty content go, nameless authors become Anonymous.

    A message without an id gets one from its source, time and user id (of raw without user_id: its author).
    """
    user = F.col("user_id") if "user_id" in raw.columns else F.col("author")
    made = F.concat_ws("-", F.lower("source"), F.col("ts_received_ms").cast("string"), F.coalesce(user.cast("string"), F.lit("anonymous")))
    kept = raw.where("content is not null and content <> ''")
    return kept.select(F.coalesce("id", made).alias("id"), "source", "channel_id", F.coalesce("author", F.lit("Anonymous")).alias("author"), "content", F.timestamp_millis("ts_received_ms").alias("ts"))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def write_candidates(candidates: DataFrame, path: str) -> None:
    """Review candidates as CSV files with a header and an empty human_label, a folder for each module; added to what is there.

    Files begin with a byte order mark, which spreadsheets read as UTF-8: the first column's name carries it.
    """
    if "human_label" not in candidates.columns:
        candidates = candidates.withColumn("human_label", F.lit(""))
    first = next(c for c in candidates.columns if c != "module")
    marked = candidates.withColumnRenamed(first, f"{BOM}{first}")
    marked.write.mode("append").partitionBy("module").option("header", True).option("emptyValue", "").csv(path)


def write_latency(samples: DataFrame, path: str) -> None:
    samples.select("id", "action", "filter_ms", "fetcher_to_filter_ms", "server_to_client_ms", "e2e_render_ms", "total_ms").write.mode("overwrite").option("header", True).csv(path)


def topic(url):
    """A topic's name: the last part of a URL's path, underscores as spaces."""
    return F.replace(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]+)/*$", 1), F.lit("_"), F.lit(" "))


def video_metadata(raw: DataFrame, categories: dict[str, str]) -> DataFrame:
    """raw (title, channelId, description, tags, categoryId, commentCount, topicUrls) with category, topics and a count of 0 for none.

    categories: the service's few dozen names by number.
    """
    names = F.create_map(*(F.lit(x) for kv in categories.items() for x in kv)) if categories else F.create_map().cast("map<string,string>")
    return raw.withColumns({
        "category": F.coalesce(names[F.col("categoryId").cast("string")], F.lit("")),
        "topics": F.transform(F.coalesce("topicUrls", F.array().cast("array<string>")), topic),
        "commentCount": F.coalesce(F.col("commentCount").cast("int"), F.lit(0)),
        "tags": F.coalesce("tags", F.array().cast("array<string>")),
    }).drop("topicUrls")


def of_owner(videos: DataFrame, channel_id: str) -> DataFrame:
    """The videos of the channel that a user has shown to be theirs."""
    return videos.where(F.col("channelId") == channel_id)
