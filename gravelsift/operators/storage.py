"""Keyed tables: caches with expiry, upserts, user lists, settings. All return new DataFrames; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.functions.text import clean_word, strip

#: What a new overlay begins with, and what its columns may hold.
OVERLAY = {
    "name": "더미테스트", "channel_id": None, "source": "DUMMY", "security_level": "MEDIUM", "block_display_mode": "MASK", "placeholder_text": "[안전 정책에 따라 차단된 메시지]",
    "show_score": False, "use_ai_filter": True,
}
CHOICES = {"source": ("DUMMY", "CHZZK", "YOUTUBE"), "security_level": ("LOW", "MEDIUM", "HIGH"), "block_display_mode": ("MASK", "HIDE", "PLACEHOLDER")}
LONGEST = {"name": 100, "channel_id": 100, "placeholder_text": 50}


def cache_hits(requests: DataFrame, cache: DataFrame, keys: list[str], now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses). Entries that expire at or before `now` don't count; now is a parameter."""
    live = cache if now is None else cache.where(F.col("expires_at") > now)
    return requests.join(live, keys), requests.join(live, keys, "left_anti")


def microseconds(duration: str) -> int:
    """'5 minutes' and the like."""
    n, unit = duration.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1_000_000


def cache_lookup(rows: DataFrame, keys: list[str], ttl: str, refresh: str = "0 seconds") -> DataFrame:
    """keys, at (microseconds), written, value, state (hit, refresh or miss) of each request among rows (keys, ts, value).

    A row with a value is a write, one without is a request. A request meets the last write up to its time (of one time the
    largest value) if it isn't older than ttl; with less than `refresh` left its entry is to be written anew.

    No key is one task: time is cut into spans of ttl, so that a request can meet only the writes of its own span, in a
    window by key and span, and the last write of the span before, which is joined.
    """
    life, spare = microseconds(ttl), microseconds(refresh)
    timed = rows.select(*keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value").withColumn("_span", F.floor(F.col("at") / life))
    write = F.when(F.col("value").isNotNull(), F.struct("at", "value"))
    own = F.max(write).over(Window.partitionBy(*keys, "_span").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    asked = timed.withColumn("_own", own).where("value is null").drop("value")
    last = timed.where("value is not null").groupBy(*keys, (F.col("_span") + 1).alias("_span")).agg(F.max(F.struct("at", "value")).alias("_last"))
    met = asked.join(last, [*keys, "_span"], "left").withColumn("_w", F.coalesce("_own", "_last"))
    left = F.col("_w.at") + life - F.col("at")
    live = F.col("_w").isNotNull() & (left > 0)
    state = F.when(~live, "miss").when(left < spare, "refresh").otherwise("hit")
    return met.select(*keys, "at", F.when(live, F.col("_w.at")).alias("written"), F.when(live, F.col("_w.value")).alias("value"), state.alias("state"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], seen: str = "last_seen_at", created: str = "created_at") -> DataFrame:
    """The newest row of each key (new rows win ties), with the oldest creation time."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys)
    ranked = both.withColumn("_n", F.row_number().over(w.orderBy(F.desc(seen), F.desc("_new")))).withColumn(created, F.min(created).over(w))
    return ranked.where("_n = 1").drop("_n", "_new")


def bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def upsert_stored(rows: DataFrame, path: str, keys: list[str], buckets: int = 64, seen: str = "last_seen_at", created: str = "created_at") -> None:
    """Upsert rows into the Parquet table at path, which is partitioned into buckets by a hash of the keys.

    Only the partitions that rows touch are read, and only they are replaced (dynamic partition overwrite), so the work
    follows the rows and not the table, and a partition is replaced as a whole or not at all. The same rows again change
    nothing. Of several rows of a key the newest counts. buckets: the same number for the life of a table.
    """
    spark = rows.sparkSession
    new = bucketed(rows, keys, buckets)
    newest = upsert(new.where("false"), new, keys, seen, created)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        table = spark.read.schema(new.schema).parquet(path).where(F.col("bucket").isin(touched))
        newest = upsert(table, newest, keys, seen, created)
    newest.select(*new.columns).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str, buckets: int = 64, seen: str = "last_seen_at", created: str = "created_at"):
    """A query that upserts each batch of a stream; a batch that is run again after a failure changes nothing."""
    write = lambda batch, _: upsert_stored(batch, path, keys, buckets, seen, created)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def add_words(table: DataFrame, words: DataFrame) -> DataFrame:
    """user_id, word, list_type; a word that the user has already stays as it is. Words are trimmed and lower-cased."""
    clean = words.select("user_id", clean_word(F.col("word")).alias("word"), "list_type").where("word <> ''")
    fresh = clean.groupBy("user_id", "word").agg(F.min("list_type").alias("list_type")).join(table, ["user_id", "word"], "left_anti")
    return table.select("user_id", "word", "list_type").unionByName(fresh)


def remove_words(table: DataFrame, words: DataFrame) -> DataFrame:
    """Without (user_id, word), whichever list they are on."""
    return table.join(words.select("user_id", clean_word(F.col("word")).alias("word")), ["user_id", "word"], "left_anti")


def net_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: added, removed."""
    left, right = before.select("user_id", "word").distinct().withColumn("a", F.lit(1)), after.select("user_id", "word").distinct().withColumn("b", F.lit(1))
    both = left.join(right, ["user_id", "word"], "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"))


def user_lists(words: DataFrame) -> DataFrame:
    """user_id, white, black: sorted arrays; their size is a user's dictionary."""
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("list_type") == kind, F.col("word"))))
    return words.groupBy("user_id").agg(pick("WHITELIST").alias("white"), pick("BLACKLIST").alias("black"))


def patch(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns that a change names in its array `given`; a null that is given counts."""
    renamed = changes.select(key, "given", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(renamed, key, "left")
    new = {c: F.when(F.array_contains("given", c), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*table.columns)


def mark(table: DataFrame, selected: DataFrame, key: str, flag: str) -> DataFrame:
    """A flag that is set where the key is selected and never unset."""
    chosen = selected.select(key).distinct().withColumn("_on", F.lit(True))
    return table.join(chosen, key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("_on", F.lit(False))).select(*table.columns)


def of_user(users: DataFrame, user_id: int | None = None, name: str | None = None) -> DataFrame:
    """The user of an id, or else of a name."""
    return users.where(F.col("user_id") == user_id) if user_id is not None else users.where(F.col("username") == name)


def session_list(sessions: DataFrame, owner: str = "owner_user_id") -> DataFrame:
    """sessions with place (from 1) in their owner's list: the last begun first, of one time the larger session_id."""
    return sessions.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("started_at"), F.desc("session_id"))))


def messages_of(messages: DataFrame, sessions: DataFrame, owner_user_id: Column, owner: str = "owner_user_id") -> DataFrame:
    """The messages (session_id, ...) of sessions that belong to the owner; those of others' sessions don't show."""
    return messages.join(sessions.where(F.col(owner) == owner_user_id).select("session_id").distinct(), "session_id", "left_semi")


def get_or_create(owners: DataFrame, configs: DataFrame) -> DataFrame:
    """owner_user_id and the columns of OVERLAY of every owner: the config of its smallest id, or a new one."""
    least = configs.groupBy("owner_user_id").agg(F.min_by(F.struct(*OVERLAY), "id").alias("c"))
    joined = owners.select("owner_user_id").distinct().join(least, "owner_user_id", "left")
    types = {f.name: f.dataType for f in configs.schema}
    return joined.select("owner_user_id", *(F.when(F.col("c").isNull(), F.lit(v).cast(types[k])).otherwise(F.col(f"c.{k}")).alias(k) for k, v in OVERLAY.items()))


def update_overlay(configs: DataFrame, requests: DataFrame) -> DataFrame:
    """configs (owner_user_id, OVERLAY, whitelist, blacklist) after requests of the same columns: null leaves a column as it
    is, but a request that gives either list replaces both, the other by an empty one. Words are stripped, blank ones go."""
    asked = requests.select("owner_user_id", *(F.col(c).alias(f"_{c}") for c in (*OVERLAY, "whitelist", "blacklist")))
    joined = configs.join(asked, "owner_user_id", "left")
    given = F.col("_whitelist").isNotNull() | F.col("_blacklist").isNotNull()

    def words(c: str) -> Column:
        clean = F.transform(F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>")), lambda w: clean_word(w, lower=False))
        return F.when(given, F.array_distinct(F.filter(clean, lambda w: w != ""))).otherwise(F.col(c))

    return joined.withColumns({**{c: F.coalesce(f"_{c}", c) for c in OVERLAY}, "whitelist": words("whitelist"), "blacklist": words("blacklist")}).select(*configs.columns)


def faults(requests: DataFrame) -> DataFrame:
    """requests with `faults`, the sorted columns of values that aren't among CHOICES, are too long, or of blank or long words."""
    wrong = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.lit(c)) for c, values in CHOICES.items()]
    wrong += [F.when(F.length(c) > most, F.lit(c)) for c, most in LONGEST.items()]
    wrong += [F.when(F.exists(c, lambda w: w.isNull() | (F.length(strip(w)) == 0) | (F.length(w) > 100)), F.lit(c)) for c in ("whitelist", "blacklist")]
    return requests.withColumn("faults", F.array_sort(F.array_compact(F.array(*wrong))))
