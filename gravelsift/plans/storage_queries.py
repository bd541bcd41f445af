"""Caches, upserts, user lists and settings over the star schema, whose tables stand in for users and their data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.operators import storage
from gravelsift.plans.registry import query, table
from gravelsift.sources.readers import first_seen


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderdate").cast("date").alias("expires_at"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE CAST(o_orderdate AS DATE) > DATE '1998-03-01'")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = storage.cache_hits(table(spark, sf_dir, "customer").select("c_custkey"), _cache(spark, sf_dir), ["c_custkey"], F.lit("1998-03-01").cast("date"))
    return hits.select("c_custkey", "o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1998-03-01')")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, misses = storage.cache_hits(table(spark, sf_dir, "customer").select("c_custkey"), _cache(spark, sf_dir), ["c_custkey"], F.lit("1998-03-01").cast("date"))
    return misses


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, min(ts) OVER (PARTITION BY user_id, event_type) AS created_at FROM e)
SELECT user_id, event_type, ts AS last_seen_at, created_at FROM r WHERE n = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("last_seen_at"), F.col("ts").alias("created_at"), "event_id")
    old, new = rows.where("event_id % 2 = 0").drop("event_id"), rows.where("event_id % 2 = 1").drop("event_id")
    return storage.upsert(old, new, ["user_id", "event_type"])


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_seen_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_seen(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


_WORDS = "w AS (SELECT DISTINCT o_custkey AS user_id, lower(o_orderpriority) AS word, CASE WHEN length(o_orderpriority) % 2 = 0 THEN 'WHITELIST' ELSE 'BLACKLIST' END AS list_type FROM orders)"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.length("o_orderpriority") % 2 == 0, "WHITELIST").otherwise("BLACKLIST")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.lower("o_orderpriority").alias("word"), kind.alias("list_type")).distinct()


@query(f"""
WITH {_WORDS} SELECT user_id, coalesce(string_agg(word, ',' ORDER BY word) FILTER (WHERE list_type = 'WHITELIST'), '') AS white,
    coalesce(string_agg(word, ',' ORDER BY word) FILTER (WHERE list_type = 'BLACKLIST'), '') AS black, count(*) AS size FROM w GROUP BY user_id
""")
def user_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = storage.user_lists(_words(spark, sf_dir))
    return lists.select("user_id", F.array_join("white", ",").alias("white"), F.array_join("black", ",").alias("black"), (F.size("white") + F.size("black")).cast("long").alias("size"))


@query(f"""
WITH {_WORDS}, n AS (SELECT user_id, '1-urgent' AS word FROM w GROUP BY user_id)
SELECT count(*) FILTER (WHERE added) AS added, count(*) FILTER (WHERE removed) AS removed FROM (
    SELECT true AS added, false AS removed FROM (SELECT * FROM n EXCEPT SELECT user_id, word FROM w)
    UNION ALL SELECT false, true FROM w WHERE word = '5-low' AND user_id % 2 = 0)
""")
def dictionary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _words(spark, sf_dir)
    users = words.select("user_id").distinct()
    more = storage.add_words(words, users.select("user_id", F.lit(" 1-URGENT ").alias("word"), F.lit("BLACKLIST").alias("list_type")))
    fewer = storage.remove_words(more, users.where("user_id % 2 = 0").select("user_id", F.lit("5-Low").alias("word")))
    return storage.net_change(words, fewer)


@query("""
SELECT p_brand, array_to_string(list_sort(list_filter(n, lambda x: NOT list_contains(o, x))), ',') AS added, array_to_string(list_sort(list_filter(o, lambda x: NOT list_contains(n, x))), ',') AS deleted
FROM (SELECT p_brand, coalesce(list(DISTINCT p_type) FILTER (WHERE p_partkey % 2 = 0), []) AS o, coalesce(list(DISTINCT p_type) FILTER (WHERE p_partkey % 2 = 1), []) AS n FROM part GROUP BY p_brand)
""")
def dictionary_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_partkey") % 2 == 0
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set(F.when(even, F.col("p_type"))).alias("o"), F.collect_set(F.when(~even, F.col("p_type"))).alias("n"))
    join = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return lists.select("p_brand", join("n", "o").alias("added"), join("o", "n").alias("deleted"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'HIGH' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name FROM customer
""")
def settings_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    changes = users.where("c_custkey % 3 = 0").select("c_custkey", F.lit("HIGH").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"), F.array(F.lit("c_mktsegment"), F.lit("c_name")).alias("given"))
    return storage.patch(users, changes, "c_custkey", ["c_mktsegment", "c_name"])


@query("SELECT o_orderkey, o_orderkey % 5 = 0 OR o_custkey % 7 = 0 AS flagged FROM orders")
def relearn_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5 == 0).alias("flagged"))
    return storage.mark(rows, rows.where("o_custkey % 7 = 0"), "o_orderkey", "flagged").select("o_orderkey", "flagged")


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS owners, count(o_orderkey) AS messages FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name
""")
def owners_and_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    owners = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # orders are counted by owner before the join, so that only one row for each owner is shuffled further
    messages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("m"))
    joined = owners.join(messages, "c_custkey", "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("owners"), F.coalesce(F.sum("m"), F.lit(0)).alias("messages"))


def _overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(
        F.col("c_custkey").alias("owner_user_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("channel_id"), F.lit("DUMMY").alias("source"),
        F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.col("c_nationkey") % 3 + 1).cast("int")).alias("security_level"), F.lit("MASK").alias("block_display_mode"),
        F.lit("-").alias("placeholder_text"), F.lit(False).alias("show_score"), F.lit(True).alias("use_ai_filter"),
        F.array("c_mktsegment").alias("whitelist"), F.array(F.lit("x")).alias("blacklist"),
    )


@query("""
SELECT c_custkey AS owner_user_id, CASE WHEN c_custkey % 3 = 0 THEN 'CHZZK' ELSE 'DUMMY' END AS source, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS channel_id,
    CASE c_nationkey % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS security_level,
    CASE WHEN c_custkey % 6 = 0 THEN 'a,B' ELSE c_mktsegment END AS white, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'x' END AS black FROM customer
""")
def overlay_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third owner changes source and channel; every sixth gives a white list, which replaces both."""
    configs = _overlays(spark, sf_dir)
    asked = configs.where("owner_user_id % 3 = 0").select(
        "owner_user_id", *(F.lit(None).cast(configs.schema[c].dataType).alias(c) for c in storage.OVERLAY if c not in ("source", "channel_id")), F.lit("CHZZK").alias("source"),
        F.element_at("whitelist", 1).alias("channel_id"), F.when(F.col("owner_user_id") % 6 == 0, F.array(F.lit(" a\t"), F.lit(" "), F.lit("B"), F.lit("a"))).alias("whitelist"), F.lit(None).cast("array<string>").alias("blacklist"),
    )
    made = storage.update_overlay(configs, asked)
    return made.select("owner_user_id", "source", "channel_id", "security_level", F.array_join("whitelist", ",").alias("white"), F.array_join("blacklist", ",").alias("black"))


@query("""
SELECT n_nationkey AS owner_user_id, coalesce(c.name, '더미테스트') AS name, coalesce(c.level, 'MEDIUM') AS security_level FROM nation LEFT JOIN (
    SELECT s_nationkey, arg_min(s_name, s_suppkey) AS name, arg_min(CASE WHEN s_acctbal < 0 THEN 'LOW' ELSE 'HIGH' END, s_suppkey) AS level FROM supplier GROUP BY s_nationkey) c ON s_nationkey = n_nationkey
""")
def overlay_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The config of each nation: that of its first supplier, or a new one."""
    level = F.when(F.col("s_acctbal") < 0, "LOW").otherwise("HIGH")
    values = {"name": F.col("s_name"), "security_level": level, "show_score": F.lit(True), "use_ai_filter": F.lit(True)}
    configs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("owner_user_id"), *(values.get(c, F.lit("s")).alias(c) for c in storage.OVERLAY))
    owners = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("owner_user_id"))
    return storage.get_or_create(owners, configs).select("owner_user_id", "name", "security_level")


@query("""
SELECT c_custkey AS owner_user_id, array_to_string(list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'blacklist' END, CASE WHEN length(c_name) > 18 THEN 'name' END,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'security_level' END], lambda x: x IS NOT NULL), ',') AS faults FROM customer
""")
def overlay_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.element_at("whitelist", 1)
    asked = _overlays(spark, sf_dir).withColumns({
        "security_level": F.when(segment == "BUILDING", "ULTRA").otherwise(F.col("security_level")), "name": F.when(F.length("name") > 18, F.repeat(F.col("name"), F.lit(9))).otherwise(F.col("name")),
        "blacklist": F.when(F.col("owner_user_id") % 7 == 0, F.array(F.lit("\t"))).otherwise(F.col("blacklist")),
    })
    return storage.faults(asked).select("owner_user_id", F.array_join("faults", ",").alias("faults"))


@query("""
WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN 'v' || (event_id % 50) END AS value FROM events),
l AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN t END) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM r),
w AS (SELECT user_id, t, max(value) AS value FROM r WHERE value IS NOT NULL GROUP BY user_id, t),
m AS (SELECT l.user_id, l.t AS "at", w.t AS written, w.value FROM l LEFT JOIN w ON w.user_id = l.user_id AND w.t = l.last AND l.t - w.t < 21600000000 WHERE l.value IS NULL)
SELECT user_id, "at", coalesce(written, 0) AS written, value, CASE WHEN written IS NULL THEN 'miss' WHEN written + 21600000000 - "at" < 3600000000 THEN 'refresh' ELSE 'hit' END AS state FROM m
""")
def cache_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event of a user writes an entry that lives six hours; the others ask for it."""
    value = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("v"), (F.col("event_id") % 50).cast("string")))
    found = storage.cache_lookup(table(spark, sf_dir, "events").select("user_id", "ts", value.alias("value")), ["user_id"], "6 hours", "1 hour")
    return found.withColumn("written", F.coalesce("written", F.lit(0).cast("long")))


@query("""
WITH s AS (SELECT o_orderkey AS session_id, o_custkey AS owner_user_id, CAST(o_orderdate AS DATE) AS started_at FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY owner_user_id ORDER BY started_at DESC, session_id DESC) AS place FROM s)
SELECT owner_user_id, CAST(place AS INTEGER) AS place, session_id, started_at, count(l_orderkey) AS messages, count(*) FILTER (WHERE l_returnflag = 'R') AS filtered
FROM l LEFT JOIN lineitem ON l_orderkey = session_id WHERE owner_user_id % 7 = 0 GROUP BY ALL
""")
def owner_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners' sessions, newest first, and the messages of each: orders and their items."""
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("owner_user_id"), F.col("o_orderdate").cast("date").alias("started_at"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), "l_returnflag")
    mine = F.when(F.col("owner_user_id") % 7 == 0, F.col("owner_user_id"))
    counts = storage.messages_of(items, sessions, mine).groupBy("session_id").agg(F.count("*").alias("messages"), F.count_if(F.col("l_returnflag") == "R").alias("filtered"))
    listed = storage.session_list(sessions.where("owner_user_id % 7 = 0"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return listed.join(counts, "session_id", "left").select("owner_user_id", "place", "session_id", "started_at", zero("messages"), zero("filtered"))
