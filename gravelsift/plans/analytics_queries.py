"""Reports over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.functions import scoring, text
from gravelsift.operators import ai, analytics, matching, tokens
from gravelsift.plans.match_queries import LEX_SQL, TOK_SQL, lexicon
from gravelsift.plans.registry import query, table
from gravelsift.sources import paged
from gravelsift.sources.readers import topic

#: Of equally frequent words the one first seen comes first.
_TREND = "t AS (SELECT form AS word, count(*) AS n FROM word WHERE length(form) >= 2 GROUP BY form ORDER BY n DESC, min({'d': doc_id, 'k': k}) LIMIT 20)"
_LEVEL = "['LOW', 'MEDIUM', 'HIGH'][event_id % 3 + 1]"
_ACTION = "['NORMAL', 'REVIEW', 'PARTIAL_MASK', 'FULL_BLOCK', 'NORMAL'][event_id % 5 + 1]"


def _pick(names: tuple[str, ...], n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.withColumn("action", _pick(("NORMAL", "REVIEW", "PARTIAL_MASK", "FULL_BLOCK", "NORMAL"), F.col("event_id") % 5))


@query(f"WITH {TOK_SQL}, {_TREND} SELECT word, n FROM t WHERE n >= 2")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.trending(tokens.forms(table(spark, sf_dir, "documents")))


@query(f"""WITH {LEX_SQL}, {TOK_SQL}, {_TREND}
SELECT lex.word, wtype, count(*) AS n FROM word JOIN lex ON word.form = lex.word WHERE lex.word NOT IN (SELECT word FROM t) GROUP BY lex.word, wtype""")
def filtered_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return analytics.filtered_keywords(matching.match_texts(docs, lexicon(spark), ("form",)), analytics.trending(tokens.forms(docs)))


@query(f"""
SELECT event_type, total, blocked, review, safe, CAST(floor(blocked * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS blocked_pct,
    CAST(floor(review * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS review_pct, CAST(floor(safe * 100.0::DOUBLE / total + 0.5) AS BIGINT) AS safe_pct
FROM (SELECT *, total - blocked - review AS safe FROM (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE a IN ('FULL_BLOCK', 'PARTIAL_MASK')) AS blocked,
    count(*) FILTER (WHERE a = 'REVIEW') AS review FROM (SELECT event_type, {_ACTION} AS a FROM events) GROUP BY event_type))
""")
def action_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.action_distribution(_decisions(spark, sf_dir), "event_type")


@query(f"SELECT {_ACTION} AS action, count(*) AS n FROM events GROUP BY 1")
def action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("""
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
s AS (SELECT event_type, count(*) AS n, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE i = floor(n * 0.5::DOUBLE)) AS p50,
    max(value) FILTER (WHERE i = floor(n * 0.95::DOUBLE)) AS p95, max(value) FILTER (WHERE i = floor(n * 0.99::DOUBLE)) AS p99 FROM r GROUP BY event_type)
SELECT *, CASE WHEN p50 < 30 THEN 'great' WHEN p50 < 100 THEN 'good' WHEN p50 < 200 THEN 'fair' ELSE 'poor' END AS grade FROM s
""")
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = analytics.latency_stats(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("mean", F.floor(F.col("mean") * 1e6 + 0.5) / 1e6)


@query(f"""
SELECT event_id, {_LEVEL} AS level, CASE k WHEN 0 THEN 'NORMAL' WHEN 1 THEN CASE {_LEVEL} WHEN 'LOW' THEN 'REVIEW' ELSE 'PARTIAL_MASK' END
    WHEN 2 THEN CASE {_LEVEL} WHEN 'HIGH' THEN 'FULL_BLOCK' ELSE 'PARTIAL_MASK' END ELSE CASE {_LEVEL} WHEN 'LOW' THEN 'PARTIAL_MASK' ELSE 'FULL_BLOCK' END END AS action,
    CASE {_LEVEL} WHEN 'LOW' THEN 'REVIEW' WHEN 'MEDIUM' THEN 'PARTIAL_MASK' ELSE 'FULL_BLOCK' END AS ai_action
FROM (SELECT event_id, user_id % 4 AS k FROM events)
""")
def policy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, level = F.col("user_id") % 4, _pick(("LOW", "MEDIUM", "HIGH"), F.col("event_id") % 3)
    rows = table(spark, sf_dir, "events").withColumn("level", level)
    return rows.select("event_id", "level", scoring.decide(F.col("level"), k > 0, k == 3, k == 2).alias("action"), scoring.ai_action(F.col("level")).alias("ai_action"))


@query(f"""
SELECT event_id, least(1.0::DOUBLE, s + CASE WHEN k = 1 THEN CASE WHEN {_LEVEL} = 'HIGH' THEN 0.25 ELSE 0 END WHEN k IN (2, 3) AND {_LEVEL} <> 'LOW' THEN 0.25 ELSE 0 END) AS shown
FROM (SELECT event_id, user_id % 5 AS k, (event_id % 101) / 100.0::DOUBLE AS s FROM events)
""")
def client_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, level = F.col("user_id") % 5, _pick(("LOW", "MEDIUM", "HIGH"), F.col("event_id") % 3)
    return table(spark, sf_dir, "events").select("event_id", scoring.client_score((F.col("event_id") % 101) / F.lit(100.0), level, k == 1, k == 2, k == 3).alias("shown"))


@query("""
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 3
""")
def last_n_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), "role", "text"], 3)
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""
WITH c AS (SELECT event_id AS comment_id, CASE WHEN event_id % 3 > 0 THEN event_id - event_id % 3 END AS parent_id FROM events)
SELECT p.comment_id, count(r.comment_id) AS replies FROM c p LEFT JOIN c r ON r.parent_id = p.comment_id WHERE p.parent_id IS NULL GROUP BY p.comment_id
""")
def reply_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.when(F.col("event_id") % 3 > 0, F.col("event_id") - F.col("event_id") % 3)
    return analytics.reply_counts(table(spark, sf_dir, "events").select(F.col("event_id").alias("comment_id"), up.alias("parent_id")))


_KEY = "regexp_replace(regexp_replace(lower(text), '\\s', '', 'g'), '[\\p{P}\\p{S}]', '', 'g')"


@query(f"""
WITH e AS (SELECT doc_id AS pos, source, {_KEY} AS key, 'e' || doc_id AS entry FROM documents), i AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN source ELSE 'none' END AS source, {_KEY} AS key FROM documents)
SELECT doc_id AS item_id, coalesce(a.entry, b.entry) AS entry FROM i LEFT JOIN (SELECT source, arg_max(entry, pos) AS entry FROM e GROUP BY source) a USING (source)
    LEFT JOIN (SELECT key, arg_max(entry, pos) AS entry FROM e WHERE length(key) >= 2 GROUP BY key) b USING (key)
""")
def id_or_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", text.text_key(F.col("text")))
    entries = docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("comment_id"), "key", F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("entry"))
    items = docs.select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 7 == 0, F.col("source")).otherwise("none").alias("comment_id"), "key")
    return analytics.find_entries(items, entries)


@query(f"""
WITH f AS (SELECT user_id, ts, {_ACTION} AS a, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM f)
SELECT user_id, min(ts) AS started_at, max(ts) AS last_message_at, count(*) AS message_count, count(*) FILTER (WHERE a <> 'NORMAL') AS filtered_count FROM g GROUP BY user_id, run
""")
def broadcast_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sessions(_decisions(spark, sf_dir), ["user_id"], "6 hours")


@query("""
WITH w AS (SELECT DISTINCT lower(c_mktsegment) AS norm, c_name AS word, CASE WHEN c_custkey % 10 = 0 THEN 'USER_BLACKLIST' ELSE 'SYSTEM_KEYWORD' END AS wtype FROM customer)
SELECT norm, arg_min(word, k) AS original, arg_min(wtype, k) AS wtype FROM (SELECT *, CASE wtype WHEN 'USER_BLACKLIST' THEN '0' ELSE '1' END || word AS k FROM w) GROUP BY norm
""")
def filter_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 10 == 0, "USER_BLACKLIST").otherwise("SYSTEM_KEYWORD")
    words = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("norm"), F.col("c_name").alias("word"), kind.alias("wtype")).distinct()
    return analytics.filter_dictionary(words)


@query("""
SELECT l.toxic, count(*) AS n, count(*) FILTER (WHERE h) AS flagged FROM (SELECT doc_id, position('idiot' IN text) > 0 OR position('trash' IN text) > 0 AS h FROM documents) d JOIN labels l USING (doc_id) GROUP BY l.toxic
""")
def label_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "documents").select("doc_id", text.any_contains(F.col("text"), ["idiot", "trash"]).alias("h"))
    return flagged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("h").alias("flagged"))


@query("""
SELECT page_id, replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1), '_', ' ') AS topic FROM pages
""")
def url_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", topic(F.col("url")).alias("topic"))


@query("SELECT lang, source, count(*) AS subscribers, count(*) FILTER (WHERE doc_id % 5 = 0) AS locked FROM documents GROUP BY lang, source")
def hub_subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = F.count("*").alias("subscribers"), F.count_if(F.col("doc_id") % 5 == 0).alias("locked")
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(*counts)


@query("""
SELECT p_brand, array_to_string(list_slice(t, 1, 15), ',') AS shown, greatest(len(t) - 15, 0) AS more FROM (SELECT p_brand, list_sort(list(DISTINCT p_type)) AS t FROM part GROUP BY p_brand)
""")
def tag_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t"))
    return tags.select("p_brand", F.array_join(F.slice("t", 1, 15), ",").alias("shown"), F.greatest(F.size("t") - 15, F.lit(0)).cast("long").alias("more"))


@query("""
SELECT event_id, 'e' || user_id AS word, 1 / (1 + exp(-l)) AS score, a * greatest(l, 0.0::DOUBLE) AS evidence
FROM (SELECT *, (event_id % 21 - 10) / 4.0::DOUBLE AS l, (user_id % 10) / 10.0::DOUBLE AS a FROM events)
""")
def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    logit, attention = (F.col("event_id") % 21 - 10) / F.lit(4.0), (F.col("user_id") % 10) / F.lit(10.0)
    word = F.concat(F.lit("e"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", word.alias("word"), ai.sigmoid(logit).alias("score"), ai.token_evidence(attention, logit).alias("evidence"))


#: The events of a part of a page lie within so many ids: a page has as many parts as it needs.
PART = 100_000
_PAGES = """e AS (SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS video_id, event_id // 40 % 9 + 1 AS page, 'c' || (event_id // 5 % 211) AS id, event_id % 4 AS n_replies FROM events),
top AS (SELECT video_id, page, event_id AS item, 0 AS kind, 0 AS rp, 0 AS pos, id, CAST(NULL AS VARCHAR) AS parent_id, 't' || event_id AS text FROM e),
near AS (SELECT video_id, page, event_id AS item, 1 AS kind, 0 AS rp, k AS pos, 'r' || (event_id * 7 + k) % 307 AS id, id AS parent_id, 'n' || event_id || '-' || k AS text FROM (SELECT *, unnest(range(least(n_replies, 2))) AS k FROM e)),
rep AS (SELECT DISTINCT video_id, id AS parent_id, unnest(range(1, 13)) AS rp FROM e),
more AS (SELECT e.video_id, e.page, event_id AS item, 2 AS kind, rp, k AS pos, 'r' || (length(rep.parent_id) * 31 + rp * 13 + k + CAST(e.video_id AS INTEGER)) % 307 AS id, rep.parent_id, 'm' || rep.parent_id || '-' || rp || '-' || k AS text
    FROM e JOIN rep ON rep.video_id = e.video_id AND rep.parent_id = e.id, (SELECT unnest(range(2)) AS k) WHERE n_replies > 2 AND rp <= 10)"""


@query(f"""WITH {_PAGES}, every AS (SELECT * FROM top UNION ALL SELECT * FROM near UNION ALL SELECT * FROM more),
met AS (SELECT * FROM every WHERE page <= 8 QUALIFY row_number() OVER (PARTITION BY video_id, id ORDER BY page, item, kind, rp, pos) = 1),
last AS (SELECT video_id, min(page) AS last FROM (SELECT DISTINCT video_id, page FROM e WHERE page <= 8) p WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.video_id = p.video_id AND met.page = p.page AND kind < 2) GROUP BY video_id)
SELECT video_id, id AS comment_id, parent_id, text FROM met LEFT JOIN last USING (video_id) WHERE last IS NULL OR page <= last""")
def paged_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of comments and of replies, landed as JSON, pages in parts of a range of events; ids come again on other pages, and some pages add nothing."""
    video = (F.col("user_id") % 40).cast("string")
    e = table(spark, sf_dir, "events").select(
        "event_id", video.alias("video_id"), F.expr("event_id div 40 % 9 + 1").alias("page"), F.expr("concat('c', event_id div 5 % 211)").alias("id"), (F.col("event_id") % 4).alias("n"), F.expr(f"event_id div {PART}").alias("part")
    )
    near = F.expr("transform(if(n = 0, array(), sequence(0L, least(n, 2L) - 1)), k -> named_struct('id', concat('r', (event_id * 7 + k) % 307), 'text', concat('n', event_id, '-', k)))")
    item = F.struct(F.col("event_id").alias("item"), "id", F.concat(F.lit("t"), F.col("event_id")).alias("text"), F.col("n").alias("total_replies"), near.alias("replies"))
    pages = e.groupBy("video_id", "page", "part").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("body"))
    reply = F.expr("transform(array(0, 1), k -> named_struct('id', concat('r', (length(parent_id) * 31 + page * 13 + k + int(video_id)) % 307), 'text', concat('m', parent_id, '-', page, '-', k)))")
    replies = e.select("video_id", F.col("id").alias("parent_id")).distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(12))))
    replies = replies.select("video_id", "parent_id", "page", F.to_json(F.struct(reply.alias("items"))).alias("body"))
    return paged.threads(pages, replies, max_pages=8).select("video_id", "comment_id", "parent_id", "text")
