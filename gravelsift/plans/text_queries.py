"""Text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.functions import scoring, text
from gravelsift.plans.registry import query, table

MODULES = ("basic", "criticism", "family", "pii", "politics", "sexual", "spam")


@query("""
SELECT doc_id, md5(n) AS normalized_md5, length(n) AS normalized_length FROM (
    SELECT doc_id, regexp_replace(regexp_replace(text, '([가-힣A-Za-z])[^가-힣A-Za-z\\s]{1,2}([가-힣A-Za-z])', '\\1\\2', 'g'),
        '([가-힣A-Za-z])[^가-힣A-Za-z\\s]{1,2}([가-힣A-Za-z])', '\\1\\2', 'g') AS n FROM documents)
""")
def compact_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.compact_normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(n).alias("normalized_md5"), F.length(n).cast("long").alias("normalized_length"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS nonspace FROM documents")
def nonspace_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.nonspace_length(F.col("text")).cast("long").alias("nonspace"))


@query("""
SELECT doc_id, len(regexp_extract_all(text, '[ㄱ-ㅎ]')) AS consonants, len(regexp_extract_all(text, '[ㅏ-ㅣ]')) AS vowels,
    len(regexp_extract_all(text, '[^\\s\\p{L}\\p{N}]')) AS specials FROM documents
""")
def char_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    counts = {"consonants": text.lone_consonants(t), "vowels": text.lone_vowels(t), "specials": text.specials(t)}
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in counts.items()))


@query("SELECT doc_id, md5(regexp_replace(lower(text), '[^가-힣a-zA-Z0-9\\s]', '', 'g')) AS legacy_md5 FROM documents")
def legacy_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.legacy_normalize(F.col("text"))).alias("legacy_md5"))


@query("SELECT page_id, md5(regexp_replace(regexp_replace(lower(html), '\\s', '', 'g'), '[\\p{P}\\p{S}]', '', 'g')) AS key_md5 FROM pages")
def text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.text_key(F.col("html"))).alias("key_md5"))


@query("""
WITH k AS (SELECT doc_id, string_split(lower(regexp_replace(text, '[^가-힣ㄱ-ㅣA-Za-z0-9]', '', 'g')), '') AS c FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '')) AS jamo_md5 FROM k
""")
def jamo_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.jamo_normalize(F.col("text"))).alias("jamo_md5"))


_HANGUL = "[chr(CAST(44032 + doc_id * 37 % 11172 AS INTEGER)), 'ㅏ', chr(CAST(44032 + doc_id * 589 % 11172 AS INTEGER)), 'ㅣ', chr(CAST(44032 + doc_id * 11 % 11172 AS INTEGER))]"


@query(f"""
WITH c AS (SELECT doc_id, unnest({_HANGUL}) AS ch, generate_subscripts({_HANGUL}, 1) AS k FROM documents),
d AS (SELECT doc_id, k, CASE WHEN unicode(ch) BETWEEN 44032 AND 55203 THEN substring('{text.CHO}', (unicode(ch) - 44032) // 588 + 1, 1) || substring('{text.JUNG}', (unicode(ch) - 44032) % 588 // 28 + 1, 1)
    || CASE WHEN (unicode(ch) - 44032) % 28 = 0 THEN '' ELSE substring('{"".join(text.JONG)}', (unicode(ch) - 44032) % 28, 1) END ELSE ch END AS jamo FROM c),
j AS (SELECT doc_id, string_split(translate(string_agg(jamo, '' ORDER BY k), '{text.TENSE}', '{text.PLAIN}'), '') AS x FROM d GROUP BY doc_id)
SELECT doc_id, array_to_string(list_filter(x, lambda y, i: i = 1 OR y <> x[i - 1]), '') AS jamo FROM j
""")
def jamo_of_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syllables made from ids, with Latin keys and filler between them."""
    one = lambda k: text.code_point(F.lit(44032) + F.col("doc_id") * k % 11172)
    return table(spark, sf_dir, "documents").select("doc_id", text.jamo_normalize(F.concat(one(37), F.lit("A"), one(589), F.lit("-1!"), one(11))).alias("jamo"))


@query("""
SELECT doc_id, md5(replace(replace(replace(text, 'idiot', '*****'), 'tion', '****'), 'th', '**')) AS masked_md5,
    length(replace(replace(replace(text, 'idiot', '*****'), 'tion', '****'), 'th', '**')) AS n FROM documents
""")
def replace_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.star_mask(F.col("text"), F.array(F.lit("idiot"), F.lit("tion"), F.lit("th")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(m).alias("masked_md5"), F.length(m).cast("long").alias("n"))


@query("""
SELECT doc_id, md5(replace(replace(replace(text, 'tion', '****'), 'the', '***'), 'th', '**')) AS masked_md5 FROM documents
""")
def token_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = text.token_mask(F.col("text"), F.array(*map(F.lit, ("th", "the", "tion", "the"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(m).alias("masked_md5"))


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE CAST(len(regexp_extract_all(replace(text, 'tion', '****'), '\\*')) AS DOUBLE) / n END AS ratio
FROM (SELECT doc_id, text, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM documents)
""")
def keyword_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = text.star_mask(F.col("text"), F.array(F.lit("tion")))
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_ratio(masked, F.col("text")).alias("ratio"))


@query("""
SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE floor(least(s / n, 0.33::DOUBLE) / 0.33::DOUBLE * 25 * 100 + 0.5) / 100 END AS points FROM (
    SELECT doc_id, CAST(length(regexp_replace(text, '\\s', '', 'g')) AS DOUBLE) AS n,
        CAST(len(regexp_extract_all(text, '[ㄱ-ㅎ]')) + len(regexp_extract_all(text, '[^\\s\\p{L}\\p{N}]')) AS DOUBLE) AS s FROM documents)
""")
def normal_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scoring.normal_bucket(F.col("text")).alias("points"))


@query("""
SELECT conv_id, turn, CASE WHEN action IN ('NORMAL', 'REVIEW') THEN text WHEN mode = 'HIDE' THEN NULL WHEN mode = 'PLACEHOLDER' THEN '[hidden]'
    ELSE replace(text, 'e', '*') END AS shown
FROM (SELECT *, ['NORMAL', 'REVIEW', 'PARTIAL_MASK', 'FULL_BLOCK'][conv_id % 4 + 1] AS action, ['HIDE', 'PLACEHOLDER', 'MASK'][turn % 3 + 1] AS mode FROM conversations)
""")
def block_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = F.array(*map(F.lit, ("NORMAL", "REVIEW", "PARTIAL_MASK", "FULL_BLOCK")))
    modes = F.array(*map(F.lit, ("HIDE", "PLACEHOLDER", "MASK")))
    action, mode = F.element_at(actions, (F.col("conv_id") % 4 + 1).cast("int")), F.element_at(modes, (F.col("turn") % 3 + 1).cast("int"))
    shown = text.display_text(action, mode, F.col("text"), F.replace("text", F.lit("e"), F.lit("*")), F.lit("[hidden]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", shown.alias("shown"))


@query("""
SELECT user_id, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'basic,criticism,family,pii,politics,sexual,spam' ELSE 'basic,' || event_type END AS modules, count(*) AS n
FROM events GROUP BY ALL
""")
def modules_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("user_id") % 3 == 0, " ").when(F.col("user_id") % 3 == 1, "all").otherwise(F.concat(F.lit(" Basic ,,"), F.upper("event_type")))
    parsed = F.array_join(text.parse_modules(raw, MODULES), ",")
    return table(spark, sf_dir, "events").groupBy("user_id", parsed.alias("modules")).agg(F.count("*").alias("n"))


@query("""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages
""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", *(text.query_parameter(F.col("url"), n).alias(n) for n in ("page", "utm_source")))


@query("SELECT doc_id, replace(left(text, 20), chr(10), ' ') AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("""
SELECT lang, md5('i:' || string_agg(s, ',' ORDER BY s) || '|t:' || lang) AS version, left(md5(string_agg(s, ',' ORDER BY s)), 16) AS request
FROM (SELECT DISTINCT lang, source AS s FROM documents) GROUP BY lang
""")
def list_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "documents").groupBy("lang").agg(F.collect_set("source").alias("s"))
    version = F.md5(text.signature(i=F.col("s"), t=F.array("lang")))
    return lists.select("lang", version.alias("version"), F.left(F.md5(F.array_join(F.array_sort("s"), ",")), F.lit(16)).alias("request"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%H:%M:%S') AS clock FROM events
""")
def time_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.date_format("ts", "HH:mm:ss").alias("clock"))


@query("""
SELECT doc_id, n, CASE WHEN doc_id % 2 = 0 THEN 'json' ELSE 'text' END AS kind,
    CASE WHEN doc_id % 2 = 0 THEN '{"doc_id":' || doc_id || ',"n":' || n || '}' ELSE '[' || lang || '] ' || n END AS line
FROM (SELECT doc_id, lang, length(text) AS n FROM documents)
""")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").cast("long").alias("n"))
    even = F.col("doc_id") % 2 == 0
    line = F.when(even, F.to_json(F.struct("doc_id", "n"))).otherwise(F.concat(F.lit("["), F.col("lang"), F.lit("] "), F.col("n").cast("string")))
    return rows.select("doc_id", "n", F.when(even, "json").otherwise("text").alias("kind"), line.alias("line"))


@query(r"""
SELECT doc_id, count(*) AS lines, sum(length(l)) AS chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS l FROM documents) WHERE length(l) > 0 GROUP BY doc_id
""")
def line_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gravelsift.sources.readers import text_lines

    lines = text_lines(table(spark, sf_dir, "documents"), "text", "doc_id")
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))
