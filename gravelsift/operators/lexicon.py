"""Lexicons: union of roots, variants and keywords, and the variants of Hangul words by exchanged jamo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.functions.text import CHO, JONG, JUNG, code_point
from gravelsift.sources import default_rules


def flat_words(entries: DataFrame) -> DataFrame:
    """The distinct words of a lexicon's rows."""
    return entries.select("word").distinct()


def with_keywords(lexicon: DataFrame, modes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon with the FILTER keywords, the TRIGGER keywords) of (word, mode); IGNORE and empty words do nothing."""
    real = modes.where("word <> ''")
    more = real.where("mode = 'FILTER'").select("word", F.lit("SYSTEM_KEYWORD").alias("wtype"))
    return lexicon.unionByName(more).distinct(), real.where("mode = 'TRIGGER'").select("word").distinct()


def variants(rules: DataFrame) -> DataFrame:
    """root, word: every syllable choice of a root's rules, without the root.

    rules: root, place (from 0), cho, jung, jong (arrays of the jamo allowed there; '' is no final one). Places are
    joined one after the other by root, so the product of a root's choices is spread over tasks.
    """
    index = lambda table, x: F.array_position(F.array(*map(F.lit, table)), x) - 1
    syllables = rules.select("root", "place", F.explode("cho").alias("c"), "jung", "jong").select("root", "place", "c", F.explode("jung").alias("v"), "jong").select("root", "place", "c", "v", F.explode("jong").alias("f"))
    code = F.lit(0xAC00) + index(list(CHO), F.col("c")) * 588 + index(list(JUNG), F.col("v")) * 28 + index(JONG, F.col("f"))
    syllables = syllables.select("root", "place", code_point(code).alias("s")).distinct()
    longest = rules.agg(F.max("place")).first()[0]
    words = syllables.where("place = 0").select("root", F.col("s").alias("word"), F.lit(1).alias("n"))
    for place in range(1, (longest or 0) + 1):  # as many as a word has syllables
        after = syllables.where(F.col("place") == place).select(F.col("root").alias("r"), "s")
        grown = words.join(after, F.col("root") == F.col("r"), "left")
        words = grown.select("root", F.concat("word", F.coalesce("s", F.lit(""))).alias("word"), (F.col("n") + F.col("s").isNotNull().cast("int")).alias("n"))
    return words.where("word <> root").select("root", "word").distinct()


RULE = "root string, form int, word string, place int, cho array<string>, jung array<string>, jong array<string>"
EXTRA = "root string, at int, word string"


def _own(syllable: str) -> tuple[list[str], list[str], list[str]]:
    code = ord(syllable) - 0xAC00
    return [CHO[code // 588]], [JUNG[code % 588 // 28]], [JONG[code % 28]]


def parse_rules(spark: SparkSession, roots: str = default_rules.ROOTS, sets: str = default_rules.SETS) -> tuple[DataFrame, DataFrame]:
    """(RULE, EXTRA) of rules as sources.default_rules writes them: a row for each syllable of each form of a root."""
    named = {}
    for name, *parts in (line.split() for line in sets.split("\n") if line):
        named[name] = [list(p.replace("-", "")) or [""] for p in parts]
    rules, extras = [], []
    for line in filter(None, roots.split("\n")):
        forms, _, more = line.partition("||")
        root = forms.split(":")[0].strip()
        extras += [(root, k, w) for k, w in enumerate(more.split())]
        for number, form in enumerate(forms.split("|")):
            word, _, chosen = form.partition(":")
            for place, (syllable, name) in enumerate(zip(word.strip(), chosen.split(), strict=True)):
                given = [] if name == "=" else named[name]
                rules.append((root, number, word.strip(), place, *(given[k] if k < len(given) else own for k, own in enumerate(_own(syllable)))))
    return spark.createDataFrame(rules, RULE), spark.createDataFrame(extras, EXTRA)


def ordered_variants(rules: DataFrame, extras: DataFrame) -> DataFrame:
    """root, place, word: a root's variants in the order of its forms, syllables and sets, each at its first place; without the root.

    Places are joined one after the other by root and form, so the product of a root's choices is spread over tasks; the
    choices made so far, an array of numbers, are the order. Extras come last.
    """
    index = lambda table, x: F.array_position(F.array(*map(F.lit, table)), x) - 1
    each = lambda c: F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    rows = rules.select("root", "form", "place", F.explode(each("cho")).alias("c"), "jung", "jong").select("root", "form", "place", "c", F.explode(each("jung")).alias("v"), "jong").select("root", "form", "place", "c", "v", F.explode(each("jong")).alias("f"))
    code = F.lit(0xAC00) + index(list(CHO), F.col("c.x")) * 588 + index(list(JUNG), F.col("v.x")) * 28 + index(JONG, F.col("f.x"))
    rows = rows.select("root", "form", "place", code_point(code).alias("s"), F.array("c.i", "v.i", "f.i").alias("i"))
    longest = rules.agg(F.max("place")).first()[0]
    words = rows.where("place = 0").select("root", "form", F.col("s").alias("word"), F.concat(F.array("form"), F.col("i")).alias("at"))
    for place in range(1, (longest or 0) + 1):  # as many as a word has syllables
        after = rows.where(F.col("place") == place).select("root", "form", "s", "i")
        words = words.join(after, ["root", "form"], "left").select("root", "form", F.concat("word", F.coalesce("s", F.lit(""))).alias("word"), F.concat("at", F.coalesce("i", F.array().cast("array<int>"))).alias("at"))
    last = extras.select("root", "word", F.array(F.lit(2**31 - 1), F.col("at")).alias("at"))
    every = words.select("root", "word", "at").unionByName(last).where("word <> root").groupBy("root", "word").agg(F.min("at").alias("at"))
    listed = every.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("v"))  # a root's own variants: some hundreds
    return listed.select("root", F.posexplode("v.word").alias("place", "word"))


def default_lexicon(spark: SparkSession, rules: tuple[DataFrame, DataFrame] | None = None, category: str = default_rules.CATEGORY, pos: str = default_rules.POS) -> DataFrame:
    """category, root, pos, variants of the default dictionary, roots in the order of their names."""
    syllables, extras = rules or parse_rules(spark)
    listed = ordered_variants(syllables, extras).groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("v"))
    roots = syllables.select("root").distinct().join(listed, "root", "left")
    return roots.select(F.lit(category).alias("category"), "root", F.lit(pos).alias("pos"), F.coalesce(F.col("v.word"), F.array().cast("array<string>")).alias("variants"))


def lexicon_json(entries: DataFrame) -> DataFrame:
    """value: one row, the JSON object that sources.readers.read_lexicon reads; a lexicon is some thousand words."""
    entry: Column = F.struct("pos", "variants")
    category = entries.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("root"), entry.alias("x"))))).alias("roots"))
    name = F.regexp_extract(F.to_json(F.array("category")), r"^\[(.*)\]$", 1)  # quoted
    member = category.select("category", F.concat(name, F.lit(":"), F.to_json("roots")).alias("member"))
    members = member.agg(F.array_sort(F.collect_list(F.struct("category", "member"))).alias("m"))
    return members.select(F.concat(F.lit("{"), F.array_join("m.member", ","), F.lit("}")).alias("value"))


def write_lexicon(entries: DataFrame, path: str) -> None:
    """A lexicon as a folder of one JSON file."""
    lexicon_json(entries).coalesce(1).write.mode("overwrite").text(path)
