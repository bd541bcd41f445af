"""License scans by ordered signature rules, in built-in functions only.

Words are runs of characters other than ASCII control characters, spaces and punctuation, with A-Z in lower case. Base
places are those where a base phrase's words stand consecutively. The rules are some hundreds of regular expressions over
the words joined by spaces: written notices, exceptions, identifiers and short names (license_rules.py), and the names of
license families (FAMILIES) in the ways in which a license is invoked (FORMS). Each has a keyword, a label, a priority
and a score. A text is cut into words once; it is searched only if one of them is a keyword and one holds one of the gate's
strings, and then only for the rules of its own keywords, by an equality join with the rule table, which is of fixed size. A detection that lies within another one of at least its priority is suppressed
(of equal ones the first rule's stays), found in one pass over a document's detections sorted by their starts.

Null or empty text: no words, no labels, score 0. Empty table: no rows. Null ids are found like others. Repeated rows or
ids: a row each, with the labels of its text. Long texts:
whole. Further columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gravelsift.llm import license_rules
from gravelsift.llm.common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Every rule and base phrase holds one of these strings within a word, so that it doesn't matter what stands between words,
#: or one of the short identifiers as a word before a version.
GATE = (
    "licen", "gpl", "cc", "creative", "domain", "copyright", "reserved", "spdx", "hereby", "redistribut", "warrant", "noninfring", "misrepresented", "wtfpl", "beer", "bsd",
    "perl", "ruby", "openssl", "confidential", "prohibited", "permission", "vorbehalten", "reservados", "droits", "exception", "syscall", "advertis", "endorse",
    "consequential", "unencumbered", "mulan", "0bsd", "cecill", "sspl", "odbl", "pddl", "ncsa", "hpnd", "zlib", "postgresql", "artistic", "blueoak", "invariant", "waived",
)
SHORT_GATE = r"(?i)(?<![a-z0-9])(?:mpl(?![a-z0-9])|(?:afl|mpl|epl|eupl|cddl|cpl|ecl|gfdl|bsl|busl|osl|ofl|ms|php|psf|python|apache|upl|zpl|mit)[\x00-/:-@\x5b-\x60{-\x7f]+(?:[0-9]|pl|rl))"

#: Label, keyword, names as regular expressions over words, versions (with a space for each dot).
FAMILIES = (
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", ("1", "3")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("3",)),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[cs]e", ("2 1", "3")),
    ("lgpl", "library", "(?:gnu )?library general public licen[cs]e", ("2",)),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3")),
    ("gpl", "gnu", "gnu general public licen[cs]e", ("1", "2", "3")),
    ("gpl", "gpl", "(?:gnu )?gpl", ("1", "2", "3")),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", ("1 1", "1 2", "1 3")),
    ("apache", "apache", "apache (?:software )?licen[cs]e", ("1 0", "1 1", "2 0")),
    ("mit", "mit", "(?:the )?mit licen[cs]e", ()),
    ("x11", "x11", "x11 licen[cs]e", ()),
    ("mpl", "mozilla", "mozilla public licen[cs]e", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public licen[cs]e", ("1 0", "2 0")),
    ("cpl", "common", "common public licen[cs]e", ("1 0",)),
    ("cddl", "distribution", "common development and distribution licen[cs]e", ("1 0", "1 1")),
    ("bsd", "bsd", "(?:new |modified |revised |simplified )?bsd (?:style )?licen[cs]e", ()),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd) licen[cs]e", ()),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd) licen[cs]e", ()),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd) licen[cs]e", ()),
    ("isc", "isc", "isc licen[cs]e", ()),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", ()),
    ("boost", "boost", "boost software licen[cs]e", ("1 0",)),
    ("artistic", "artistic", "artistic licen[cs]e", ("1 0", "2 0")),
    ("python", "python", "python (?:software foundation )?licen[cs]e", ("2", "2 0")),
    ("php", "php", "php licen[cs]e", ("3 0", "3 01")),
    ("postgresql", "postgresql", "postgresql licen[cs]e", ()),
    ("openssl", "openssl", "openssl licen[cs]e", ()),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", ("1 0", "1 1")),
    ("upl", "universal", "universal permissive licen[cs]e", ("1 0",)),
    ("eupl", "european", "european union public licen[cs]e", ("1 0", "1 1", "1 2")),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", ()),
    ("ms-rl", "reciprocal", "microsoft reciprocal licen[cs]e", ()),
    ("osl", "open", "open software licen[cs]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free licen[cs]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa (?:open source )?licen[cs]e", ()),
    ("zpl", "zope", "zope public licen[cs]e", ("1 1", "2 0", "2 1")),
    ("odbl", "database", "open (?:data commons open )?database licen[cs]e", ("1 0",)),
    ("unlicense", "unlicense", "unlicense", ()),
    ("cc0", "cc0", "cc0", ("1 0",)),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "creative", "creative commons attribution(?: licen[cs]e)?", ("2 0", "3 0", "4 0")),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: licen[cs]e)?", ("2 0", "3 0", "4 0")),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: licen[cs]e)?", ("2 0", "3 0", "4 0")),
    ("public-domain", "domain", "(?:in|into|to) the public domain", ()),
    ("copyright", "copyright", "copyright(?: c)? (?:19|20)[0-9]{2}", ()),
    ("all-rights-reserved", "reserved", "all rights reserved", ()),
)
#: Priority, score, and the form, in which NAME and VERSION stand for a family's.
FORMS = (
    (4, 0.95, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?NAME v?(?:ersion )?VERSION(?: or (?:any )?later(?: version)?)?"),
    (3, 0.9, "(?:the )?NAME v?(?:ersion )?VERSION or (?:at your option )?(?:any )?later(?: version)?"),
    (2, 0.8, "(?:the )?NAME v?(?:ersion )?VERSION"),
    (3, 0.85, "(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?NAME"),
    (2, 0.75, "(?:subject to|governed by|see) (?:the )?(?:terms of (?:the )?)?NAME"),
    (1, 0.6, "NAME"),
)


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, keyword, pattern over words between spaces, label, priority, score) of every rule, in order."""
    out: list[tuple[int, str, str, str, int, float]] = []

    def add(keyword: str, pattern: str, label: str, priority: int, score: float) -> None:
        out.append((len(out), keyword, f"(?<= ){pattern}(?= )", label, priority, score))

    for block, priority, score in ((license_rules.NOTICES, 6, 0.98), (license_rules.EXCEPTIONS, 2, 0.7)):
        for line in block.strip().splitlines():
            label, keyword, pattern = line.split(" | ")
            add(keyword, pattern, label, priority, score)
    for line in license_rules.IDENTIFIERS.strip().splitlines():
        label, name = line.split(" ")
        words = re.findall(WORD, name.lower())
        add("spdx", f"spdx license identifier {' '.join(words)}", label, 7, 1.0)
        add("spdx", f"(?:or|and|with) {' '.join(words)}", label, 7, 1.0)  # further parts of an expression
        if len(words) > 1:  # a bare word is no identifier
            add(words[0], " ".join(words), label, 3, 0.85)
            add(words[0], f"(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{' '.join(words)}", label, 4, 0.95)
        else:
            add(words[0], f"licen[cs]ed under (?:the )?(?:terms of (?:the )?)?{words[0]}", label, 4, 0.95)
        add(words[0], f"licen[cs]es? {' '.join(words)}", label, 3, 0.85)
    for line in license_rules.SHORT_NAMES.strip().splitlines():
        label, word = line.split(" ")
        add(word, word, label, 2, 0.8)
    for label, keyword, name, versions in FAMILIES:
        for priority, score, form in FORMS:
            for version in versions if "VERSION" in form else ("",):
                pattern = form.replace("NAME", name).replace("VERSION", version.replace(" 0", "(?: 0)?") if version.endswith(" 0") else version)
                named = f"{label}-{version.replace(' ', '.')}" if version else label
                add(keyword, pattern, named, priority, score)
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _base(joined: Column) -> dict[str, Column]:
    """Counts, first and last places and labels of the base phrases in ' word word ... '."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        mark = f" {phrase} "
        count = F.regexp_count(joined, F.lit(f"(?<= ){phrase}(?= )"))
        before = F.locate(mark, joined)
        after = F.length(joined) - F.length(F.substring_index(joined, mark, -1)) - len(mark)
        counts.append(F.coalesce(count, F.lit(0)))
        firsts.append(F.when(count > 0, _spaces(F.left(joined, before)) - 1))
        lasts.append(F.when(count > 0, _spaces(F.left(joined, after + 1)) - 1))
        labels.append(F.when(count > 0, F.lit(label)))
    return {
        "n_base": sum(counts[1:], counts[0]).cast("long"), "first_word": F.least(*firsts).cast("long"), "last_word": F.greatest(*lasts).cast("long"),
        "base": F.array_sort(F.array_compact(F.array(*labels))),
    }


def detections(spark: SparkSession, joined: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end (words, from 0, inclusive), label, priority, score of what isn't suppressed in (keys, joined)."""
    listed = F.broadcast(spark.createDataFrame(rules(), "rule int, keyword string, pattern string, label string, priority int, score double"))
    words = sorted({r[1] for r in rules()})
    found = F.array_intersect(F.split("joined", " "), F.array(*map(F.lit, words)))
    gated = joined.select(*keys, "joined", F.explode(found).alias("keyword")).join(listed, "keyword")
    marked = gated.where(F.rlike("joined", F.col("pattern"))).select(
        *keys, "rule", "label", "priority", "score", F.posexplode(F.split(F.regexp_replace("joined", F.col("pattern"), F.lit("\x01$0\x02")), "\x01")).alias("k", "piece")
    )
    # repeated rows have the same pieces, of which one set is placed
    sized = marked.select(
        *keys, "rule", "label", "priority", "score", "k", _spaces(F.col("piece")).alias("size"), _spaces(F.substring_index("piece", "\x02", 1)).alias("inner")
    ).distinct()
    so_far = Window.partitionBy(*keys, "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.sum("size").over(so_far) - 1).where("k > 0").withColumn("end", F.col("start") + F.col("inner"))
    earlier = Window.partitionBy(*keys).orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sorted({r[4] for r in rules()})
    reach = {f"_r{p}": F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier) for p in ranks}
    held = reduce(or_, ((F.col("priority") == p) & (F.coalesce(F.col(f"_r{p}"), F.lit(-1)) >= F.col("end")) for p in ranks))
    return placed.withColumns(reach).where(~held).select(*keys, "start", "end", "label", "priority", "score")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), words.alias("words"))
    keywords = F.array(*map(F.lit, sorted({r[1] for r in rules()} | {p.split()[0] for p in BASE})))
    cut = cut.select("doc_id", "hash", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", keywords), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("joined"))
    gate = reduce(or_, (F.contains("joined", F.lit(g)) for g in GATE)) | F.col("joined").rlike(SHORT_GATE)
    cut = cut.select("doc_id", "hash", "n_words", F.when(gate, F.col("joined")).alias("joined"))
    out = cut.select("doc_id", "hash", "n_words", "joined", *(c.alias(n) for n, c in _base(F.col("joined")).items()))
    out, _ = materialize(out, "license-texts")  # each text is read once; only those with a keyword are kept, as words
    searched = out.where("joined is not null").select("doc_id", "hash", "joined")
    kept = detections(docs.sparkSession, searched, ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    kept = kept.withColumnsRenamed({"doc_id": "_id", "hash": "_hash"})
    out = out.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
