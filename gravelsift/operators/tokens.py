"""Tokens with offsets, meaningful units and word pieces: array functions and windows over one document's tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.functions import batches
from gravelsift.functions.text import is_laughter

#: Tag prefixes that carry meaning, those that join into compounds, and a compound's most tokens.
MEANINGFUL = ("NN", "VV", "VA", "XR", "SL", "MAG", "UN")
JOINING = ("NN", "XR", "UN")
LONGEST = 6


def forms(docs: DataFrame, pattern: str = r"\p{L}+") -> DataFrame:
    """doc_id, pos, form of every run of a text that matches the pattern, without offsets: built-in expressions only."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"))).alias("pos", "form"))


def tokenize(docs: DataFrame, pattern: str = r"\p{L}+", tag: str = "NNG") -> DataFrame:
    """doc_id, pos, form, tag, start, len: the runs of a text that match the pattern; a stand-in for a morphology adapter.

    Offsets are local to a text, so one Arrow pass finds them without a shuffle.
    """

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in arrived:
            for k, rows in batches.slices(batch.column(1)):
                part = batch.slice(k, rows)
                found = [list(find(text)) for text in part.column(1).to_pylist()]
                n = np.array([len(f) for f in found])
                flat = [m for f in found for m in f]
                at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
                doc_id = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                starts = pa.array([m.start() for m in flat], pa.int32())
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(at, pa.int32()), pa.array([m.group() for m in flat], pa.string()), starts], ["doc_id", "pos", "form", "start"])

    batches.bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, pos int, form string, start int")
    return found.select("doc_id", "pos", "form", F.lit(tag).alias("tag"), "start", F.length("form").alias("len"))


def joined_units(found: list[tuple[str, str, int]]) -> Iterator[tuple[str, int, bool]]:
    """(form, start, is_compound) of one text's tokens (form, tag, start), as meaningful_units has them."""
    held = ""
    first = end = count = 0
    joins = False
    kinds: dict[str, tuple[bool, bool]] = {}
    for form, tag, start in found:
        if (kind := kinds.get(tag)) is None:
            kind = kinds[tag] = tag.startswith(MEANINGFUL), tag.startswith(JOINING)
        meant, noun = kind
        if not meant:
            continue
        if count and start == end and noun and joins and count < LONGEST and tag != "NNP":
            held += form
            count += 1
        else:
            if count:
                yield held, first, count > 1
            held, first, count = form, start, 1
        end, joins = start + len(form), noun
    if count:
        yield held, first, count > 1


def units_of_texts(docs: DataFrame, tokenizer: Callable[[str], list[tuple[str, str, int]]]) -> DataFrame:
    """doc_id, form, s, e, is_compound of texts whose tokens a function gives: joined in one Arrow pass, without a shuffle."""

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for k, n in batches.slices(batch.column(1)):
                part = batch.slice(k, n)
                made = [list(joined_units(tokenizer(text))) for text in part.column(1).to_pylist()]
                doc_id = part.column(0).take(pa.array(np.repeat(np.arange(len(made)), [len(x) for x in made])))
                form, start, compound = zip(*chain.from_iterable(made), strict=True) if any(made) else ((), (), ())
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(form, pa.string()), pa.array(start, pa.int32()), pa.array(compound, pa.bool_())], ["doc_id", "form", "s", "is_compound"])

    batches.bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").where("text is not null").mapInArrow(run, f"doc_id {kind}, form string, s int, is_compound boolean")
    return found.select("doc_id", "form", "s", (F.col("s") + F.length("form") - 1).alias("e"), "is_compound")


def meaningful_units(tokens: DataFrame) -> DataFrame:
    """doc_id, form, s, e (inclusive), is_compound: meaningful tokens, adjoining nouns joined by at most LONGEST.

    A proper noun (NNP) may begin a compound but doesn't extend one. One window order serves all steps, and units are
    grouped where their document's tokens lie already.
    """
    has = lambda prefixes: F.substring("tag", 1, 1).isNotNull() & F.col("tag").rlike("^(?:" + "|".join(prefixes) + ")")
    kept = tokens.where(has(MEANINGFUL)).withColumn("joins", has(JOINING)).withColumn("end", F.col("start") + F.col("len"))
    w = Window.partitionBy("doc_id").orderBy("start", "pos")
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = ~(F.col("joins") & F.lag("joins").over(w) & (F.lag("end").over(w) == F.col("start")) & (F.col("tag") != "NNP"))
    runs = kept.withColumn("fresh", F.coalesce(fresh, F.lit(True))).withColumn("at", F.row_number().over(w))
    runs = runs.withColumn("run", F.max(F.when(F.col("fresh"), F.col("at"))).over(rows))  # the place where the run begins
    cut = runs.withColumn("part", F.floor((F.col("at") - F.col("run")) / LONGEST))
    parts = F.array_sort(F.collect_list(F.struct("at", "form")))
    made = cut.groupBy("doc_id", "run", "part").agg(parts.alias("parts"), F.min("start").alias("s"), (F.max("end") - 1).alias("e"))
    return made.select("doc_id", F.array_join(F.col("parts.form"), "").alias("form"), "s", "e", (F.size("parts") > 1).alias("is_compound"))


def evidence_spans(evidence: DataFrame, thresholds: dict[str, float], docs: DataFrame | None = None) -> DataFrame:
    """doc_id, module, s, e (exclusive), evidence of merged word pieces whose merged evidence reaches the module's threshold.

    evidence: doc_id, module, token, s, e, evidence. Pieces merge if one starts with ## or before the end reached so far.
    Modules without a threshold have no spans. docs (doc_id, text): spans of laughter only are left out.
    """
    w = Window.partitionBy("doc_id", "module").orderBy("s", "e", "token")
    real = evidence.where("e > s")
    reached = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = ~(F.col("token").startswith("##") | (F.col("s") <= reached))
    grouped = real.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(w))
    least = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    merged = grouped.groupBy("doc_id", "module", "run").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.greatest(F.max("evidence"), F.sum("evidence") / F.pow(F.count("*"), F.lit(0.25))).alias("evidence")
    )
    found = merged.where(F.col("evidence") >= least[F.col("module")]).drop("run")
    if docs is None:
        return found
    inside = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    return found.join(docs.select("doc_id", "text"), "doc_id").where(~is_laughter(inside)).drop("text")


PIECES = "array<struct<module:string,token:string,s:int,e:int,evidence:double>>"


def evidence_marks(pieces: Column, thresholds: dict[str, float]) -> Column:
    """array<struct<s, e>> (e inclusive, sorted, each once) of what evidence_spans gives for one row's own pieces (PIECES).

    Rows are side by side in Arrow batches: nothing is shuffled, whatever the number of pieces. No pieces, no spans; null: null.
    """
    batches.bounded()
    names = pa.array(list(thresholds), pa.string())
    least = np.array([*thresholds.values(), np.inf])

    @F.arrow_udf("array<struct<s:int,e:int>>")
    def run(lists: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        module, token, s, e, evidence = (flat.field(k) for k in range(5))
        table = pa.table({"row": np.repeat(np.arange(len(lists)), counts), "m": pc.fill_null(pc.index_in(module, names), len(names)), "s": s, "e": e, "token": token, "x": evidence})
        table = table.filter(pc.and_(pc.less(table["m"], len(names)), pc.greater(e, s)))
        table = table.sort_by([(c, "ascending") for c in ("row", "m", "s", "e", "token")])
        row, m, s, e, x = (table[c].to_numpy() for c in ("row", "m", "s", "e", "x"))
        spans = []
        if len(row):
            group = row.astype(np.int64) * len(names) + m
            reach = np.maximum.accumulate((group << 32) + e)  # the end reached so far in a group
            fresh = np.ones(len(row), bool)
            begins = pc.starts_with(table["token"], "##").to_numpy()
            fresh[1:] = (group[1:] != group[:-1]) | ~(begins[1:] | ((group[1:] << 32) + s[1:] <= reach[:-1]))
            at = np.flatnonzero(fresh)
            run_ = np.cumsum(fresh) - 1
            n, sums = np.bincount(run_), np.bincount(run_, weights=x)
            keep = np.maximum(np.maximum.reduceat(x, at), sums / n**0.25) >= least[m[at]]
            spans = np.unique(np.stack([row[at], s[at], np.maximum.reduceat(e, at) - 1], axis=1)[keep], axis=0)
        spans = np.asarray(spans, np.int64).reshape(-1, 3)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(spans[:, 0], minlength=len(lists)))])
        both = pa.StructArray.from_arrays([pa.array(spans[:, k], pa.int32()) for k in (1, 2)], ["s", "e"])
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), both, mask=lists.is_null())

    return run(pieces)


def placed_forms(text: Column, pattern: str = r"\p{L}+") -> Column:
    """array<struct<form, start>> of the runs of a text that match the pattern: tokenize within the row; null for null."""
    batches.bounded()
    kind = pa.struct([("form", pa.string()), ("start", pa.int32())])

    def made(texts: pa.Array) -> pa.Array:
        find = regex.compile(pattern).finditer
        found = [list(find(t)) for t in texts.fill_null("").to_pylist()]
        cuts = np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])
        flat = [m for f in found for m in f]
        both = pa.StructArray.from_arrays([pa.array([m.group() for m in flat], pa.string()), pa.array([m.start() for m in flat], pa.int32())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), both, mask=texts.is_null())

    @F.arrow_udf("array<struct<form:string,start:int>>")
    def run(texts: pa.Array) -> pa.Array:
        return batches.by_slices(made, texts)

    return run(text)


def merge_word_pieces(tokens: DataFrame) -> DataFrame:
    """doc_id, module, pos, token, score (raw_attr, attention): pieces that begin with ## joined to the token before, values added.

    A piece without a token before it stays as it is.
    """
    w = Window.partitionBy("doc_id", "module").orderBy("pos")
    fresh = ~F.col("token").startswith("##") | (F.row_number().over(w) == 1)
    runs = tokens.withColumn("fresh", fresh).withColumn("run", F.sum(F.col("fresh").cast("int")).over(w))
    piece = F.when(F.col("fresh"), F.col("token")).otherwise(F.substr("token", F.lit(3)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"])
    values = [F.sum(c).alias(c) for c in ("score", "raw_attr", "attention") if c in tokens.columns]
    return runs.groupBy("doc_id", "module", "run").agg(F.min("pos").alias("pos"), F.array_join(parts, "").alias("token"), *values).drop("run")
