"""Line dedup by a segment-partition edit join, in built-in functions only.

Lines (texts cut at newlines) are alike if they are equal, or if both have at least min_chars characters and differ by
at most max_edits insertions, deletions and substitutions. Alike lines form classes (transitively); of each class the
first line stays, by document id and line number, and the others are dropped from their documents. Blank lines stay.
So does a line of fewer than min_chars characters, unless its document's whole text is that of an earlier document, or
the line just before or after it is a dropped one of at least min_chars: short lines are found everywhere by chance.

1. Lines are cut once to (document, number, hash, hash, whether long); equal lines are collapsed with a partial
   aggregation, so a line that a third of all rows hold is a row of each task.
2. Segment-partition join: a line of length n is cut into max_edits + 1 even segments; two lines within max_edits edits
   share one of them, shifted by no more than the edits allow. Each distinct line is indexed under (n, segment number,
   segment) and probes the indexes of lengths n - max_edits to n at the few places that the multi-match-aware selection
   leaves: 12 signatures a line for two edits. Signatures of one line only are dropped before lines are paired, and of
   lines under one signature only those are paired whose counts of LETTERS differ by no more than the edits allow (an
   edit changes them by two at most), so that the many variants of one line aren't all paired with each other. A
   signature of more than BLOCK lines is dealt to pairs of blocks, so that no task pairs all its lines.
3. Candidates are verified by a banded bit-parallel automaton: one integer for each number of edits, one bit for each
   diagonal of the band, moved forward by one character at a time.
4. Links are united to components.

Null or empty text: one blank line, nothing dropped. Empty table: no rows. Rows of one id are one document: what is
dropped from it is dropped from each of them. Rows with a null id are no documents: their lines repeat nothing, nothing
repeats them, and they are returned as they are. Long texts and long lines: whole. Columns of the input pass through, but
for those that begin with _gl_. Lines are named by a 64-bit hash where they are paired, and by 128 bits where they count
as equal and where classes are attached to them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.llm.common import broadcast_if_small, components, materialize, stable_bucket

MAX_EDITS, MIN_CHARS = 2, 24
#: Letters that are counted (common ones part most lines; any are right).
LETTERS = "entiaorshlducgm"
#: Characters that the automaton reads after the common beginning of two lines before it reads them whole.
AHEAD = 24
#: Lines of one signature that are paired in one block.
BLOCK = 2048


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, no, line, h, g of the lines that aren't blank."""
    cut = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("no", "line"))
    return cut.where(F.col("line").rlike(r"\S")).select("doc", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(5), "line").alias("g"))


def _copied_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """copy: the documents of which a whole text is that of an earlier document."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("copy"), F.xxhash64(text_col).alias("h"), F.xxhash64(F.lit(5), text_col).alias("g"))
    met = rows.groupBy("h", "g").agg(F.min("copy").alias("original"), F.max("copy").alias("last")).where("last > original")
    met, _ = materialize(met.select("h", "g", "original"), "lines-copied-texts")
    return rows.join(broadcast_if_small(met), ["h", "g"]).where("copy > original").select("copy").distinct()


def _signatures(lines: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """h, entry of lines (h, line): a signature in all bits but the last, which is 1 for a line's own index entry (which
    also probes) and 0 for a probe."""
    k = edits + 1
    kinds = [
        (short, i, shift) for short in range(edits + 1) for i in range(k)
        for shift in range(max(-i, short - (k - 1 - i)), min(i, short + (k - 1 - i)) + 1)
    ]
    # a row for each kind of signature before they are computed: one expression for all of them is small enough to be compiled
    each = F.inline(F.array(*(F.struct(F.lit(short).alias("short"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for short, i, shift in kinds)))
    rows = lines.select("h", "line", F.length("line").alias("n")).select("h", "line", "n", each)
    rows = rows.select("h", "line", "n", "short", "i", "shift", (F.col("n") - F.col("short")).alias("size")).where(F.col("size") >= min_chars)
    base, extra = F.floor(F.col("size") / k).cast("int"), (F.col("size") % k).cast("int")
    longer = F.col("i") + extra - k
    place = base * F.col("i") + F.greatest(longer, F.lit(0)) + F.col("shift")
    rows = rows.select("h", "line", "n", "short", "i", "shift", "size", place.alias("place"), (base + F.when(longer >= 0, 1).otherwise(0)).alias("part"))
    rows = rows.where((F.col("place") >= 0) & (F.col("place") + F.col("part") <= F.col("n")))
    sig = F.xxhash64("size", "i", F.substring(F.col("line"), F.col("place") + 1, F.col("part"))).bitwiseAND(F.lit(-2))
    own = (F.col("short") == 0) & (F.col("shift") == 0)
    return rows.select("h", F.when(own, sig.bitwiseOR(F.lit(1))).otherwise(sig).alias("entry"))


def _letter_counts(line: Column, name: str) -> list[Column]:
    """The counts of LETTERS, a column for each."""
    size = F.octet_length(line)
    return [(size - F.octet_length(F.replace(line, F.lit(x), F.lit("")))).cast("int").alias(f"{name}{k}") for k, x in enumerate(LETTERS)]


def common_prefix(a: Column, b: Column) -> Column:
    """The number of characters that a and b begin with alike, by halving steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))
    n = F.least(F.length(a), F.length(b))
    longer = lambda at, step: (at + step <= n) & (F.substring(a, at + 1, step) == F.substring(b, at + 1, step))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(longer(at, step), at + step).otherwise(at))


def within_edits(a: Column, b: Column, edits: int, begin: bool = False) -> Column:
    """Whether b can be made from a by at most so many edits: a banded bit-parallel automaton over b's characters.

    Register e holds, as bits, the diagonals (place in a less place in b, from -edits to edits) that e edits reach.
    begin: whether b can be the beginning of such a text, that is whether any diagonal is left.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1

    def once(value: Column, use) -> Column:
        """use(value), with the value computed once although the lambda names it often."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def closed(registers: list[Column]) -> list[Column]:  # fewer edits are allowed too; skip characters of a
        for e in range(1, edits + 1):
            fewer = registers[e - 1]
            registers[e] = registers[e].bitwiseOR(fewer).bitwiseOR(F.shiftleft(fewer, 1)).bitwiseAND(F.lit(full))
        return registers

    def packed(registers: list[Column]) -> Column:
        return F.struct(*(r.alias(f"r{e}") for e, r in enumerate(registers)))

    def run(cut: Column) -> Column:
        left, right = cut["left"], cut["right"]

        def step(state: Column, j: Column) -> Column:
            def match(c: Column) -> Column:
                bits = [F.when(F.get(left, j + (d - edits)) == c, F.lit(1 << d)).otherwise(F.lit(0)) for d in range(width)]
                return sum(bits[1:], bits[0])

            def move(m: Column) -> Column:
                old = [state[f"r{e}"] for e in range(edits + 1)]
                new = [old[0].bitwiseAND(m)]
                for e in range(1, edits + 1):  # match, substitute, or take a character of b alone
                    new.append(old[e].bitwiseAND(m).bitwiseOR(old[e - 1]).bitwiseOR(F.shiftright(old[e - 1], 1)))
                return packed(closed(new))

            return once(once(F.element_at(right, j + 1), match), move)

        start = packed(closed([F.lit(1 << edits)] + [F.lit(0)] * edits))
        places = F.when(F.size(right) > 0, F.sequence(F.lit(0), F.size(right) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda s: s[f"r{edits}"])

    def chars(text: Column) -> Column:
        return F.filter(F.split(text, ""), lambda c: c != "")

    end = once(F.struct(chars(a).alias("left"), chars(b).alias("right")), run)
    if begin:
        return end != 0
    diagonal = F.length(a) - F.length(b) + edits
    near = (diagonal >= 0) & (diagonal < width)
    return near & (F.getbit(end, F.when(near, diagonal).otherwise(0)) == 1)


def similar_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, ga, b, gb): hashes of the pairs of different lines within max_edits edits."""
    long = _lines(docs, id_col, text_col).where(F.length("line") >= min_chars).select("h", "g", "line")
    made = _signatures(long.distinct(), max_edits, min_chars)
    alike = F.shiftright("entry", 1)
    met = made.withColumn("cnt", F.count("*").over(Window.partitionBy(alike))).where("cnt > 1")
    met, _ = materialize(met.select("h", alike.alias("sig"), F.col("entry").bitwiseAND(F.lit(1)).cast("int").alias("role"), "cnt"), "lines-signatures")
    wanted, _ = materialize(met.select("h").distinct(), "lines-wanted")
    texts, _ = materialize(long.join(broadcast_if_small(wanted), "h").distinct(), "lines-texts")
    dealt = met.withColumn("blocks", F.ceil(F.col("cnt") / BLOCK).cast("int")).withColumn("own", stable_bucket("h", F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("role = 1").join(texts.select("h", *_letter_counts(F.col("line"), "p")), "h").withColumn("to", other)
    left = left.select("sig", F.col("own").alias("i"), F.col("to").alias("j"), F.col("h").alias("x"), *(f"p{k}" for k in range(len(LETTERS))))
    right = dealt.join(texts.select("h", *_letter_counts(F.col("line"), "q")), "h").withColumn("to", other)
    right = right.select("sig", F.col("to").alias("i"), F.col("own").alias("j"), F.col("h").alias("y"), "role", *(f"q{k}" for k in range(len(LETTERS))))
    apart = reduce(add, (F.abs(F.col(f"p{k}") - F.col(f"q{k}")) for k in range(len(LETTERS))))
    # lines of one length index and probe alike, so their pairs are taken from one side only
    once = (F.col("x") != F.col("y")) & ((F.col("role") == 0) | (F.col("x") < F.col("y"))) & (apart <= 2 * max_edits)
    pairs = left.join(right, ["sig", "i", "j"]).where(once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs, _ = materialize(pairs, "lines-candidates")
    named = pairs.join(texts.select(F.col("h").alias("a"), F.col("g").alias("ga"), F.col("line").alias("left")), "a")
    named = named.join(texts.select(F.col("h").alias("b"), F.col("g").alias("gb"), F.col("line").alias("right")), "b")
    # most candidates part soon after their common beginning: the automaton reads a few characters there first
    at = F.col("same")
    named = named.withColumn("same", common_prefix(F.col("left"), F.col("right")))
    begun = within_edits(F.substring("left", at + 1, F.lit(AHEAD + max_edits)), F.substring("right", at + 1, F.lit(AHEAD)), max_edits, begin=True)
    alive, _ = materialize(named.where(begun).select("a", "ga", "b", "gb", "left", "right"), "lines-alive")
    return alive.where(within_edits(F.col("left"), F.col("right"), max_edits)).select("a", "ga", "b", "gb").distinct()


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lines: the numbers (from 0) of the lines of a document that repeat an earlier one."""
    links, _ = materialize(similar_lines(docs, max_edits, min_chars, id_col, text_col), "lines-links")
    roots, _ = components(links.select("a", "b"), "lines-cc")
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked_lines = links.select(F.col("a").alias("h"), F.col("ga").alias("g")).union(links.select("b", "gb")).distinct()
    classes, _ = materialize(linked_lines.join(roots, F.col("h") == F.col("node")).select("h", "g", "root"), "lines-classes")
    spots, _ = materialize(_lines(docs, id_col, text_col).select("doc", "no", "h", "g", (F.length("line") >= min_chars).alias("long")), "lines-spots")
    seen = spots.groupBy("h", "g").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("n"))
    classed, _ = materialize(seen.join(broadcast_if_small(classes), ["h", "g"], "left").where("root is not null or n > 1"), "lines-seen")
    alone = classed.where("root is null").select("h", "g", "first")
    linked = classed.where("root is not null")
    leaders = linked.groupBy("root").agg(F.min("first").alias("leader"))
    repeated = alone.unionByName(linked.drop("first").join(leaders, "root").select("h", "g", F.col("leader").alias("first")))
    repeated, _ = materialize(repeated, "lines-repeated")
    spots = spots.join(broadcast_if_small(repeated), ["h", "g"]).where("first.doc <> doc or first.no <> no")
    copies, _ = materialize(_copied_texts(docs, id_col, text_col), "lines-copies")
    beside = F.max("long").over(Window.partitionBy("doc").orderBy("no").rangeBetween(-1, 1))
    gone = spots.select("doc", "no", beside.alias("beside")).join(broadcast_if_small(copies), F.col("doc") == F.col("copy"), "left").where("beside or copy is not null")
    return gone.groupBy("doc").agg(F.array_sort(F.collect_set("no")).alias("lines")).select(F.col("doc").alias("doc_id"), "lines")  # at most a text's lines


def drop_repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of docs, its texts without repeated lines, with _gl_lines and _gl_dropped (numbers of lines)."""
    gone, _ = materialize(repeated_lines(docs, max_edits, min_chars, id_col, text_col), "lines-gone")
    gone = gone.select(F.col("doc_id").alias("_gl_id"), F.col("lines").alias("_gl_gone"))
    joined = docs.join(broadcast_if_small(gone), F.col(id_col).cast("long") == F.col("_gl_id"), "left")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    lines, gone = F.struct(F.split(whole, "\n").alias("all")), F.col("_gl_gone")

    def rest(cut: Column) -> Column:  # the lines are cut once, not for each that stays
        left = F.array_except(F.sequence(F.lit(0), F.size(cut["all"]) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.element_at(cut["all"], i + 1)), "\n")

    text = F.when(gone.isNull(), F.col(text_col)).otherwise(F.element_at(F.transform(F.array(lines), rest), 1))
    count = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    out = joined.withColumns({"_gl_lines": count, "_gl_dropped": F.coalesce(F.size("_gl_gone"), F.lit(0))})
    return out.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), "_gl_lines", "_gl_dropped")
