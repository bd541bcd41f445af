"""Dictionary matches: equality joins of forms, substring search, shadowing, longest matches.

A lexicon is (word, wtype) with one row for each word. Matches are (doc_id, s, e, word, wtype), e inclusive.

`matcher` and `with_hits` do all of it where the text is: found, shadowed, chosen and masked in one Arrow pass, a result for
each row, without a shuffle and without ids, so also in streams. `match_texts` gives the matches themselves as rows;
`drop_shadowed`, `on_nouns` and `longest` are windows over a document's matches in one order.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from importlib.util import find_spec
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gravelsift.functions import batches
from gravelsift.functions.text import LETTER, jamo_form, jamo_forms, span_mask, star_mask
from gravelsift.operators.tokens import joined_units

#: Which list counts if several hold a word.
PRECEDENCE = {"WHITELIST": 0, "USER_BLACKLIST": 1, "SYSTEM_KEYWORD": 2}
#: A lexicon of at most so many characters is sent whole to every task. Of a larger one only the beginnings of its words
#: (PREFIX characters, with the lengths of the words that begin so) are sent, and what may be a word is joined with it.
LEXICON_CHARS, PREFIX = 4_000_000, 2
#: If there are more beginnings than this, single characters are sent, of which there are at most as many as Unicode has.
BEGINNINGS = 1_000_000
CHANNELS = ("form", "substring", "evasion")
TOKEN = r"\p{L}+"
_FILLER = re.compile(f"(?<=[{LETTER}])[^{LETTER}\\s]{{1,2}}(?=[{LETTER}])")


def rank(column: str = "wtype"):
    return F.when(F.col(column) == "WHITELIST", 0).when(F.col(column) == "USER_BLACKLIST", 1).otherwise(2)


def resolve(lexicon: DataFrame) -> DataFrame:
    """One row for each word: the list that comes first."""
    return lexicon.where("word <> ''").groupBy("word").agg(F.min_by("wtype", rank()).alias("wtype"))


def match_forms(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens (doc_id, form, start, len) whose form is a word of the lexicon."""
    found = tokens.join(resolve(lexicon), tokens["form"] == F.col("word"))
    return found.select("doc_id", F.col("start").alias("s"), (F.col("start") + F.col("len") - 1).alias("e"), "word", "wtype")


class Search:
    """Finds words of a whole lexicon (word -> wtype), or what may be a word by the beginnings of words (-> lengths)."""

    def __init__(self, words: dict[str, str] | None, beginnings: dict[str, list[int]], prefix: int = PREFIX):
        self.words, self.beginnings, self.prefix, self.automaton = words, beginnings, prefix, None
        if words and find_spec("ahocorasick") is None:  # not installed: the beginnings of the words find the same, more slowly
            self.beginnings = {}
            for n, begin in sorted({(len(word), word[:prefix]) for word in words}):
                self.beginnings.setdefault(begin, []).append(n)
        elif words:
            import ahocorasick  # installed but broken: the error stops the task

            self.automaton = ahocorasick.Automaton()
            for word in words:
                self.automaton.add_word(word, (len(word), word))
            self.automaton.make_automaton()

    def may_be(self, form: str) -> bool:
        if self.words is not None:
            return form in self.words
        return len(form) in self.beginnings.get(form[: self.prefix], ())

    def find(self, text: str, at: int = 0) -> Iterator[tuple[int, int, str]]:
        """(s, e, word) of all occurrences, overlapping ones too; at: the place where the text begins."""
        if self.automaton is not None:
            for e, (n, word) in self.automaton.iter(text):
                yield at + e - n + 1, at + e, word
            return
        for s in range(len(text)):
            for k in range(1, self.prefix + 1):
                for n in self.beginnings.get(text[s : s + k], ()) if s + k <= len(text) else ():
                    word = text[s : s + n]
                    # a beginning shorter than the others is a whole word
                    if len(word) == n and (n == k or k == self.prefix) and (self.words is None or word in self.words):
                        yield at + s, at + s + n - 1, word


def compact(text: str) -> tuple[str, list[int]]:
    """A text without filler between letters, and the place of each of its characters in the text."""
    gone = [m.span() for m in _FILLER.finditer(text)]
    kept = [i for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True) for i in range(a, b)]
    return "".join([text[i] for i in kept]) if gone else text, kept


def hits_of(text: str, search: Search, tokens: list[tuple[str, str, int]] | None = None) -> list[tuple[int, int, str, str]]:
    """(s, e, word, wtype) of what counts in one text, by start, the longer one first.

    Every occurrence of a word, in the text and in its compact form at its places in the text; without those that a white
    one contains, and those that lie in another one. tokens (form, tag, start) of a morphology adapter: then words count
    where they touch a noun or unknown token, and units and tokens that are a word count everywhere.
    """
    found: dict[tuple[int, int, str], str] = {}
    white: list[tuple[int, int]] = []
    nouns = None if tokens is None else sorted((t, t + len(f) - 1) for f, g, t in tokens if g.startswith(("NN", "UN")))

    def add(s: int, e: int, word: str, anywhere: bool = False) -> None:
        kind = search.words[word]
        if kind == "WHITELIST":
            white.append((s, e))
        elif anywhere or nouns is None or touches(s, e):
            found[s, e, word] = kind

    if nouns is not None:
        begins, reach = [s for s, _ in nouns], list(accumulate((e for _, e in nouns), max))

        def touches(s: int, e: int) -> bool:
            k = bisect_right(begins, e)
            return k > 0 and reach[k - 1] >= s

        for form, start in ((f, t) for f, t, *_ in [*joined_units(tokens), *((f, t) for f, _, t in tokens)]):
            if form in search.words:
                add(start, start + len(form) - 1, form, True)
    for s, e, word in search.find(text):
        add(s, e, word)
    if gone := [m.span() for m in _FILLER.finditer(text)]:
        short = "".join([text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)], strict=True)])
        left, places = 0, []  # where a gap lies in the short text, and how much is left out up to it
        for a, b in gone:
            places.append(a - left)
            left += b - a
        sizes = list(accumulate(b - a for a, b in gone))
        for s, e, word in search.find(short):
            i, j = bisect_right(places, s), bisect_right(places, e)
            if j > i:  # else it has been found in the text itself
                add(s + (sizes[i - 1] if i else 0), e + sizes[j - 1], word)
    if white:
        white.sort()
        begins, reach = [s for s, _ in white], list(accumulate((e for _, e in white), max))
        found = {m: t for m, t in found.items() if not ((k := bisect_right(begins, m[0])) and reach[k - 1] >= m[1])}
    out, before, at, far = [], -1, -1, -1
    for (s, e, word), kind in sorted(found.items(), key=lambda x: (x[0][0], -x[0][1], x[1] != "USER_BLACKLIST", x[0][2])):
        if s != at:  # the first of a start is the longest one
            before, at, far = max(before, far), s, e
        if e == far and e > before:
            out.append((s, e, word, kind))
    return out


def masked_by_place(text: str, hits: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for s, e, *_ in hits:
        s = max(s, at)
        if e >= s:
            out += [text[at:s], "*" * (e - s + 1)]
            at = e + 1
    return "".join([*out, text[at:]])


def masked_by_word(text: str, hits: list[tuple[int, int, str, str]]) -> str:
    """Each word replaced everywhere, in the order of detection."""
    for word in dict.fromkeys(w for _, _, w, _ in hits):
        text = text.replace(word, "*" * len(word))
    return text


HITS = "struct<s:array<int>,e:array<int>,word:array<string>,wtype:array<string>,masked:string>"
MASKS = {"place": masked_by_place, "word": masked_by_word}


@lru_cache(maxsize=4)
def _search(name: str, shared) -> Search:
    """A worker keeps the automaton of a lexicon from task to task."""
    return Search(shared.value, {})


def fits(lexicon: DataFrame) -> bool:
    """Whether a lexicon is sent whole to every task."""
    return (lexicon.agg(F.sum(F.length("word"))).first()[0] or 0) <= LEXICON_CHARS


def matcher(lexicon: DataFrame, mask: str = "place") -> Callable[..., Column]:
    """A function of a text column, and of tokens (array of form, tag, start) or none: HITS as `hits_of` has them.

    The lexicon is read here, once; it must fit (`fits`). A null text has no hits and a null mask.
    """
    words = resolve(lexicon)
    if not fits(words):
        raise ValueError(f"the lexicon has over {LEXICON_CHARS} characters: match_texts joins it")
    shared = lexicon.sparkSession.sparkContext.broadcast({r.word: r.wtype for r in words.collect()})  # at most LEXICON_CHARS characters
    name, render = uuid.uuid4().hex, MASKS[mask]

    def one(search: Search, text: str | None, tokens: list[dict] | None) -> tuple[list, str | None]:
        if text is None:
            return [], None
        found = hits_of(text, search, None if tokens is None else [(t["form"], t["tag"], t["start"]) for t in tokens])
        return found, render(text, found) if found else text

    def made(texts: pa.Array, tokens: pa.Array | None = None) -> pa.Array:
        search = _search(name, shared)
        given = [None] * len(texts) if tokens is None else [t or [] for t in tokens.to_pylist()]
        rows = [one(search, text, t) for text, t in zip(texts.to_pylist(), given, strict=True)]
        cuts, parts = [0], []
        for found, _ in rows:
            cuts.append(cuts[-1] + len(found))
            parts += found
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array([p[k] for p in parts], t)) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
        return pa.StructArray.from_arrays([*lists, pa.array([m for _, m in rows], pa.string())], ["s", "e", "word", "wtype", "masked"])

    @F.arrow_udf(HITS)
    def plain(text: pa.Array) -> pa.Array:
        return batches.by_slices(made, text)

    @F.arrow_udf(HITS)
    def tagged(text: pa.Array, tokens: pa.Array) -> pa.Array:
        return batches.by_slices(made, text, tokens)

    batches.bounded(lexicon.sparkSession)
    return lambda text, tokens=None: plain(text) if tokens is None else tagged(text, tokens)


#: What the words of a list are replaced by in the legacy form.
PLACEHOLDERS = {"WHITELIST": "__W__", "USER_BLACKLIST": "__B__", "SYSTEM_KEYWORD": "__F__"}
LEGACY = "struct<status:string,words:array<struct<word:string,wtype:string>>,text:string>"


def legacy_matcher(lexicon: DataFrame, pattern: str = r"[가-힣a-z0-9]+") -> Callable[[Column], Column]:
    """A function of a text in legacy form (functions.text.legacy_normalize): LEGACY, token after token.

    A token that is a word is replaced everywhere in what is left of the text so far by its list's placeholder, whitelist
    before blacklist before system; what isn't white is detected. The lexicon must fit (`fits`). Null: null.
    """
    words = resolve(lexicon)
    if not fits(words):
        raise ValueError(f"the lexicon has over {LEXICON_CHARS} characters")
    shared = lexicon.sparkSession.sparkContext.broadcast({r.word: r.wtype for r in words.collect()})  # at most LEXICON_CHARS characters
    kind = pa.struct([("status", pa.string()), ("words", pa.list_(pa.struct([("word", pa.string()), ("wtype", pa.string())]))), ("text", pa.string())])

    def made(texts: pa.Array) -> pa.Array:
        known, find, out = shared.value, regex.compile(pattern).findall, []
        for text in texts.to_pylist():
            if text is None:
                out.append(None)
                continue
            found = []
            for token in find(text):
                if (wtype := known.get(token.lower())) is None:
                    continue
                text = text.replace(token, PLACEHOLDERS[wtype])
                if wtype != "WHITELIST":
                    found.append({"word": token, "wtype": wtype})
            out.append({"status": "FILTERED_BY_FIRST_PASS" if found else "PASSED", "words": found, "text": text})
        return pa.array(out, kind)

    @F.arrow_udf(LEGACY)
    def run(texts: pa.Array) -> pa.Array:
        return batches.by_slices(made, texts)

    batches.bounded(lexicon.sparkSession)
    return run


def with_hits(docs: DataFrame, lexicon: DataFrame, tokens: DataFrame | None = None, mask: str = "place") -> DataFrame:
    """docs (doc_id, text and others) with `hits` (HITS): a result for each row, whatever its id.

    tokens: a morphology adapter's (doc_id, form, tag, start, len): rows of one id share them, rows of a null id have none.
    A lexicon of any size: one that isn't sent whole is joined, by a key of id and text, so that rows of null and of
    repeated ids keep to themselves there too.
    """
    if tokens is not None:
        own = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "form", "tag"))).alias("_tokens"))
        docs = docs.join(own, "doc_id", "left")
    if fits(resolve(lexicon)):
        find = matcher(lexicon, mask)
        return docs.withColumn("hits", find(F.col("text")) if tokens is None else find(F.col("text"), F.col("_tokens"))).drop("_tokens")
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")), 256)
    keyed = docs.withColumn("_key", key)
    texts = keyed.select(F.col("_key").alias("doc_id"), "text")
    if tokens is None:
        found = match_texts(texts, lexicon, ("substring", "evasion"))
    else:
        given = keyed.select(F.col("_key").alias("doc_id"), F.explode("_tokens").alias("t")).distinct().select("doc_id", "t.*").withColumn("len", F.length("form"))

        def units(t: list[dict]) -> list[tuple[str, int]]:
            return [(form, start) for form, start, _ in joined_units([(x["form"], x["tag"], x["start"]) for x in t])]

        @F.arrow_udf("array<struct<form:string,start:int>>")
        def joined(column: pa.Array) -> pa.Array:
            return pa.array([[{"form": f, "start": s} for f, s in units(t or [])] for t in column.to_pylist()], pa.list_(pa.struct([("form", pa.string()), ("start", pa.int32())])))

        whole = keyed.select(F.col("_key").alias("doc_id"), F.explode(joined("_tokens")).alias("t")).select("doc_id", "t.*").withColumn("len", F.length("form"))
        inner = match_texts(texts, lexicon, ("substring", "evasion"))
        forms = match_forms(whole.unionByName(given.select("doc_id", "form", "start", "len")), lexicon)
        found = forms.unionByName(on_nouns(inner.where("wtype <> 'WHITELIST'"), given)).unionByName(inner.where("wtype = 'WHITELIST'"))
    rows = longest(drop_shadowed(found)).select("doc_id", F.struct("s", (-F.col("e")).alias("e"), rank().alias("r"), "word", "wtype").alias("m"))
    rows = rows.groupBy(F.col("doc_id").alias("_key")).agg(F.array_sort(F.collect_set("m")).alias("_m"))
    m = F.coalesce("_m", F.array().cast(rows.schema["_m"].dataType))
    e = F.transform(m, lambda x: -x["e"])
    spans = F.transform(m, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e")))
    masked = span_mask(F.col("text"), spans) if mask == "place" else star_mask(F.col("text"), F.array_distinct(m["word"]))
    hits = F.struct(m["s"].alias("s"), e.alias("e"), m["word"].alias("word"), m["wtype"].alias("wtype"), masked.alias("masked"))
    return keyed.join(rows, "_key", "left").withColumn("hits", hits).drop("_key", "_m", "_tokens")


def exploded(rows: DataFrame) -> DataFrame:
    """doc_id, s, e, word, wtype of rows with hits."""
    each = F.explode(F.arrays_zip("hits.s", "hits.e", "hits.word", "hits.wtype")).alias("m")
    return rows.select("doc_id", each).select("doc_id", "m.*")


def match_texts(docs: DataFrame, lexicon: DataFrame, channels: tuple[str, ...] = CHANNELS, text_col: str = "text", pattern: str = TOKEN) -> DataFrame:
    """Matches of the given channels, found in one pass over the texts.

    form: runs of the text that match `pattern` and are a word. substring: every occurrence of every word. evasion: every
    occurrence in the compact form of a text that has one, at its places in the text itself. The result is the same for a
    lexicon of any size: a small one is an automaton in each worker, of a large one what may be a word is joined with it.
    """
    words = resolve(lexicon)
    whole, beginnings, prefix = None, {}, PREFIX
    if fits(words):
        whole = {r.word: r.wtype for r in words.collect()}  # of at most LEXICON_CHARS characters
    else:
        if words.select(F.left("word", F.lit(prefix))).distinct().count() > BEGINNINGS:
            prefix = 1
        begin = words.select(F.left("word", F.lit(prefix)).alias("b"), F.length("word").alias("n")).groupBy("b").agg(F.collect_set("n").alias("n"))
        beginnings = {r.b: sorted(r.n) for r in begin.collect()}  # at most BEGINNINGS, or a row for each character
    shared = docs.sparkSession.sparkContext.broadcast((whole, beginnings, prefix))
    forms, substrings, evasions = (c in channels for c in CHANNELS)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, token = Search(*shared.value), regex.compile(pattern)
        for batch in arrived:
            for k, n in batches.slices(batch.column(1)):
                starts, ends, found, counts = [], [], [], []
                for text in batch.column(1).slice(k, n).to_pylist():
                    rows = []
                    if forms:
                        rows += [(m.start(), m.end() - 1, m.group()) for m in token.finditer(text) if search.may_be(m.group())]
                    if substrings:
                        rows += search.find(text)
                    if evasions and _FILLER.search(text):
                        short, kept = compact(text)
                        rows += [(kept[s], kept[e], w) for s, e, w in search.find(short)]
                    counts.append(len(rows))
                    for s, e, w in rows:
                        starts.append(s)
                        ends.append(e)
                        found.append(w)
                ids = batch.column(0).slice(k, n).take(pa.array(np.repeat(np.arange(n), counts)))
                made = {"doc_id": ids, "s": pa.array(starts, pa.int32()), "e": pa.array(ends, pa.int32()), "word": pa.array(found, pa.string())}
                if whole is not None:
                    made["wtype"] = pa.array([search.words[w] for w in found], pa.string())
                yield pa.RecordBatch.from_pydict(made)

    batches.bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col(text_col).alias("text")).where("text is not null")
    if whole is not None:
        return texts.mapInArrow(run, f"doc_id {kind}, s int, e int, word string, wtype string")
    return texts.mapInArrow(run, f"doc_id {kind}, s int, e int, word string").join(words, "word").select("doc_id", "s", "e", "word", "wtype")


def match_substrings(docs: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """Every occurrence, overlapping ones too, of every word in the text."""
    return match_texts(docs, lexicon, ("substring",), text_col)


def match_evasions(docs: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences in the compact form of texts that it changes (filler between letters left out), at their places in the text."""
    return match_texts(docs, lexicon, ("evasion",), text_col)


def match_jamo(docs: DataFrame, lexicon: DataFrame, text_col: str = "text") -> DataFrame:
    """Occurrences of the words' jamo forms in the texts' jamo forms, at their places in the texts: split, exchanged, doubled
    and keyboard letters are seen through. Of words of one form the first that `resolve` would take counts, then the smallest.

    A lexicon that isn't sent whole (`fits`) is refused: its forms have no beginnings to be joined by.
    """
    words = resolve(lexicon)
    if not fits(words):
        raise ValueError(f"the lexicon has over {LEXICON_CHARS} characters")
    forms: dict[str, tuple[int, str, str]] = {}
    for r in words.collect():  # at most LEXICON_CHARS characters
        if form := jamo_form(r.word)[0]:
            forms[form] = min(forms.get(form, (9, "", "")), (PRECEDENCE.get(r.wtype, 2), r.word, r.wtype))
    shared, name = docs.sparkSession.sparkContext.broadcast({f: f for f in forms}), uuid.uuid4().hex
    names = docs.sparkSession.sparkContext.broadcast(forms)

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, known = _search(name, shared), names.value
        for batch in arrived:
            for k, n in batches.slices(batch.column(1)):
                codes, places, cuts = jamo_forms(batch.column(1).slice(k, n).to_pylist())
                short = codes.astype("<u4").tobytes().decode("utf-32-le")
                found = [m for i, j in pairwise(cuts.tolist()) for m in search.find(short[i:j], i)]
                s, e = (np.array([m[x] for m in found], np.int64) for x in (0, 1))
                which = pa.array(np.searchsorted(cuts, s, side="right") - 1)
                words, kinds = (pa.array([known[m[2]][x] for m in found], pa.string()) for x in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, n).take(which), pa.array(places[s]), pa.array(places[e]), words, kinds], ["doc_id", "s", "e", "word", "wtype"])

    batches.bounded(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col(text_col).alias("text")).where("text is not null")
    return texts.mapInArrow(run, f"doc_id {kind}, s int, e int, word string, wtype string")


def drop_shadowed(matches: DataFrame) -> DataFrame:
    """Matches that no white match contains; white matches themselves go too.

    A running maximum of white ends over a document's matches by their starts: the work grows with the matches.
    """
    so_far = Window.partitionBy("doc_id").orderBy("s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("wtype") == "WHITELIST", F.col("e"))).over(so_far)
    return matches.withColumn("_reach", reach).where("wtype <> 'WHITELIST' and (_reach is null or _reach < e)").drop("_reach")


def on_nouns(matches: DataFrame, tokens: DataFrame) -> DataFrame:
    """Matches that share a character with a noun or unknown token: one that begins by the match's end and ends after its start."""
    nouns = tokens.where("tag like 'NN%' or tag like 'UN%'").select("doc_id", F.col("start").alias("at"), (F.col("start") + F.col("len") - 1).alias("stop"))
    both = matches.withColumns({"at": F.col("e"), "stop": F.lit(None).cast("int")}).unionByName(nouns, allowMissingColumns=True)
    by_place = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_reach", F.max("stop").over(by_place)).where("s is not null and _reach >= s").select(*matches.columns)


def longest(matches: DataFrame) -> DataFrame:
    """Matches whose span lies in no other span; of equal (span, word) the blacklisted one."""
    w = Window.partitionBy("doc_id").orderBy("s")
    before = F.max("e").over(w.rangeBetween(Window.unboundedPreceding, -1))
    upto = F.max("e").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    outer = matches.withColumns({"_before": before, "_upto": upto}).where("coalesce(_before, -1) < e and _upto <= e")
    one = outer.groupBy("doc_id", "s", "e", "word").agg(F.min(rank()).alias("rank"))
    return one.select("doc_id", "s", "e", "word", F.when(F.col("rank") == 1, "USER_BLACKLIST").when(F.col("rank") == 0, "WHITELIST").otherwise("SYSTEM_KEYWORD").alias("wtype"))


def spans_of(s: str = "s", e: str = "e"):
    """A document's spans, sorted, as an aggregate for span_mask."""
    return F.array_sort(F.collect_set(F.struct(F.col(s).cast("int").alias("s"), F.col(e).cast("int").alias("e"))))


def merged_spans(matches: DataFrame) -> DataFrame:
    """doc_id, spans: the sorted spans of each document, for span_mask."""
    return matches.groupBy("doc_id").agg(spans_of().alias("spans"))
