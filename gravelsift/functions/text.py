"""Text functions: Column in, Column out, built-in expressions but for nfkc, span_mask and jamo_places. Offsets count Unicode code points."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gravelsift.functions import batches

#: Letters, as opposed to filler, and the white space that Java's class misses.
LETTER = "가-힣A-Za-z"
SPACE = r"\s\x1c-\x1f"
#: Jamo in the order of the Unicode syllable formula.
CHO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
JUNG = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
JONG = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
#: Tense consonants and their plain forms; keys of a Korean keyboard typed as Latin letters and digits.
TENSE, PLAIN = "ㄲㄸㅃㅆㅉ", "ㄱㄷㅂㅅㅈ"
KEYBOARD = "abcdefghijklmnoprstuvwxyz018", "ㅏㅂㅋㄷㅔㅍㄱㅎㅣㅈㅋㄹㅁㄴㅗㅂㄹㅅㅌㅜㅂㅜㅋㅣㅈㅇㅣㅂ"


def compact_normalize(text: Column) -> Column:
    """Delete runs of one or two characters that are neither letters nor spaces and stand between two letters."""
    return F.regexp_replace(text, f"(?U)(?<=[{LETTER}])[^{LETTER}\\s]{{1,2}}(?=[{LETTER}])", "")


def nonspace_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"(?U)[{SPACE}]", ""))


def lone_consonants(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ㄱ-ㅎ]"))


def lone_vowels(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ㅏ-ㅣ]"))


def specials(text: Column) -> Column:
    """Characters that are no space, letter or digit."""
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}\\p{{L}}\\p{{N}}]"))


#: The letters of laughter.
LAUGHTER = frozenset("ㅋㅎ")


def is_laughter(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)[{SPACE}]", "").rlike("^[ㅋㅎ]+$")


def legacy_normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^가-힣a-zA-Z0-9\s]", "")


def nfkc(text: Column) -> Column:
    """Unicode form NFKC, which has no built-in function: ASCII texts pass as they are, others go to Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return run(text)


def text_key(text: Column) -> Column:
    """Lower case without spaces, zero-width characters, punctuation and symbols; for other input than NFKC put nfkc first."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "(?U)[\\s​-‏⁠︎️﻿]", ""), r"[\p{P}\p{S}]", "")


def decompose(ch: Column) -> Column:
    """A Hangul syllable as its jamo; any other character as it is."""
    code = F.ascii(ch) - 0xAC00
    table = lambda values: F.array(*map(F.lit, values))
    parts = F.concat(
        F.element_at(table(CHO), (F.floor(code / 588) + 1).cast("int")), F.element_at(table(JUNG), (F.floor(code % 588 / 28) + 1).cast("int")),
        F.element_at(table(JONG), (code % 28 + 1).cast("int")),
    )
    return F.when((code >= 0) & (code < 11172), parts).otherwise(ch)


def code_point(code: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF, by its UTF-8 bytes (the built-in chr stops at 255)."""
    parts = (F.lit(0xE0) + F.floor(code / 4096), F.lit(0x80) + F.floor(code / 64) % 64, F.lit(0x80) + code % 64)
    return F.decode(F.unhex(F.concat(*(F.lpad(F.hex(x), 2, "0") for x in parts))), "UTF-8")


def fold_tense(text: Column) -> Column:
    return F.translate(text, TENSE, PLAIN)


def jamo_normalize(text: Column, keyboard: tuple[str, str] = KEYBOARD) -> Column:
    """Letters and digits only, lower case, syllables as plain jamo, runs of one character once.

    keyboard: Latin keys and the jamo that they stand for in a text that holds Hangul.
    """
    kept = F.lower(F.regexp_replace(text, "[^가-힣ㄱ-ㅣA-Za-z0-9]", ""))
    if keyboard[0]:
        kept = F.when(kept.rlike("[가-힣ㄱ-ㅣ]"), F.translate(kept, *keyboard)).otherwise(kept)
    jamo = F.when(kept.rlike("[가-힣]"), F.array_join(F.transform(F.split(kept, ""), decompose), "")).otherwise(kept)
    return F.regexp_replace(fold_tense(jamo), r"(.)\1+", "$1")


_HANGUL, _KEPT = re.compile("[가-힣ㄱ-ㅣ]"), re.compile("[가-힣ㄱ-ㅣA-Za-z0-9]")
_KEYS = str.maketrans(*KEYBOARD)
_TENSE = str.maketrans(TENSE, PLAIN)


def jamo_form(text: str) -> tuple[str, list[int]]:
    """jamo_normalize of one text, and for each of its characters the place in the text."""
    keys, out, places = _KEYS if _HANGUL.search(text) else {}, [], []
    for m in _KEPT.finditer(text):
        c = m.group().lower().translate(keys)
        code = ord(c) - 0xAC00
        parts = CHO[code // 588] + JUNG[code % 588 // 28] + JONG[code % 28] if 0 <= code < 11172 else c
        for x in parts.translate(_TENSE):
            if not out or out[-1] != x:
                out.append(x)
                places.append(m.start())
    return "".join(out), places


@cache
def _jamo_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code up to U+FFFF: whether a character is kept, whether it is Hangul, and its plain jamo (0: none) without and with keys."""
    kept, hangul, parts = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool), np.zeros((2, 1 << 16, 3), np.uint16)
    for c in filter(_KEPT.match, map(chr, [*range(0x80), *range(0x3131, 0x3164), *range(0xAC00, 0xD7A4)])):
        kept[ord(c)], hangul[ord(c)] = True, bool(_HANGUL.match(c))
        for k, keys in enumerate(({}, _KEYS)):
            x = c.lower().translate(keys)
            code = ord(x) - 0xAC00
            x = CHO[code // 588] + JUNG[code % 588 // 28] + JONG[code % 28] if 0 <= code < 11172 else x
            parts[k, ord(c), : len(x)] = [ord(y) for y in x.translate(_TENSE)]
    return kept, hangul, parts


def jamo_forms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, places, cuts): jamo_form of many texts side by side; those of text k are at cuts[k] to cuts[k + 1]."""
    kept, hangul, parts = _jamo_tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code < 1 << 16, code, 0).astype(np.uint16)
    at = np.flatnonzero(kept[code])
    code, row = code[at], np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[at]
    keys = np.bincount(row[hangul[code]], minlength=len(texts)) > 0
    place = (at - (np.cumsum(sizes) - sizes)[row]).astype(np.int32)
    x = parts[keys[row].astype(np.int8), code]
    there = x > 0
    n = there.sum(axis=1)
    x, place, row = x[there], np.repeat(place, n), np.repeat(row, n)
    first = np.ones(len(x), bool)
    first[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[first], place[first], np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=len(texts)))])


def jamo_places(text: Column) -> Column:
    """struct<jamo, places> of jamo_form, in Arrow batches; null for null."""
    batches.bounded()

    def made(texts: pa.Array) -> pa.Array:
        codes, places, cuts = jamo_forms(texts.fill_null("").to_pylist())
        letters = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.concatenate([[0], np.cumsum(np.where(codes < 0x80, 1, 3))])[cuts].astype(np.int32)  # jamo have three bytes
        jamo = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(letters))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(places, pa.int32()))
        return pa.StructArray.from_arrays([jamo, lists], ["jamo", "places"], mask=texts.is_null())

    @F.arrow_udf("struct<jamo:string,places:array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        return batches.by_slices(made, texts)

    return run(text)


def star_mask(text: Column, words: Column) -> Column:
    """Replace each word of an array everywhere by stars, in the array's order."""
    return F.aggregate(words, text, lambda t, w: F.when(F.length(w) > 0, F.replace(t, w, F.repeat(F.lit("*"), F.length(w)))).otherwise(t))


def token_mask(text: Column, tokens: Column) -> Column:
    """Replace distinct tokens by stars, the longest first (then in code point order)."""
    ordered = F.array_sort(F.array_distinct(tokens), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return star_mask(text, ordered)


def span_mask(text: Column, spans: Column, keep_spaces: bool = False, spare_laughter: bool = False) -> Column:
    """Stars over spans (array<struct<s, e>>, e inclusive), which are sorted by s; they may overlap.

    keep_spaces: white space stays. spare_laughter: spans of nothing but laughter and white space (is_laughter) stay.

    Cutting a string at a place reads it from its beginning, so built-in expressions would read a text once for each span;
    here it is cut once, in Arrow batches.
    """

    batches.bounded()

    def made(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        masked = []
        for whole, s, e in zip(*(x.to_pylist() for x in (texts, starts, ends)), strict=True):
            if whole is None or s is None:
                masked.append(whole)
                continue
            out, at = [], 0
            for a, b in zip(s, e, strict=True):
                if spare_laughter and set("".join(whole[a : b + 1].split())) - LAUGHTER == set() != set(whole[a : b + 1].split()):
                    continue
                a = max(a, at)
                if b >= a:
                    inner = whole[a : b + 1]
                    out += [whole[at:a], "".join([c if c.isspace() else "*" for c in inner]) if keep_spaces else "*" * len(inner)]
                    at = b + 1
            out.append(whole[at:])
            masked.append("".join(out))
        return pa.array(masked, pa.string())

    @F.arrow_udf("string")
    def run(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        return batches.by_slices(made, texts, starts, ends)

    return run(text, spans["s"], spans["e"])


def merge_mask(masked: Column, spans: Column) -> Column:
    """A masked text with stars over further spans (array<struct<s, e>>, e inclusive) too, white space apart; a span that
    holds a star already stays as it is."""
    piece = lambda x: F.substring(masked, x["s"] + 1, x["e"] - x["s"] + 1)
    return span_mask(masked, F.filter(spans, lambda x: ~F.contains(piece(x), F.lit("*"))), keep_spaces=True)


def soften_mask(text: Column, words: Column) -> Column:
    """What stands for a softened text until there is one: the words replaced by stars."""
    return star_mask(text, words)


def keyword_ratio(masked: Column, text: Column) -> Column:
    """Stars in the masked text by characters of the text that are no spaces; 0 for a text without any."""
    n = nonspace_length(text)
    return F.when(n > 0, F.regexp_count(masked, F.lit(r"\*")) / n).otherwise(F.lit(0.0))


def display_text(action: Column, mode: Column, text: Column, masked: Column, placeholder: Column) -> Column:
    """What an overlay shows: the text unless masked or blocked; then nothing, the placeholder or the masked text."""
    return F.when(action.isin("NORMAL", "REVIEW", "ERROR"), text).when(mode == "HIDE", F.lit(None).cast("string")).when(mode == "PLACEHOLDER", placeholder).otherwise(masked)


def parse_modules(value: Column, every: tuple[str, ...]) -> Column:
    """'' -> none, ALL -> all, else the trimmed, lower-case parts of a comma-separated list."""
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.trim(value) == "", F.array().cast("array<string>")).when(F.upper(F.trim(value)) == "ALL", F.array(*map(F.lit, every))).otherwise(parts)


def pills(detected: Column) -> Column:
    """'word|TYPE,...' as blacklist, AI:{modules} and system labels, in that order."""
    items = F.filter(F.split(detected, ","), lambda x: F.contains(x, F.lit("|")))
    kind = lambda x: F.split_part(x, F.lit("|"), F.lit(2))
    modules = F.array_distinct(F.transform(F.filter(items, lambda x: kind(x) == "AI_BASIC"), lambda x: F.split_part(x, F.lit("|"), F.lit(1))))
    made = F.array(
        F.when(F.exists(items, lambda x: kind(x) == "USER_BLACKLIST"), F.lit("blacklist")),
        F.when(F.size(modules) > 0, F.concat(F.lit("AI:"), F.array_join(modules, ","))),
        F.when(F.exists(items, lambda x: kind(x) == "SYSTEM_KEYWORD"), F.lit("system")),
    )
    return F.array_compact(made)


def preview(text: Column, n: int = 20) -> Column:
    return F.replace(F.left(text, F.lit(n)), F.lit("\n"), F.lit(" "))


def query_parameter(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def clean_word(word: Column, lower: bool = True) -> Column:
    return F.lower(strip(word)) if lower else strip(word)


def star_all(text: Column) -> Column:
    """Every character but white space as a star."""
    return F.regexp_replace(text, f"(?U)[^{SPACE}]", "*")


def signature(**lists: Column) -> Column:
    """'i:a,b|t:c' of sorted lists."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{k}:"), F.array_join(F.array_sort(v), ",")) for k, v in lists.items()))


def any_contains(text: Column, words: list[str]) -> Column:
    """Whether any non-empty word is in the text, upper and lower case apart: one condition over an array, for any number."""
    real = [w for w in words if w]
    return F.exists(F.array(*map(F.lit, real)), lambda w: F.contains(text, w)) if real else F.lit(False)
