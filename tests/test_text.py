"""Text functions and scores against stated cases and plain models."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gravelsift.functions import scoring, text


def values(spark, rows, column):
    """The column over one-column rows, in order."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(("given", "want"), [("시1발", "시발"), ("시!.발", "시발"), ("시!!!발", "시!!!발"), ("", ""), ("a b", "a b"), ("aéb", "ab")])
def test_compact_normalize(spark, given, want):
    assert values(spark, [given], text.compact_normalize(F.col("t"))) == [want]


def test_compact_normalize_against_a_model(spark):
    random.seed(1)
    rows = ["".join(random.choice("ab가1! .é") for _ in range(random.randint(0, 14))) for _ in range(400)]

    def model(t):
        letter = lambda c: bool(re.match("[가-힣A-Za-z]", c))
        out, i = "", 0
        while i < len(t):
            j = i
            while j < len(t) and not letter(t[j]) and not t[j].isspace():
                j += 1
            if 1 <= j - i <= 2 and i > 0 and letter(t[i - 1]) and j < len(t) and letter(t[j]):
                i = j
            elif j > i:
                out, i = out + t[i:j], j
            else:
                out, i = out + t[i], i + 1
        return out

    assert values(spark, rows, text.compact_normalize(F.col("t"))) == [model(t) for t in rows]


def test_jamo(spark):
    assert values(spark, ["씨이발", "시1발", "AAb", "가나다", ""], text.jamo_normalize(F.col("t"))) == ["ㅅㅣㅇㅣㅂㅏㄹ", "ㅅㅣㅂㅏㄹ", "ab", "ㄱㅏㄴㅏㄷㅏ", ""]


def test_masks(spark):
    spans = F.from_json(F.lit('[{"s":1,"e":2},{"s":4,"e":4}]'), "array<struct<s:int,e:int>>")
    assert values(spark, ["ab cd"], text.span_mask(F.col("t"), spans)) == ["a**c*"]
    assert values(spark, ["ab cd"], text.span_mask(F.col("t"), spans, keep_spaces=True)) == ["a* c*"]
    assert values(spark, ["the thin"], text.token_mask(F.col("t"), F.array(F.lit("th"), F.lit("the")))) == ["*** **in"]
    assert values(spark, ["aab"], text.star_mask(F.col("t"), F.array(F.lit("a"), F.lit("")))) == ["**b"]


def test_scores(spark):
    one = lambda c: values(spark, ["x"], c)[0]
    assert one(scoring.pack_score(scoring.caution_bucket(F.lit(2.0), F.lit(10.0)))) == 0.29
    assert one(scoring.pack_score(scoring.caution_bucket(F.lit(1.0), F.lit(20.0)))) == 0.26
    assert one(scoring.pack_score(scoring.warn_bucket(F.lit(5.0), F.lit(10.0)))) == 0.62
    assert one(scoring.pack_score(scoring.warn_bucket(F.lit(12.0), F.lit(10.0)) + 25)) == 1.0
    assert values(spark, ["!!!abcdefg"], scoring.pack_score(scoring.normal_bucket(F.col("t")))) == [0.23]


@pytest.mark.parametrize(("level", "kind", "want"), [("HIGH", "trigger", "FULL_BLOCK"), ("LOW", "general", "REVIEW"), ("MEDIUM", "blacklist", "FULL_BLOCK")])
def test_matrix(spark, level, kind, want):
    assert values(spark, ["x"], scoring.matrix_action(F.lit(level), F.lit(kind))) == [want]


def test_client_score(spark):
    got = [values(spark, ["x"], scoring.client_score(F.lit(0.28), F.lit(lv), F.lit(False), F.lit(False), F.lit(True)))[0] for lv in ("LOW", "MEDIUM")]
    assert got == pytest.approx([0.28, 0.53])


def test_words(spark):
    assert values(spark, ["", " ALL ", " A ,b,"], F.array_join(text.parse_modules(F.col("t"), ("x", "y")), "+")) == ["", "x+y", "a+b"]
    assert values(spark, ["ㅋㅋ ㅎ", "ㅋa"], text.is_laughter(F.col("t"))) == [True, False]
    assert values(spark, ["a|USER_BLACKLIST,spam|AI_BASIC,b|SYSTEM_KEYWORD"], F.array_join(text.pills(F.col("t")), " ")) == ["blacklist AI:spam system"]
