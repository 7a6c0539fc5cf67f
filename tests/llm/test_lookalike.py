import unicodedata

import pytest

from lectern.llm import lookalike


def forms(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "call_id bigint, text string")
    return [r.form for r in lookalike.consistent_form(df).orderBy("call_id").collect()]


def test_same(spark):
    groups = [
        ["Office 12-A", "Oﬃce\u00a012‑A", "Ｏｆｆｉｃｅ　１２－Ａ", "Of\u200bfice 12\u00ad-A", "Оffiсе 12-А"],
        ["café", "cafe\u0301", "ｃａｆｅ\u0301", "c\u200da\u2060fé", "саfé"],
        ["ガード", "ｶﾞｰﾄﾞ"], ["Ⅳ. x", "IV. x"], ["a b", "a\u2009b", "a\u3000b", "a\u205fb"], ["ёлка", "е\u0308лка"],
    ]
    for group in groups:
        assert len(set(forms(spark, *group))) == 1, group


def test_different(spark):
    texts = ["Office", "office", "Offıce", "offices", "office 1", "office 2", "café", "cafe", "a b", "a  b", "a\nb", "a\r\nb", "x²", "x2", "a–b", "a-b"]
    got = forms(spark, *texts)
    assert len(set(got)) == len(texts)


def test_null_and_empty(spark):
    assert forms(spark, None, "", " ") == [None, "", " "]


def test_nothing_left_to_compose(spark):
    for form in forms(spark, "e\u0301a\u0308\u1100\u1161", "Å", "ﬁ ﬂ"):
        assert unicodedata.normalize("NFC", form) == form


def test_pairs(spark):
    rows = [(5, "a b"), (3, "a\u00a0b"), (3, "a\u00a0b"), (1, "a b"), (2, "A b"), (4, None), (6, ""), (7, "\u200b"), (8, "a\u2009b"), (9, "  "), (10, "\u00a0 "), (None, "a b")]
    got = sorted(tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "call_id bigint, text string")).collect())
    assert got == [(1, 3), (1, 8), (3, 5), (3, 8), (5, 8)]
    assert lookalike.lookalike_pairs(spark.createDataFrame([], "call_id bigint, text string")).count() == 0


def test_classes(spark):
    rows = [(5, "a b"), (3, "a\u00a0b"), (3, "a\u00a0b"), (1, "a b"), (2, "A b"), (4, None), (7, "x"), (8, "x"), (9, "օne"), (10, "one")]
    got = sorted(tuple(r) for r in lookalike.lookalike_classes(spark.createDataFrame(rows, "call_id bigint, text string")).collect())
    assert got == [(1, 1, 2, 3), (3, 1, 2, 3), (5, 1, 2, 3), (9, 9, 2, 2), (10, 9, 2, 2)]


def test_hot_class(spark):
    rows = [(i, "same text") for i in range(2000)] + [(9999, "ѕame text")]
    got = lookalike.lookalike_pairs(spark.createDataFrame(rows, "call_id bigint, text string"))
    assert got.count() == 2000


@pytest.mark.parametrize("code", [0x180B, 0x180D, 0x180F, 0x2065, 0xFFF0, 0xE0001, 0xE0041, 0xE007F, 0xE0100, 0xE01EF])
def test_default_ignorable(spark, code):
    assert forms(spark, f"a{chr(code)}b", "a\U00020000b", "a\u180ab") == ["ab", "a\U00020000b", "a\u180ab"]
