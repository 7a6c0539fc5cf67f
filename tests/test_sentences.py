import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators.sentences import sentences, split_text

CASES = [
    ("en", [], "Hello world. How are you?", ["Hello world.", "How are you?"]),
    ("en", [], "See Dr. Smith. He knows.", ["See Dr. Smith.", "He knows."]),
    ("en", [], "As in Fig. 3 and e.g. Alice. Done.", ["As in Fig. 3 and e.g. Alice.", "Done."]),
    ("en", [], 'He said "wow!" and left. Then he came.', ['He said "wow!" and left.', "Then he came."]),
    ("en", [], "Pi is 3.14 today. U.S. law holds.", ["Pi is 3.14 today.", "U.S. law holds."]),
    ("en", [], "Use `a. B` now. Or [x. Y](http://a.b/c. D). End.", ["Use `a. B` now.", "Or [x. Y](http://a.b/c. D).", "End."]),
    ("en", ["Abstr"], "See Abstr. Five. Ok.", ["See Abstr. Five.", "Ok."]),
    ("en", [], "See Abstr. Five. Ok.", ["See Abstr.", "Five.", "Ok."]),
    ("de", [], "Das gilt z.B. Hier. Siehe Abb. Drei.", ["Das gilt z.B. Hier.", "Siehe Abb. Drei."]),
    ("xx", [], "Mr. X is here. Yes.", ["Mr. X is here.", "Yes."]),
    ("en", [], "", []),
    ("en", [], " \t\n ", []),
    ("en", [], "***", ["***"]),
    ("en", [], "a. \x00b\x01", ["a. b"]),
    ("en", [None], "One. Two.", ["One.", "Two."]),
    ("en", [], "wait... What? yes!", ["wait...", "What?", "yes!"]),
    ("en", [], "First line.\nSecond line.", ["First line.", "Second line."]),
]


@pytest.mark.parametrize("lang, extras, text, expected", CASES)
def test_cases(spark, lang, extras, text, expected):
    df = spark.createDataFrame([(text, lang, extras)], "t string, l string, e array<string>")
    assert df.select(sentences(F.col("t"), F.col("l"), F.col("e")).alias("s")).first()["s"] == expected
    assert split_text(text, lang, tuple(x for x in extras if x)) == expected


def test_null(spark):
    df = spark.createDataFrame([(None, None, None)], "t string, l string, e array<string>")
    assert df.select(sentences(F.col("t"), F.col("l"), F.col("e")).alias("s")).first()["s"] is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("Aab .!?\"')]5é\u00a0語。-,$`~", max_size=40), min_size=20, max_size=40))
def test_both_engines_agree(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert r.s == split_text(r.t), r.t
