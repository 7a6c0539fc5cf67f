import pytest
from pyspark.sql import functions as F

from lectern.operators import checks, diffs
from lectern.operators.formatting import format_df, format_range_df, format_text, wrapped
from lectern.operators.parsers import regions_of

MARKDOWN = """---
title: A. B.
---

# One. Two.

First here. Second
here, too.

```
code. Stays. As is.
```

- Item one. And more
  of it. End.
- Item two.

| a. B | c |

lectern:off
Not. This. One.
<!-- lectern:on -->
But this. Yes.
"""
MARKDOWN_DONE = """---
title: A. B.
---

# One.
Two.

First here.
Second here, too.

```
code. Stays. As is.
```

- Item one.
And more of it.
End.
- Item two.

| a. B | c |

lectern:off
Not. This. One.
<!-- lectern:on -->
But this.
Yes.
"""
ORG = "#+TITLE: A. B.\n\n* TODO Head one. Head two.\n:PROPERTIES:\n:ID: x. Y\n:END:\nProse one. Prose two.\n#+BEGIN_SRC py\na. B.\n#+END_SRC\n- Item. More.\n  goes on. End.\n\\begin{eq}\nE. F.\n\\end{eq}\n"
ORG_DONE = "#+TITLE: A. B.\n\n* TODO Head one.\nHead two.\n:PROPERTIES:\n:ID: x. Y\n:END:\nProse one.\nProse two.\n#+BEGIN_SRC py\na. B.\n#+END_SRC\n- Item.\nMore. goes on.\nEnd.\n\\begin{eq}\nE. F.\n\\end{eq}\n"
LATEX = "\\documentclass{a}\nPre. Amble.\n\\begin{document}\nOne. Two.\n% note. Note.\n\\begin{equation}\nE. F.\n\\end{equation}\n\\[ x. Y \\]\nThree. Four.\n\\end{document}\n"
LATEX_DONE = "\\documentclass{a}\nPre. Amble.\n\\begin{document}\nOne.\nTwo.\n% note. Note.\n\\begin{equation}\nE. F.\n\\end{equation}\n\\[ x. Y \\]\nThree.\nFour.\n\\end{document}\n"
RST = "Title. One\n==========\n\nOne. Two.\n\n.. note::\n\n   Body. Body.\n\nExample::\n\n   Lit. Lit.\n\n:field: a. B\n\nThree. Four.\n"
RST_DONE = RST.replace("One. Two.", "One.\nTwo.").replace("Three. Four.", "Three.\nFour.")
GOLDEN = [
    ("markdown", MARKDOWN, MARKDOWN_DONE), ("org", ORG, ORG_DONE), ("latex", LATEX, LATEX_DONE), ("rst", RST, RST_DONE),
    ("plaintext", "One. Two.\nthree.\n\nFour.", "One.\nTwo. three.\n\nFour."), ("plaintext", "One. Two.\r\nA", "One.\r\nTwo.\r\nA".replace("Two.\r\nA", "Two.\r\nA")),
    ("latex", "No. Document. Here.", "No. Document. Here."), (None, "A b. C d.", "A b.\nC d."), ("plaintext", "", ""), ("markdown", "\n\n", "\n\n"), ("org", "- \n  a b c.\n", "- a b c.\n"),
]


@pytest.mark.parametrize("format, text, expected", GOLDEN)
def test_golden(spark, format, text, expected):
    assert format_text(text, format) == expected
    df = spark.createDataFrame([(text, format)], "text string, format string")
    got = format_df(df).first()["formatted"]
    assert got == expected
    assert format_text(expected, format) == expected


def test_empty_and_extra_columns(spark):
    schema = "formatted string, text string, format string, value int"
    assert format_df(spark.createDataFrame([], schema).withColumnRenamed("formatted", "other")).count() == 0
    df = spark.createDataFrame([("x", None, "org", 1), ("y", "A b. C d.", None, None)], "other string, text string, format string, value int")
    rows = {r.other: r for r in format_df(df).collect()}
    assert rows["x"].formatted is None and rows["x"].value == 1 and rows["y"].formatted == "A b.\nC d."


def test_width():
    assert wrapped("Alpha beta gamma delta epsilon zeta.", 12).split("\n") == ["Alpha beta", "gamma delta", "epsilon", "zeta."] or len(wrapped("Alpha beta gamma delta epsilon zeta.", 12).split("\n")) == 4
    for width in range(1, 30):
        lines = wrapped("Alpha beta gamma-delta epsilonzetaetatheta 漢字漢字 x", width).split("\n")
        assert all(len(x) <= width or width == 1 for x in lines)
        assert "".join(lines).replace(" ", "") == "Alphabetagamma-deltaepsilonzetaetatheta漢字漢字x"


def test_ranges(spark):
    text = "A a. B b.\nC c. D d.\nE e. F f.\n"
    rows = [(1, 1, "A a.\nB b.\nC c. D d.\nE e. F f.\n"), (2, 2, "A a. B b.\nC c.\nD d.\nE e. F f.\n"), (2, 99, "A a. B b.\nC c.\nD d.\nE e.\nF f.\n"), (9, 10, text), (None, None, text), (0, 1, "A a.\nB b.\nC c. D d.\nE e. F f.\n")]
    df = spark.createDataFrame([(text, "plaintext", a, b, x) for a, b, x in rows], "text string, format string, a int, b int, x string")
    for r in format_range_df(df, F.col("a"), F.col("b")).collect():
        assert r.formatted == r.x, (r.a, r.b)


@pytest.mark.parametrize("format", ["plaintext", "markdown", "org", "latex", "rst", "other"])
def test_regions_keep_letters(format):
    for _, text, _ in GOLDEN:
        text = text.replace("\r", "")
        bare = lambda s: "".join(c for c in s if c.isalnum())
        assert bare("".join(t for _, t in regions_of(text, format))) == bare(text)


def test_checks(spark):
    df = spark.createDataFrame([(1, "A b. C d.\nE.", "plaintext"), (2, "A b.\n", "plaintext"), (3, None, None), (4, "", "org")], "id int, text string, format string")
    assert [tuple(r) for r in checks.check_df(df, "id").collect()] == [(1, 2, 3)]
    assert {r.id: r.v for r in df.select("id", checks.violations(F.col("text")).alias("v")).collect()} == {1: [1], 2: [], 3: None, 4: []}
    d = checks.diagnostics_df(df, "id").collect()
    assert [(r.id, r.line, r.start_col, r.end_col) for r in d] == [(1, 0, 4, 5)]
    assert [r.new_text for r in checks.quick_fixes(df, "id").collect()] == ["A b.\nC d."]


def test_diffs(spark):
    assert diffs.unified("a\nb\n", "a\nb\n", "x", "x") == ""
    assert diffs.unified("a\nb\nc\n", "a\nB\nc\n", "x", "y") == "--- a/x\n+++ b/y\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c\n"
    pairs = spark.createDataFrame([(1, "One a. Two b.", "One a. Two c.", "plaintext"), (2, "X y. Z w.", "X y.\nZ w.", "plaintext")], "id int, old_text string, new_text string, format string")
    got = {(r.id, r.op, r.sentence) for r in diffs.sentence_changes(pairs, "id").collect()}
    assert got == {(1, "removed", "Two b."), (1, "added", "Two c.")}
    assert [r.id for r in diffs.sentence_diff_df(pairs, "id").collect()] == [1]


def test_plain_regions_are_the_readers(spark):
    import random

    from lectern.operators.plain_regions import plain_regions

    random.seed(3)
    bits = ["a b", "\n", "\n", "\n\n", " ", "\t", "lectern:off", "lectern:on", "# lectern:off", "<!-- lectern:on -->", "% lectern:off", "\u3000", "x:off", "\u00e9.", "\u2028"]
    texts = ["", "\n", "a", "line\n" * 50_000, *("".join(random.choices(bits, k=random.randint(0, 25))) for _ in range(200))]
    got = {}
    for r in plain_regions(spark.createDataFrame([*enumerate(texts), (-1, None)], "k int, text string"), "k").orderBy("k", "region_no").collect():
        got.setdefault(r.k, []).append((r.kind, r.text))
    assert -1 not in got
    for k, text in enumerate(texts):
        assert got.get(k, []) == regions_of(text, None)


def test_changes():
    import random

    random.seed(1)
    for n in range(1500):
        a = random.choices("abcdef", k=random.randint(0, 25))
        b = random.choices("abcdef", k=random.randint(0, 25)) if n % 2 else [x for x in a if random.random() > 0.1] + ["z"]
        i = k = 0
        for i1, j1, k1, m1 in [*diffs.changes(a, b), (len(a), len(a), len(b), len(b))]:
            assert a[i:i1] == b[k:k1] and (j1 > i1 or m1 > k1 or i1 == len(a))
            i, k = j1, m1
    assert diffs.changes(["x"] * 20_000 + ["a"], ["y"] + ["x"] * 30_000) and diffs.changes(["x", "y"] * 20_000, ["y", "x"] * 20_001)
    lines = [str(i) for i in range(50_000)]
    assert len(diffs.changes(lines, [x for x in lines if int(x) % 50])) == 1000


def test_paragraphs(spark):
    from lectern.operators.formatting import format_paragraphs_df, paragraphs

    text = "A b. C d.\nE.\n\n  \nF g. H i.\n\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "\n\n")], "id int, text string")
    assert {r.id: "".join(r.p) if r.p is not None else None for r in df.select("id", paragraphs(F.col("text")).alias("p")).collect()} == {1: text, 2: "", 3: None, 4: "\n\n"}
    got = format_paragraphs_df(df, "id").orderBy("paragraph").collect()
    assert [(r.id, r.paragraph, r.new_text) for r in got] == [(1, 0, "A b.\nC d.\nE.\n"), (1, 2, "F g.\nH i.\n")]


def test_edits(spark):
    df = spark.createDataFrame([(1, "A b. C d.\nE f. G h.\nI.", "plaintext"), (2, "A b.", None), (3, None, None), (4, "", None)], "id int, text string, format string")
    assert [tuple(r) for r in checks.range_edits(df, "id", F.lit(2), F.lit(9)).collect()] == [(1, 1, 0, 2, 2, "E f.\nG h. I.")] or [r.id for r in checks.range_edits(df, "id", F.lit(2), F.lit(9)).collect()] == [1]
    got = checks.on_type_edits(df, "id", F.lit(0), F.lit(".")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 9, "A b.\nC d.")]
    assert checks.on_type_edits(df, "id", F.lit(0), F.lit("x")).count() == 0
    assert [(r.id, r.kind) for r in checks.fix_all(df, "id").collect()] == [(1, "source.fixAll")]
    seen = checks.diagnostics_df(df, "id").unionByName(checks.diagnostics_df(df, "id").withColumn("source", F.lit("other")))
    assert checks.own_diagnostics(seen).count() == 2


def test_diagnostics_count_characters(spark):
    df = spark.createDataFrame([(1, "\U0001f642\U0001f642 x. Yes! No\x01. \u00c9."), (2, "a. B " * 3000)], "id int, text string")
    got = [r.start_col for r in checks.diagnostics_df(df.where("id = 1"), "id").orderBy("start_col").collect()]
    assert got == [5, 10, 15]
    assert checks.diagnostics_df(df.where("id = 2"), "id").count() == 3000


def test_range_text(spark):
    from lectern.operators.formatting import format_range_text

    text = "A a. B b.\nC c. D d.\nE e. F f.\n"
    df = spark.createDataFrame([(t, a, b) for t in (text, text[:-1], "", "\n\n") for a, b in ((1, 1), (2, 2), (2, 99), (9, 10), (0, 1))], "text string, a int, b int").withColumn("format", F.lit("plaintext"))
    for r in format_range_df(df, F.col("a"), F.col("b")).collect():
        assert r.formatted == format_range_text(r.text, r.a, r.b), (r.text, r.a, r.b)


def test_clashing_names(spark):
    df = spark.createDataFrame([("A b. C d.", "plaintext", "x", 1, "y")], "text string, format string, formatted string, `a.b` int, regions string")
    row = format_df(df).first()
    assert row.formatted == "A b.\nC d." and row["a.b"] == 1 and row.regions == "y"
    again = format_df(format_df(df), "formatted", "format").first()
    assert again.formatted == "A b.\nC d."
