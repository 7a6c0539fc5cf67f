import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx


def one(spark, column, *values, schema="a string"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "line, state",
    [("lectern:off", "off"), ("# lectern:on", "on"), ("  % lectern:off ", "off"), ("<!-- lectern:on -->", "on"), ("#lectern:off", None), ("x lectern:off", None), ("note:off", None), (".. lectern:off", None), (None, None)],
)
def test_pragma(spark, line, state):
    from lectern.operators.parsers import pragma

    assert one(spark, tx.pragma(F.col("a")), line) == state
    if line is not None:
        assert pragma(line) == {None: None, "on": True, "off": False}[state]


@pytest.mark.parametrize("text, n", [("", 0), ("a", 1), ("a\n", 1), ("a\n\n", 2), ("a\r\nb", 2), ("\n", 1)])
def test_lines(spark, text, n):
    from lectern.operators.parsers import lines_of

    got = one(spark, tx.lines(F.col("a")), text)
    assert len(got) == n and got == (lines_of(text) if text else [])


@pytest.mark.parametrize("spec, r", [("1:5", (1, 5)), ("5:1", None), ("0:2", None), ("3", None), ("a:b", None), ("1:2:3", None), ("7:7", (7, 7)), (None, None)])
def test_range(spark, spec, r):
    got = one(spark, tx.line_range(F.col("a")), spec)
    assert (None if got is None else tuple(got)) == r


@pytest.mark.parametrize("path, by_path, by_name", [("a/b.org", "org", "org"), ("org", "plaintext", "org"), (".org", "plaintext", "org"), ("x.TEX", "plaintext", "plaintext"), ("a.b/c.mdx", "markdown", "markdown"), ("n.rest", "rst", "rst")])
def test_formats(spark, path, by_path, by_name):
    assert one(spark, tx.format_of_path(F.col("a")), path) == by_path
    assert one(spark, tx.format_of_name(F.col("a")), path) == by_name


@pytest.mark.parametrize(
    "text, format",
    [("\\begin{x}", "latex"), ("#+TITLE: a\n:END:", "org"), ("#+TITLE: a", "plaintext"), ("a\n# b", "markdown"), ("wait... x", "rst"), ("a\n====", "rst"), ("===", "plaintext"), ("", "plaintext"), ("hello", "plaintext")],
)
def test_content(spark, text, format):
    from lectern.plans import services

    services.register(spark)
    assert one(spark, tx.format_of_content(F.col("a")), text) == format == one(spark, F.expr("detect_format(a)"), text)


@pytest.mark.parametrize(
    "glob, path, hit",
    [("*.bib", "a/b.bib", True), ("**/x*", "a/x1", True), ("**/x*", "x1", True), ("a.c", "abc", False), ("d/?.md", "d/a.md", True), ("[!a]z", "bz", True), ("[", "[", False), ("CHANGELOG*", "p/CHANGELOG.md", True), (None, "a", False)],
)
def test_ignored(spark, glob, path, hit):
    got = spark.createDataFrame([(path, [glob])], "p string, g array<string>").select(tx.is_ignored(F.col("p"), F.col("g")).alias("x")).first()["x"]
    assert got is hit


def test_ignored_from_a_folder(spark):
    df = spark.createDataFrame([("/w/docs/a.md", ["docs/*"]), ("/x/docs/a.md", ["docs/*"]), ("/w/a.md", [None]), ("/w/a.md", None)], "p string, g array<string>")
    got = df.select(tx.is_ignored(F.col("p"), F.col("g"), "/w").alias("x"), tx.is_ignored(F.col("p"), F.col("g")).alias("y"))
    assert [(r.x, r.y) for r in got.collect()] == [(True, False), (False, False), (False, False), (False, False)]
    for mode in tx.MODES:
        row = df.select(tx.is_skipped(F.col("p"), tx.globs_regex(F.col("g")), mode, "/w").alias("x")).first()
        assert row.x is (mode in ("check", "in_place"))


def test_other_marker_names(spark):
    from lectern.operators.parsers import regions_of
    from lectern.operators.plain_regions import plain_regions

    text = "A.\nmine.x:off\nB.\nlectern:on\nmine.x:on\nC."
    expected = [("prose", "A."), *(("structure", x + "\n") for x in ("mine.x:off", "B.", "lectern:on", "mine.x:on")), ("prose", "C.")]
    assert regions_of(text, None, "mine.x") == expected
    got = plain_regions(spark.createDataFrame([(1, text)], "k int, text string"), "k", name="mine.x").orderBy("region_no").collect()
    assert [(r.kind, r.text) for r in got] == expected


def test_precedence(spark):
    rows = [(5, 9, 7, 5), (0, 9, 7, 9), (None, 0, 7, 7), (None, None, None, 0), (-3, None, 7, 7)]
    df = spark.createDataFrame(rows, "a int, b int, c int, x int").select("x", tx.resolved_width(F.col("a"), F.col("b"), F.col("c")).alias("y"))
    assert all(r.x == r.y for r in df.collect())


@pytest.mark.parametrize("text, out, expected", [("a\n", "a", "a\n"), ("a", "a\n\n", "a"), ("a\r\nb", "a\nb\n", "a\r\nb"), ("", "", "")])
def test_restored(spark, text, out, expected):
    assert one(spark, tx.restored(F.col("a"), F.col("b")), text, out, schema="a string, b string") == expected


def test_colours(spark):
    lines = ["--- a/x", "+++ b/x", "@@ -1 +1 @@", "+a", "-a", " a"]
    got = [r.x for r in spark.createDataFrame([(x,) for x in lines], "a string").select(tx.coloured(F.col("a")).alias("x")).collect()]
    assert [g[2:4] if g[0] == "\x1b" else None for g in got] == ["1m", "1m", "36", "32", "31", None]
