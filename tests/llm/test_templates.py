from lectern.llm import templates


def test_templates(spark):
    page = "<table><tr><td>{}</td></tr></table>\n\n{}"
    rows = [(1, i, page.format(f"cell {i}", "**bold** text" if i % 2 else "text")) for i in range(6)]
    rows += [(1, 0, rows[0][2]), (2, 50, "<p>x</p>"), (None, 60, "\\begin{a}\\end{a}"), (None, 61, "\\begin{b}\\end{b}"), (None, 62, "\\begin{c} \\end{c}"), (3, 70, None)]
    rows += [(4, 80 + i, "\\a \\b" if i % 2 else "\\b \\a") for i in range(4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "project_id bigint, call_id bigint, text string, host int")
    got = {(r.host, r.class_no): (r.tokens, r.support) for r in templates.templates(df).collect()}
    assert got[1, 0] == (["<table", "<tr", "<td", "cell", "</td", "</tr", "</table", "text"], 6)
    assert got[-1, 0] == (["\\begin", "\\end"], 3)
    assert {h for h, _ in got} == {1, -1}  # no order in 4, too few pages in 2
    assert templates.templates(df.limit(0)).count() == 0


def test_slots_of_pages(spark):
    rows = [(1, i, f"<table><tr><td>Price {chr(97 + i)}{chr(97 + i)}</td></tr></table> and own words {'x' * (i + 1)}") for i in range(6)] + [(2, 50, "alone"), (None, None, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "project_id bigint, call_id bigint, text string, host int")
    got = {}
    for r in templates.slots(df).orderBy("page", "slot_no").collect():
        got.setdefault(r.page, []).append(r.slot)
    assert got[0] == [">", ">", ">", "aa", ">", ">", ">", "x"] and got[50] == ["alone"] and set(got) == {*range(6), 50}
    assert templates.slots(df.limit(0)).count() == 0


def test_crossing():
    import random

    random.seed(5)
    for _ in range(200):
        spans = [(random.randint(0, 9), random.randint(0, 9), k) for k in range(6)]
        spans = [(min(a, b), max(a, b), k) for a, b, k in spans]
        expected = {k for a, b, k in spans if any(x < a < y < b for x, y, _ in spans)}
        assert templates.crossing(spans) == expected


def test_slots():
    assert templates.slots_of("\\begin{x} body \\end{x}", {"\\begin", "\\end"}) == ["{x} body", "{x}"]
    assert templates.slots_of("", set()) == [] and templates.slots_of("plain", set()) == ["plain"]
