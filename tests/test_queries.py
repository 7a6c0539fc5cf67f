import pytest

from lectern.plans import registry
from tests.oracle import database, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    same(QUERIES[name](spark, data), database(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_wrapped_texts(spark, data):
    """Wrapping only turns spaces into line ends, and no line that could be cut is wider than asked for."""
    from lectern.operators.formatting import display_width

    whole = {r.call_id: r.formatted for r in QUERIES["format_unwrapped"](spark, data).collect()}
    widths = {r.call_id: r.width for r in QUERIES["call_settings"](spark, data).collect()}
    wrapped = 0
    for r in QUERIES["format_calls"](spark, data).collect():
        if r.formatted is None:
            assert whole[r.call_id] is None
            continue
        squeeze = lambda t: "".join(t.split())
        assert squeeze(r.formatted) == squeeze(whole[r.call_id])
        if widths[r.call_id] == 0:
            assert r.formatted == whole[r.call_id]
        elif r.formatted != whole[r.call_id]:
            wrapped += 1
            new = set(r.formatted.splitlines()) - set(whole[r.call_id].splitlines())
            assert all(display_width(x) <= max(widths[r.call_id], 2) for x in new)
    assert wrapped


@pytest.mark.parametrize("name", ["check_diffs", "sentence_diffs"])
def test_diffs_apply(spark, data, name):
    """Counts in hunk headers are those of the lines that follow."""
    import re

    for r in QUERIES[name](spark, data).collect():
        left = None
        for line in r.diff.split("\n")[2:-1]:
            if m := re.match(r"@@ -\d+(?:,(\d+))? \+\d+(?:,(\d+))? @@$", line):
                assert left in (None, [0, 0])
                left = [int(m[1] or 1), int(m[2] or 1)]
            else:
                left[0] -= line[:1] in " -"
                left[1] -= line[:1] in " +"
        assert left == [0, 0]


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
