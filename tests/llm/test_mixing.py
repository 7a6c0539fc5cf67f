import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 1), ("void", 0.05, 3)]


@pytest.fixture()
def tables(spark):
    docs = [(i, "a", 10) for i in range(600)] + [(1000 + i, "b", 7) for i in range(150)] + [(2000 + i, "c", 1) for i in range(50)]
    docs += [(3000, None, 5), (3001, "other", 5), (3002, "a", 0)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_short(tables):
    sized, targets = tables
    total = 6000 + 1050 + 50
    has = {"a": 6000, "b": 1050, "c": 50, "void": 0}
    expected = {s for s, share, cap in TARGETS if cap * has[s] < share * total}
    assert {r.source for r in mixing.short_sources(sized, targets).collect()} == expected == {"c", "void"}


def test_mixture(tables):
    sized, targets = tables
    rows = mixing.mixture(sized, targets).collect()
    total = 7100
    positions = [r.position for r in rows]
    assert positions == sorted(positions) and 0 <= min(positions) and max(positions) <= 1
    given, repeats = {}, {}
    for r in rows:
        given[r.source] = given.get(r.source, 0) + r.tokens
        repeats[r.source, r.doc_id] = repeats.get((r.source, r.doc_id), 0) + 1
    assert abs(given["a"] - 0.5 * total) <= 10 and abs(given["b"] - 0.3 * total) <= 7 and given["c"] == 50
    assert all(n <= dict((s, c) for s, _, c in TARGETS)[s] for (s, _), n in repeats.items())
    report = {r.source: r for r in mixing.report(sized, targets).collect()}
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["void"].actual_share == 0
    assert {s: r.given for s, r in report.items()} == {**given, "void": 0} and report["a"].copies == sum(r.source == "a" for r in rows)
    assert report["a"].runs_out_at is None and 0 < report["c"].runs_out_at < 1 and report["void"].runs_out_at == 0
    assert sorted(map(tuple, mixing.mixture(sized, targets, block_rows=7).drop("position").collect()))[:1] and mixing.mixture(sized, targets, block_rows=7).count() == len(rows)


def test_demand_is_inverted(spark):
    df = spark.createDataFrame([(u / 10, 1.0, lean) for u in range(11) for lean in (-0.9, 0.0, 0.7)], "u double, d double, lean double")
    t = mixing.due(F.col("u"), F.col("d"), F.col("lean"), 0.8)
    for r in df.select("*", t.alias("t")).collect():
        a = 0.8 * r.lean
        assert abs(r.t + a * (r.t * r.t - r.t) - r.u) < 1e-9


def test_empty(tables):
    sized, targets = tables
    assert mixing.mixture(sized.limit(0), targets).count() == 0
    assert {r.source for r in mixing.short_sources(sized.limit(0), targets).collect()} == set()
    assert mixing.report(sized, targets.limit(0)).count() == 0
