import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import pieces


def walk(text, width, overlap):
    """Cutting by walking from cut to cut."""
    cp, off = pieces.code_points([text])
    natural, whole = pieces.boundaries(cp, off)
    overlap = min(max(overlap, 0), width - 1)
    at, cuts = 0, [0]
    while at < len(text):
        limit = min((at - overlap if at else 0) + width, len(text))
        least = max(overlap, 1) if at == 0 else at + 1
        if limit == len(text):
            at = limit
        else:
            ok = [x for x in range(least, limit + 1) if natural[x]] or [x for x in range(least, limit + 1) if whole[x]] or [limit]
            at = ok[-1]
        cuts.append(at)
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab c,.-é漢語\u0301\u200d ", max_size=60), st.integers(1, 14), st.integers(-1, 14)), min_size=1, max_size=6))
def test_against_walk(rows):
    got = pieces.cut([t for t, _, _ in rows], np.array([w for _, w, _ in rows]), np.array([o for _, _, o in rows]))
    for (t, w, o), cuts in zip(rows, got):
        assert cuts.tolist() == walk(t, w, o)
        o = min(max(o, 0), w - 1)
        spans = list(zip(cuts[:-1], cuts[1:]))
        parts = [t[a - o if k else a : b] for k, (a, b) in enumerate(spans)]
        assert all(len(p) <= w for p in parts)
        assert all(q.startswith(p[len(p) - o :]) for p, q in zip(parts, parts[1:]))
        assert "".join(p[o:] if k else p for k, p in enumerate(parts)) == t


@settings(max_examples=100, deadline=None)
@given(st.text("ab c,.-é漢語\u0301\u200d ", max_size=400), st.integers(1, 20), st.integers(-1, 20), st.sampled_from([40, 64, 100]))
def test_blocks_change_nothing(text, width, overlap, block):
    assert pieces.cut([text], np.array([width]), np.array([overlap]), block)[0].tolist() == walk(text, width, overlap)


def test_long_line():
    random.seed(1)
    text = "".join(random.choice("abc d") for _ in range(200_000))
    assert pieces.cut([text], np.array([80]), np.array([7]))[0].tolist() == walk(text, 80, 7)


def test_rows(spark):
    config = "project_id bigint, rc_path string, loaded_at timestamp, max_width int, extra_abbreviations array<string>, lang string, " + ", ".join(
        f"{f} struct<extra_abbreviations:array<string>,max_width:int>" for f in ("org", "latex", "markdown", "rst", "plaintext")
    )
    from datetime import datetime

    configs = spark.createDataFrame(
        [(1, "a", datetime(2025, 1, 1), 5, None, None, None, None, None, None, None), (1, "a", datetime(2025, 1, 2), 4, None, None, None, None, (None, 3), None, (None, 0)), (None, "x", None, 1, None, None, None, None, None, None, None)],
        config,
    )
    rows = [(1, 1, "abcdefgh\r\nab", "MD", None, None), (2, 1, "abcdefgh", None, None, 1), (3, 1, "abcdefgh", "org", 0, 9), (4, 9, "abcdefgh", "org", 2, None), (5, None, "abcdefgh", "org", -1, 0), (6, 1, None, "org", 2, 0), (4, 9, "abcdefgh", "org", 2, None), (7, 1, "", "org", 1, 1)]
    calls = spark.createDataFrame([(*r, "extra") for r in rows], "call_id bigint, project_id bigint, text string, format string, max_width int, piece_overlap int, width string")
    got = pieces.pieces(calls, configs).distinct().orderBy("call_id", "line_no", "piece_no").collect()
    assert [(r.call_id, r.piece) for r in got] == [(1, "abc"), (1, "def"), (1, "gh"), (3, "abcd"), (3, "bcde"), (3, "cdef"), (3, "defg"), (3, "efgh"), (4, "ab"), (4, "cd"), (4, "ef"), (4, "gh")]
    assert sorted(tuple(r) for r in pieces.oversized_lines(calls, configs).collect()) == [(1, 1), (3, 1), (4, 1)]
    assert pieces.pieces(calls.limit(0), configs).count() == 0
