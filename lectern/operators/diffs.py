"""Differences between versions of a document: unified text, and sentences added and removed as rows.

The row form needs no order and is a multiset difference in built-in operators.  The unified text compares two ordered
sequences, which is one Arrow pass over pairs that are known to differ.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from lectern.functions import text as tx
from lectern.operators.formatting import with_regions, with_sentences
from lectern.operators.parsers import BLANK, PROSE


#: A line that occurs more often than this on the old side is no anchor.
COMMON = 64
Change = tuple[int, int, int, int]


def changes(a: list[str], b: list[str]) -> list[Change]:
    """Where two lists of lines differ, as ``(from, to)`` on both sides, by anchors on the rarest lines.

    Lines that are alone on both sides are anchors all at once, as far as their order agrees.  Where there are none, of
    the stretches both sides share the one that holds the rarest line (by its occurrences in ``a``) is the anchor, the
    longest among equals.  What is between anchors is compared alike.  Where all shared lines are common, the
    whole stretch is one change, so repeated lines cost no more than others.  Changes are then slid down as far as they
    go where lines repeat.
    """
    found: list[Change] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
        if i == j and k == m:
            continue
        pairs = _unique_pairs(a, b, i, j, k, m) if i < j and k < m else []
        anchor = _anchor(a, b, i, j, k, m) if not pairs and i < j and k < m else None
        if anchor is not None:
            x, y, n = anchor
            todo += [(i, x, k, y), (x + n, j, y + n, m)]
        elif pairs:
            for x, y in [*pairs, (j, m)]:
                todo.append((i, x, k, y))
                i, k = x + 1, y + 1
        else:
            found.append((i, j, k, m))
    return _slid(a, b, sorted(found))


def _unique_pairs(a: list[str], b: list[str], i: int, j: int, k: int, m: int) -> list[tuple[int, int]]:
    """Places of lines that are alone on either side, in the longest order that both sides agree on."""
    alone: list[dict[str, int]] = []
    for side, lo, hi in ((a, i, j), (b, k, m)):
        places: dict[str, int] = {}
        for x in range(lo, hi):
            places[side[x]] = -1 if side[x] in places else x
        alone.append(places)
    pairs = [(x, alone[1][line]) for line, x in alone[0].items() if x >= 0 and alone[1].get(line, -1) >= 0]
    tops: list[int] = []  # smallest end of an order of each length
    chain: list[int] = []
    before = [-1] * len(pairs)
    for n, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before[n] = chain[at - 1] if at else -1
        if at == len(tops):
            tops.append(y)
            chain.append(n)
        else:
            tops[at], chain[at] = y, n
    out, n = [], chain[-1] if chain else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _anchor(a: list[str], b: list[str], i: int, j: int, k: int, m: int) -> tuple[int, int, int] | None:
    places: dict[str, list[int]] = {}
    for x in range(i, j):
        places.setdefault(a[x], []).append(x)
    best, least, y = None, COMMON + 1, k
    while y < m:
        behind = y + 1
        at = places.get(b[y], ())
        if 0 < len(at) <= least:
            for x in at:
                s, t = 0, 1
                while x - s > i and y - s > k and a[x - s - 1] == b[y - s - 1]:
                    s += 1
                while x + t < j and y + t < m and a[x + t] == b[y + t]:
                    t += 1
                rarest = min(len(places[a[z]]) for z in range(x - s, x + t))
                behind = max(behind, y + t)
                if best is None or rarest < least or rarest == least and s + t > best[2]:
                    best, least = (x - s, y - s, s + t), rarest
        y = behind
    return best


def _slid(a: list[str], b: list[str], found: list[Change]) -> list[Change]:
    out: list[Change] = []
    for n, (i, j, k, m) in enumerate(found):
        stop = found[n + 1] if n + 1 < len(found) else (len(a), 0, len(b), 0)
        side, x, y, end = (a, i, j, stop[0]) if k == m else (b, k, m, stop[2])
        if (i == j) != (k == m):
            while y < end and side[x] == side[y]:
                x, y = x + 1, y + 1
            by = x - (i if k == m else k)
            i, j, k, m = i + by, j + by, k + by, m + by
        if out and out[-1][1] == i and out[-1][3] == k:
            i, k = out.pop()[0::2]
        out.append((i, j, k, m))
    return out


def hunks(found: list[Change], context: int) -> Iterator[list[Change]]:
    """Changes with no more than twice the context between them go together."""
    part: list[Change] = []
    for change in found:
        if part and change[0] - part[-1][1] > 2 * context:
            yield part
            part = []
        part.append(change)
    if part:
        yield part


def unified(old: str, new: str, old_name: str, new_name: str, context: int = 3) -> str:
    """A unified diff of two texts by lines; empty if they are equal."""
    a, b = old.split("\n"), new.split("\n")
    tails = []
    for part in (a, b):
        tails.append(part[-1] != "")
        if part[-1] == "":
            part.pop()
    if old == new:
        return ""
    if a == b:  # they differ in the last line end only
        a[-1:], b[-1:] = [a[-1] + ("\0" if tails[0] else "")], [b[-1] + ("\0" if tails[1] else "")]
    out = [f"--- a/{old_name}", f"+++ b/{new_name}"]
    for hunk in hunks(changes(a, b), context):
        i, k = max(hunk[0][0] - context, 0), max(hunk[0][2] - context, 0)
        j, m = min(hunk[-1][1] + context, len(a)), min(hunk[-1][3] + context, len(b))
        spans = [f"{lo + 1 if hi > lo else lo}" + (f",{hi - lo}" if hi - lo != 1 else "") for lo, hi in ((i, j), (k, m))]
        out.append(f"@@ -{spans[0]} +{spans[1]} @@")
        for i1, j1, k1, m1 in hunk:
            out += [" " + x for x in a[i:i1]] + ["-" + x for x in a[i1:j1]] + ["+" + x for x in b[k1:m1]]
            i = j1
        out += [" " + x for x in a[i:j]]
    return "\n".join(out).replace("\0", "") + "\n"


@arrow_udf(StringType())
def unified_diff(old: pa.Array, new: pa.Array, old_name: pa.Array, new_name: pa.Array) -> pa.Array:
    """Null if either text is null, empty if they are equal."""
    rows = zip(*(x.to_pylist() for x in (old, new, old_name, new_name)))
    return pa.array([None if a is None or b is None else unified(a, b, p or "", q or "") for a, b, p, q in rows], pa.string())


def document_sentences(regions: Column, sentences_of: Column) -> Column:
    """A text as a flat list: sentences of prose, structure lines without white space, an empty string for blank lines."""

    def one(r: Column, i: Column) -> Column:
        bare = tx.unicode_trim(r["text"])
        kept = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array(bare))
        return F.when(r["kind"] == PROSE, F.get(sentences_of, i)).when(r["kind"] == BLANK, F.array(F.lit(""))).otherwise(kept)

    return F.flatten(F.transform(regions, one))


def with_document_sentences(df: DataFrame, text: str, format: str, out: str) -> DataFrame:
    """Adds the flat list of a text (line ends as they are, English abbreviations)."""
    read = with_sentences(with_regions(df, text, format, "__r_"), "__r_", None, None, "__s_")
    return tx.computed(read, out, document_sentences(F.col("__r_"), F.col("__s_"))).drop("__r_", "__s_")


def changed_versions(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents of both snapshots whose texts differ: ``(key, old_text, new_text)``; new documents are left out."""
    pairs = old.select(key, F.col(text).alias("old_text")).join(new.select(key, F.col(text).alias("new_text")), key)
    return changed_pairs(pairs)


def changed_pairs(pairs: DataFrame) -> DataFrame:
    """Of rows with ``old_text`` and ``new_text`` those where they differ; null and null do not."""
    return pairs.where(~F.col("old_text").eqNullSafe(F.col("new_text")))


def sentence_changes(pairs: DataFrame, key: str, format: str = "format") -> DataFrame:
    """Sentences that only one version has, as often as it has more of them: ``(key, op, sentence, n)``.

    ``pairs`` has ``key, old_text, new_text`` and a format column.  Both sides are counted in one aggregate.
    """
    both = with_document_sentences(with_document_sentences(pairs, "old_text", format, "__old_"), "new_text", format, "__new_")
    none = F.array().cast("array<string>")
    signed = F.concat(
        F.transform(F.coalesce("__new_", none), lambda s: F.struct(s.alias("sentence"), F.lit(1).alias("n"))),
        F.transform(F.coalesce("__old_", none), lambda s: F.struct(s.alias("sentence"), F.lit(-1).alias("n"))),
    )
    net = both.select(key, F.explode(signed).alias("x")).groupBy(key, F.col("x.sentence").alias("sentence")).agg(F.sum("x.n").alias("n"))
    return net.where("n <> 0").select(key, F.when(F.col("n") > 0, "added").otherwise("removed").alias("op"), "sentence", F.abs("n").alias("n"))


def sentence_diff_df(pairs: DataFrame, key: str, format: str = "format", name: str | None = None, reference: str | None = None) -> DataFrame:
    """``(key, diff)``: the unified diff of both versions' sentences; pairs without a difference are left out.

    ``name`` is a column with the document's path; ``reference`` is put behind the old one's, in parentheses.
    """
    both = with_document_sentences(with_document_sentences(pairs, "old_text", format, "__old_"), "new_text", format, "__new_")
    path = F.coalesce(F.col(name or key).cast("string"), F.lit(""))
    old_name = F.concat(path, F.lit(f" ({reference})")) if reference else path
    joined = [F.array_join(c, "\n") for c in ("__old_", "__new_")]
    changed = both.withColumn("__a_", joined[0]).withColumn("__b_", joined[1]).where("`__a_` <> `__b_`")
    return changed.select(key, unified_diff(F.col("__a_"), F.col("__b_"), old_name, path).alias("diff"))
