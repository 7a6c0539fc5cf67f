"""Formatting: regions, sentences put one to a line, line-width wrapping, ranges of lines.

Per document everything stays in arrays, so no step shuffles: one Arrow pass reads the regions of markup (those of plain
text are built-in expressions), the sentences are built-in expressions over them, and only groups with a sentence that
may be wider than its width go through a second Arrow pass that wraps them.

Defined results: a null text gives null; an empty text stays empty; a null format is plain text; a null or negative
width is no limit; null lists of abbreviations are empty.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lectern.functions import text as tx
from lectern.operators.parsers import PROSE, STRUCTURE, lines_of, regions_of
from lectern.operators.plain_regions import regions_of_plain
from lectern.operators.sentences import sentences, split_text

REGIONS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType())]))
_REGIONS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


@arrow_udf(REGIONS)
def _read_regions(texts: pa.Array, formats: pa.Array, markers: pa.Array) -> pa.Array:
    out = []
    for text, format, marker in zip(texts.to_pylist(), formats.to_pylist(), markers.to_pylist()):
        out.append(None if text is None else [{"kind": k, "text": t} for k, t in regions_of(text, format, marker)])
    return pa.array(out, _REGIONS)


#: Formats whose regions need the reader; texts of all others are plain.
MARKUP = ("markdown", "org", "latex", "rst")


def regions(text: Column, format: Column, marker: str = tx.MARKER) -> Column:
    """``array<struct<kind, text>>`` of a text of markup whose lines end in LF; null for other formats."""
    return _read_regions(F.when(format.isin(*MARKUP), text), format, F.lit(marker))


@lru_cache(maxsize=65536)
def _columns(c: str) -> int:
    if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Mn", "Me"):
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def display_width(text: str) -> int:
    """Columns of a terminal: wide characters take two, combining and invisible ones none."""
    return len(text) if text.isascii() else sum(map(_columns, text))


def _chunks(text: str, width: int) -> list[tuple[str, str]]:
    """Words with the spaces behind them; a hyphen between letters or digits ends a word, a word too wide is cut."""
    out: list[tuple[str, str]] = []
    i, n = 0, len(text)
    while i < n:
        j = i
        while j < n and text[j] != " ":
            j += 1
            if text[j - 1] == "-" and j - 2 >= i and j < n and text[j - 2].isalnum() and text[j].isalnum():
                break
        k = j
        while k < n and text[k] == " ":
            k += 1
        word, space = text[i:j], text[j:k]
        if display_width(word) > width:
            start = used = 0
            for at, c in enumerate(word):
                w = _columns(c)
                if used + w > width and at > start:
                    out.append((word[start:at], ""))
                    start, used = at, 0
                used += w
            word = word[start:]
        out.append((word, space))
        i = k
    return out


#: Costs of a line in the choice of breaks: each line, a short last line (and when it is one); fixed values.
LINE, SHORT, FRACTION = 1000, 25, 4


def wrapped(text: str, width: int) -> str:
    """``text`` in lines of at most ``width`` columns, the breaks chosen for the least sum of squared gaps."""
    out = []
    for paragraph in text.split("\n"):
        if display_width(paragraph) <= width:
            out.append(paragraph.rstrip(" "))
            continue
        words = _chunks(paragraph, width)
        n = len(words)
        sizes = [(display_width(w), len(s)) for w, s in words]
        best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            length = 0
            for start in range(end - 1, -1, -1):
                length += sizes[start][0] + (sizes[start][1] if start < end - 1 else 0)
                if length > width and start < end - 1:
                    break
                cost = best[start] + LINE
                if length > width:
                    cost += (length - width) * 2500
                elif end < n:
                    cost += (width - length) ** 2
                elif start == end - 1 and length < width / FRACTION:
                    cost += SHORT
                if cost < best[end]:
                    best[end], back[end] = cost, start
        cuts, at = [], n
        while at:
            cuts.append((back[at], at))
            at = back[at]
        out.extend("".join(w + s for w, s in words[a : b - 1]) + words[b - 1][0] for a, b in reversed(cuts))
    return "\n".join(out)


def _may_be_wide(sentence: Column, width: Column) -> Column:
    """Characters take at most two columns, and no more than their bytes."""
    return F.least(2 * F.length(sentence), F.octet_length(sentence)) > width


@arrow_udf(ArrayType(ArrayType(StringType())))
def _wrap_all(groups: pa.Array, widths: pa.Array) -> pa.Array:
    out = []
    for group, width in zip(groups.to_pylist(), widths.to_pylist()):
        if group is None or not width or width <= 0:
            out.append(group)
        else:
            out.append([[wrapped(s, width) for s in one] for one in group])
    return pa.array(out, pa.list_(pa.list_(pa.string())))


@arrow_udf(StringType())
def wrap(texts: pa.Array, widths: pa.Array) -> pa.Array:
    """Each text wrapped at its width."""
    return pa.array([t if t is None or not w or w <= 0 else wrapped(t, w) for t, w in zip(texts.to_pylist(), widths.to_pylist())], pa.string())


def reflowed(regions: Column, sentences_of: Column) -> Column:
    """The text of regions, with the sentences of the i-th prose region (empty arrays elsewhere) one to a line."""

    def one(region: Column, i: Column) -> Column:
        following = F.get(regions, i + 1)
        inline = F.coalesce((following["kind"] == STRUCTURE) & (following["text"] == "\n"), F.lit(False))
        own = F.get(sentences_of, i)
        prose = F.when(F.size(own) == 0, F.lit("")).otherwise(F.concat(F.array_join(own, "\n"), F.when(inline, F.lit("")).otherwise(F.lit("\n"))))
        return F.when(region["kind"] == PROSE, prose).otherwise(region["text"])

    return F.array_join(F.transform(regions, one), "")


def with_regions(df: DataFrame, text: str = "text", format: str | None = "format", out: str = "regions", marker: str = tx.MARKER) -> DataFrame:
    """``df`` with the regions of each text; without a format column all texts are plain, and nothing leaves the JVM."""
    body = tx.unified_newlines(F.col(text))
    plain = regions_of_plain(body, marker)
    if format is None:
        return tx.computed(df, out, plain)
    read = df.withColumn("__markup_", regions(body, F.coalesce(format, F.lit("plaintext")), marker))
    is_markup = F.coalesce(F.col(format).isin(*MARKUP), F.lit(False))
    return tx.computed(read, out, F.when(is_markup, F.col("__markup_")).otherwise(plain)).drop("__markup_")


def with_sentences(df: DataFrame, regions: str = "regions", lang: Column | str | None = None, extras: Column | None = None, out: str = "sentences") -> DataFrame:
    """Adds ``array<array<string>>``: the sentences of each region, none for regions that are not prose."""
    none = F.array().cast("array<string>")
    split = F.transform(regions, lambda r: F.when(r["kind"] == PROSE, sentences(r["text"], lang, extras)).otherwise(none))
    return tx.computed(df, out, split)


def format_df(
    df: DataFrame, text: str = "text", format: str | None = "format", width: Column | int = 0, lang: Column | str | None = None, extras: Column | None = None,
    out: str = "formatted", marker: str = tx.MARKER,
) -> DataFrame:
    """``df`` with a column ``out``: its ``text`` with one sentence to a line, and nothing else changed.

    ``format`` is None where all texts are plain; ``marker`` is the name in markers that switch formatting off and on.
    """
    read = with_regions(df, text, format, "__regions_", marker)
    read = with_sentences(read, "__regions_", lang, extras, "__sentences_")
    if isinstance(width, Column) or width > 0:
        limit = F.lit(width) if isinstance(width, int) else width
        wide = (limit > 0) & F.exists("__sentences_", lambda group: F.exists(group, lambda s: _may_be_wide(s, limit)))
        read = tx.computed(read, "__wide_", wide)
        wrapped_of = _wrap_all(F.when(F.col("__wide_"), F.col("__sentences_")), limit)
        read = read.withColumn("__wrapped_", wrapped_of).withColumn("__sentences_", F.coalesce("__wrapped_", "__sentences_")).drop("__wide_", "__wrapped_")
    joined = reflowed(F.col("__regions_"), F.col("__sentences_"))
    return tx.computed(read, out, tx.let(joined, lambda j: tx.restored(F.col(text), j))).drop("__regions_", "__sentences_")


def paragraphs(text: Column) -> Column:
    """``array<string>`` of a text's paragraphs and of what stands between them, in order; joined they are the text."""
    gap = r"(?:[^\S\n]*+\n)"
    return F.regexp_extract_all(text, F.lit(rf"{gap}++[^\S\n]*+\z|{gap}++|(?:(?!{gap})[^\n]++(?:\n|\z))++"), F.lit(0))


def format_paragraphs_df(
    df: DataFrame, key: str, text: str = "text", width: Column | int = 0, lang: Column | str | None = None, extras: Column | None = None, marker: str = tx.MARKER
) -> DataFrame:
    """``(key, paragraph, old_text, new_text)``: each paragraph formatted by itself as plain text, as in a word processor.

    Gaps between paragraphs have no row; paragraphs are numbered with them, from 0.
    """
    rows = df.select(key, *([] if not isinstance(width, Column) else [width.alias("__w_")]), F.posexplode(paragraphs(tx.unified_newlines(F.col(text)))).alias("paragraph", "old_text"))
    prose = rows.where(~tx.is_blank(F.col("old_text")))
    done = format_df(prose, "old_text", None, F.col("__w_") if isinstance(width, Column) else width, lang, extras, "new_text", marker)
    return done.select(key, "paragraph", "old_text", "new_text")


def format_range_df(
    df: DataFrame, start: Column, end: Column, text: str = "text", format: str = "format", width: Column | int = 0, lang: Column | str | None = None, extras: Column | None = None,
    out: str = "formatted",
) -> DataFrame:
    """As :func:`format_df`, but only lines ``start`` to ``end`` (from 1) are formatted, without regard to the rest.

    The range is clipped to the text; one that starts behind it, or is null, leaves the text as it is.
    """
    all_lines = tx.lines(F.col(text))
    df = df.withColumn("__lines_", all_lines).withColumn("__from_", F.greatest(start, F.lit(1)).cast("int")).withColumn("__to_", F.least(end, F.size("__lines_")).cast("int"))
    size = F.size("__lines_")
    usable = start.isNotNull() & end.isNotNull() & F.coalesce((F.col("__from_") <= size) & (F.col("__from_") <= F.col("__to_")), F.lit(False))
    count = F.greatest(F.col("__to_") - F.col("__from_") + 1, F.lit(0))
    df = df.withColumn("__part_", F.when(usable, F.array_join(F.slice("__lines_", F.greatest("__from_", F.lit(1)), count), "\n")))
    df = format_df(df, "__part_", format, width, lang, extras, "__done_")
    before = F.when(F.col("__from_") > 1, F.concat(F.array_join(F.slice("__lines_", F.lit(1), F.col("__from_") - 1), "\n"), F.lit("\n"))).otherwise(F.lit(""))
    rest = F.slice("__lines_", F.greatest(F.col("__to_") + 1, F.lit(1)), F.greatest(size - F.col("__to_"), F.lit(0)))
    glue = F.when((F.col("__to_") < size) & ~F.col("__done_").endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    whole = F.concat(before, F.col("__done_"), glue, F.array_join(rest, "\n"))
    ended = F.when(
        F.col(text).endswith("\n"), F.when(whole.endswith("\n"), whole).otherwise(F.concat(whole, F.lit("\n")))
    ).otherwise(F.regexp_replace(whole, r"\n+\z", ""))
    return df.withColumn(out, F.when(usable, ended).otherwise(F.col(text))).drop("__lines_", "__from_", "__to_", "__part_", "__done_")


def format_text(
    text: str | None, format: str | None = None, width: int = 0, lang: str | None = None, extras: tuple[str, ...] = (), marker: str = tx.MARKER
) -> str | None:
    """One text, in Python: for registered functions and previews of single lines."""
    if text is None:
        return None
    found = regions_of(text.replace("\r\n", "\n"), format, marker)
    parts = []
    for i, (kind, body) in enumerate(found):
        if kind != PROSE:
            parts.append(body)
        elif own := split_text(body, lang, extras):
            parts.append("\n".join(wrapped(s, width) for s in own) if width and width > 0 else "\n".join(own))
            if found[i + 1 : i + 2] != [(STRUCTURE, "\n")]:
                parts.append("\n")
    out = "".join(parts)
    if text.endswith("\n"):
        out = out if out.endswith("\n") else out + "\n"
    else:
        out = out.rstrip("\n")
    return out.replace("\n", "\r\n") if "\r\n" in text else out


def format_range_text(text: str | None, start: int, end: int, format: str | None = None, width: int = 0, lang: str | None = None, extras: tuple[str, ...] = ()) -> str | None:
    """As :func:`format_range_df`, for one text in Python."""
    if text is None:
        return None
    rows = lines_of(text.replace("\r\n", "\n"))
    first, last = max(start, 1), min(end, len(rows))
    if first > last:
        return text
    done = format_text("\n".join(rows[first - 1 : last]), format, width, lang, extras)
    out = "\n".join([*rows[: first - 1], done, *rows[last:]])
    return out.rstrip("\n") + "\n" if text.endswith("\n") and not out.endswith("\n") else out if text.endswith("\n") else out.rstrip("\n")
