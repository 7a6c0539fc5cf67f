"""Checks and diagnostics: whole texts, lines of several sentences, sentence ends inside lines, prose rules.

The four definitions of a violation differ on purpose and stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators.formatting import format_df
from lectern.operators.sentences import sentences


def check_df(df: DataFrame, key: str, text: str = "text", format: str = "format", **options) -> DataFrame:
    """A row for each text that formatting would change: ``(key, original_lines, formatted_lines)``."""
    done = format_df(df, text, format, out="formatted", **options)
    counts = [F.size(tx.lines(F.col(c))).alias(n) for c, n in ((text, "original_lines"), ("formatted", "formatted_lines"))]
    return done.where(F.col("formatted") != F.col(text)).select(key, *counts)


def violations(text: Column, lang: Column | str | None = None, extras: Column | None = None) -> Column:
    """Numbers of the lines (from 1) that hold more than one sentence, whatever the format."""
    marked = F.transform(tx.lines(text), lambda line, i: F.when(F.size(sentences(line, lang, extras)) > 1, i + 1))
    return F.filter(marked, lambda n: n.isNotNull())


def diagnostics_df(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A row for each sentence end inside a line: ``(key, line, start_col, end_col, severity, source, message)``.

    That is a space after one of ``.!?`` and before a capital letter; lines and columns count from 0, in characters.
    """
    numbered = df.where(F.col(text).isNotNull()).select(key, F.posexplode(tx.lines(F.col(text))).alias("line", "body"))
    # Ends become a character of their own, and its places are counted over the characters: linear in the line.
    marked = F.regexp_replace(F.translate("body", "\x01", "\x02"), r"(?<=[.!?]) (?=\p{Lu})", "\x01")
    at = numbered.where(F.col("body").rlike(r"[.!?] \p{Lu}")).select(key, "line", F.posexplode(F.split(marked, "")).alias("start_col", "c"))
    found = at.where(F.col("c") == "\x01").select(key, "line", "start_col")
    return found.select(
        key, "line", "start_col", (F.col("start_col") + 1).alias("end_col"), F.lit("hint").alias("severity"), F.lit("lectern").alias("source"),
        F.lit("Sentence boundary inside a line").alias("message"),
    )


def prose_rules(line: Column) -> Column:
    """``struct(several_sentences, long_line)`` of a line of prose."""
    return F.struct(line.rlike(r"[.!?]\s+[A-Z]").alias("several_sentences"), line.rlike(r".{120,}").alias("long_line"))


def quick_fixes(df: DataFrame, key: str, text: str = "text", format: str = "format", **options) -> DataFrame:
    """The edits that fix each line with a diagnostic, where formatting the line changes it.

    ``(key, start_line, start_col, end_line, end_col, new_text)``.
    """
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(format).alias("format"), F.posexplode(tx.lines(F.col(text))).alias("line", "body"))
    done = format_df(rows.where(F.col("body").rlike(r"[.!?] \p{Lu}")), "body", "format", out="new_text", **options)
    changed = done.where(F.col("new_text") != F.col("body"))
    return changed.select(key, F.col("line").alias("start_line"), F.lit(0).alias("start_col"), F.col("line").alias("end_line"), F.length("body").alias("end_col"), "new_text")


def text_edits(df: DataFrame, key: str, text: str = "text", format: str = "format", **options) -> DataFrame:
    """One edit of the whole text for each text that changes."""
    done = format_df(df, text, format, out="new_text", **options).where(F.col("new_text") != F.col(text))
    all_lines = tx.lines(F.col(text))
    last = F.element_at(all_lines, -1)
    return done.select(key, F.lit(0).alias("start_line"), F.lit(0).alias("start_col"), (F.size(all_lines) - 1).alias("end_line"), F.length(last).alias("end_col"), "new_text")


def fix_all(df: DataFrame, key: str, text: str = "text", format: str = "format", **options) -> DataFrame:
    """The action that fixes a whole document: one for each text that changes, as an edit with its kind and title."""
    edits = text_edits(df, key, text, format, **options)
    return edits.select(key, F.lit("source.fixAll").alias("kind"), F.lit("Format semantic line breaks").alias("title"), *edits.columns[1:])


def own_diagnostics(diagnostics: DataFrame, source: str = "lectern") -> DataFrame:
    """Those of several tools' diagnostics that are this one's; a null source is none."""
    return diagnostics.where(F.col("source") == source)


def range_edits(df: DataFrame, key: str, start: Column, end: Column, text: str = "text", format: str = "format", **options) -> DataFrame:
    """The edit that formats lines ``start`` to ``end`` (from 1, clipped to the text) by themselves, where they change.

    ``(key, start_line, start_col, end_line, end_col, new_text)``; an empty text has none.
    """
    all_lines = tx.lines(F.col(text))
    rows = df.where(F.col(text).isNotNull() & (F.size(all_lines) > 0)).withColumn("__l_", all_lines)
    rows = rows.withColumn("__a_", F.greatest(start, F.lit(1)).cast("int")).withColumn("__b_", F.least(end, F.size("__l_")).cast("int")).where("__a_ <= __b_")
    rows = rows.withColumn("__part_", F.slice("__l_", F.col("__a_"), F.col("__b_") - F.col("__a_") + 1))
    done = format_df(rows.withColumn("__old_", F.array_join("__part_", "\n")), "__old_", format, out="new_text", **options)
    changed = done.where(F.col("new_text") != F.col("__old_"))
    return changed.select(key, (F.col("__a_") - 1).alias("start_line"), F.lit(0).alias("start_col"), (F.col("__b_") - 1).alias("end_line"), F.length(F.element_at("__part_", -1)).alias("end_col"), "new_text")


#: What is typed that makes an editor format the line.
TRIGGERS = (".", " ", "?", "!", "\n")


def on_type_edits(df: DataFrame, key: str, line: Column, typed: Column, text: str = "text", format: str = "format", **options) -> DataFrame:
    """The edit of the line (from 0) in which one of :data:`TRIGGERS` was typed, where formatting changes it."""
    return range_edits(df.where(typed.isin(*TRIGGERS)), key, line + 1, line + 1, text, format, **options)


def hover_df(df: DataFrame, key: str, text: str = "text", format: str = "format", **options) -> DataFrame:
    """Previews of lines that would become several: ``(key, line, preview)``."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(format).alias("format"), F.posexplode(tx.lines(F.col(text))).alias("line", "body"))
    done = format_df(rows, "body", "format", out="preview", **options)
    return done.where((F.col("preview") != F.col("body")) & (F.size(tx.lines(F.col("preview"))) > 1)).select(key, "line", "preview")
