"""Functions for SQL sessions and pluggable sentence splitters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lectern
from lectern.functions import text as tx
from lectern.operators.checks import TRIGGERS
from lectern.operators.formatting import format_range_text, format_text, reflowed, with_regions
from lectern.operators.parsers import lines_of
from lectern.operators.sentences import split_text


def version() -> str:
    return lectern.__version__


def detect_format(df: DataFrame, filename: str | None, text: str) -> Column:
    """From a file name where there is one, else from the content."""
    by_content = tx.format_of_content(F.col(text))
    return by_content if filename is None else F.when(F.col(filename).isNotNull(), tx.format_of_path(F.col(filename))).otherwise(by_content)


def register(spark: SparkSession) -> None:
    """SQL functions, vectorised over Arrow batches or built in:

    ``format_text(text, format, width[, extra_abbreviations])``, ``format_range(text, start, end, format, width)``,
    ``split_sentences(text[, extra_abbreviations])``, ``check_formatting(text)`` and ``detect_format(text)``.
    """

    @F.arrow_udf("string")
    def formatted(text: pa.Array, format: pa.Array, width: pa.Array, extras: pa.Array = None) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (text, format, width, pa.nulls(len(text)) if extras is None else extras)))
        return pa.array([format_text(t, f, w or 0, None, words(e)) for t, f, w, e in rows], pa.string())

    @F.arrow_udf("string")
    def range_formatted(text: pa.Array, start: pa.Array, end: pa.Array, format: pa.Array, width: pa.Array) -> pa.Array:
        rows = zip(*(x.to_pylist() for x in (text, start, end, format, width)))
        return pa.array([t if a is None or b is None else format_range_text(t, a, b, f, w or 0) for t, a, b, f, w in rows], pa.string())

    @F.arrow_udf("array<string>")
    def split(text: pa.Array, extras: pa.Array = None) -> pa.Array:
        rows = zip(text.to_pylist(), [None] * len(text) if extras is None else extras.to_pylist())
        return pa.array([None if t is None else split_text(t, None, words(e)) for t, e in rows], pa.list_(pa.string()))

    @F.arrow_udf("array<int>")
    def violations(text: pa.Array) -> pa.Array:
        return pa.array([[i + 1 for i, line in enumerate(lines_of(t or "")) if len(split_text(line)) > 1] for t in text.to_pylist()], pa.list_(pa.int32()))

    for name, f in (("format_text", formatted), ("format_range", range_formatted), ("split_sentences", split), ("formatting_violations", violations)):
        spark.udf.register(name, f)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION check_formatting(body STRING) RETURNS STRUCT<violations: ARRAY<INT>, passed: BOOLEAN>
        RETURN named_struct('violations', formatting_violations(body), 'passed', size(formatting_violations(body)) = 0)"""
    )
    spark.sql(
        r"""CREATE OR REPLACE TEMPORARY FUNCTION detect_format(body STRING) RETURNS STRING RETURN CASE
        WHEN body IS NULL THEN NULL
        WHEN contains(body, '\\begin{') OR contains(body, '\\section{') OR contains(body, '\\documentclass') THEN 'latex'
        WHEN exists(slice(split(body, '\r?\n'), 1, 20), x -> startswith(x, '#+') OR startswith(x, '* '))
          AND (contains(body, ':PROPERTIES:') OR contains(body, ':END:') OR contains(body, '#+begin_')) THEN 'org'
        WHEN exists(slice(split(body, '\r?\n'), 1, 20), x -> startswith(x, '# ') OR startswith(x, '## ')) THEN 'markdown'
        WHEN contains(body, '.. ') OR exists(slice(split(body, '\r?\n'), 1, 20), x -> octet_length(x) > 3 AND x RLIKE '^(=+|-+)$') THEN 'rst'
        ELSE 'plaintext' END"""
    )


def words(abbreviations: list[str | None] | None) -> tuple[str, ...]:
    """Abbreviations without their period; nulls are left out."""
    return tuple(w.strip().rstrip(".") for w in abbreviations or () if w and w.strip())


def capabilities() -> dict[str, object]:
    """What an editor may ask of this engine, and the function that answers."""
    return {
        "formatting": "operators.checks.text_edits", "rangeFormatting": "operators.checks.range_edits", "onTypeFormatting": ("operators.checks.on_type_edits", TRIGGERS),
        "codeAction": ("operators.checks.fix_all", "operators.checks.quick_fixes"), "codeLens": "functions.text.lens_title", "hover": "operators.checks.hover_df",
        "diagnostics": "operators.checks.diagnostics_df", "documents": "streaming.documents.merged_state", "reload": "streaming.documents.republished",
    }


class Splitter(Protocol):
    """A sentence splitter of one's own, such as a model."""

    def split(self, text: str) -> list[str]: ...


def split_with(df: DataFrame, text: str, load: Callable[[], Splitter], out: str = "sentences") -> DataFrame:
    """``df`` with sentences by a splitter that is loaded once per worker task; tokens and abbreviations are its own affair."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = load()
        for batch in batches:
            yield pd.Series([None if t is None else splitter.split(t) for t in batch], dtype=object)

    return df.withColumn(out, run(F.col(text)))


def splitter_for(lang: str | None = None, extras: tuple[str, ...] = (), load: Callable[[], Splitter] | None = None) -> Splitter:
    """The loaded splitter if one is given, else the rules for a language.

    A splitter takes tokens and abbreviations as it will, so the rules' protection of both is not applied to it.
    """
    if load is not None:
        return load()

    class Rules:
        def split(self, text: str) -> list[str]:
            return split_text(text, lang, extras)

    return Rules()


def format_with(df: DataFrame, load: Callable[[], Splitter], text: str = "text", format: str = "format", out: str = "formatted") -> DataFrame:
    """As :func:`lectern.operators.formatting.format_df`, with the sentences of a splitter of one's own."""
    read = with_regions(df, text, format, "__regions_")
    bodies = F.transform("__regions_", lambda r: F.when(r["kind"] == "prose", r["text"]))

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        splitter = load()
        for batch in batches:
            yield pd.Series([None if all_of is None else [[] if t is None else list(splitter.split(t)) for t in all_of] for all_of in batch], dtype=object)

    read = tx.computed(read, "__bodies_", bodies).withColumn("__sentences_", run("__bodies_"))
    joined = reflowed(F.col("__regions_"), F.col("__sentences_"))
    return tx.computed(read, out, tx.restored(F.col(text), joined)).drop("__regions_", "__bodies_", "__sentences_")
