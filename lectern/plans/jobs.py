"""Whole runs over files: check, diff, print, write, as a command or a step of continuous integration would."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import reports
from lectern.operators.diffs import unified_diff
from lectern.operators.formatting import format_df
from lectern.plans.config import ProjectConfig, editor_widths
from lectern.sources import files


@dataclass(frozen=True)
class Run:
    """What a run gave: its exit code, and what it printed."""

    exit_code: int
    output: str


def formatted(spark: SparkSession, paths: Sequence[str], config: ProjectConfig, mode: str, format: str | None = None, width: int = 0, folder: str | None = None) -> DataFrame:
    """``(path, ordinal, text, formatted)`` of the files that a run in this mode looks at, in the order they were listed."""
    found = files.read_documents(spark, list(paths)).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    ordered = files.in_order(found, paths)
    kept = ordered.where(~tx.is_skipped(F.col("path"), tx.globs_regex(F.lit(list(config.ignore)) if config.ignore else F.lit(None).cast("array<string>")), mode, folder))
    typed = kept.withColumn("format", tx.resolved_format(F.lit(format).cast("string"), F.col("path"), F.lit(config.format).cast("string")))
    typed = typed.join(F.broadcast(editor_widths(spark, paths)), "path", "left")  # as many rows as the caller listed
    limit = tx.resolved_width(F.lit(width), config.width_column(F.col("format")), F.col("editor_width"))
    done = format_df(typed, "text", "format", limit, config.lang, config.abbreviations_column(F.col("format")))
    return done.select("path", "ordinal", "text", "formatted")


def run(
    spark: SparkSession, paths: Sequence[str], config: ProjectConfig, mode: str = "print", report: str = "text", target: str | None = None,
    write: Callable[[str], object] | None = None, **options,
) -> Run:
    """One run over files in a mode of :data:`lectern.functions.text.MODES`; reports are ``text``, ``json`` or ``sarif``.

    A check or a diff fails (1) if any file would change.  Only changed files' names, counts and diffs reach the driver.
    """
    done = formatted(spark, paths, config, mode, **options)
    if mode == "print":
        files.print_in_order(done, write=write)
        return Run(0, "")
    if mode == "output":
        files.write_output(done, target)
        return Run(0, "")
    if mode == "in_place":
        files.write_back(done)
        return Run(0, "")
    changed = done.where(F.col("formatted") != F.col("text")).withColumn("run", F.lit(1))
    if mode == "diff":
        rows = changed.select("ordinal", unified_diff(F.col("text"), F.col("formatted"), F.col("path"), F.col("path")).alias("d")).orderBy("ordinal").collect()
        return Run(int(bool(rows)), "".join(r["d"] for r in rows))
    counts = changed.select("run", "ordinal", F.col("path").alias("file"), F.size(tx.lines(F.col("text"))).alias("original_lines"), F.size(tx.lines(F.col("formatted"))).alias("formatted_lines"))
    if report == "text":
        lines = [r["line"] for r in reports.text_report(counts.orderBy("ordinal")).collect()]
        return Run(int(bool(lines)), "".join(x + "\n" for x in lines))
    made = {"json": reports.json_report, "sarif": reports.sarif_report}[report](counts, "run").first()
    return Run(int(made is not None), "" if made is None else made["report"])


def integration_check(spark: SparkSession, patterns: Sequence[str], config: ProjectConfig, upload: Callable[[str], object]) -> int:
    """A step of continuous integration: files by glob, checked, the SARIF report handed on; its exit code."""
    paths = sorted(r["path"] for r in files.listed(spark, list(patterns)).select(F.regexp_replace("path", "^file:/+", "/").alias("path")).collect())
    got = run(spark, paths, config, "check", "sarif")
    if got.output:
        upload(got.output)
    return got.exit_code
