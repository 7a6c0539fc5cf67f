"""Reports over checks: JSON, SARIF, text lines and the exit code, each an aggregate or a projection.

A report is one value for all files of a run, so its size grows with the run; reports are made per run, not per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names, messages and the schema are values of the output; fixed values.
RULE = "needs-reformat"
TOOL = "lectern"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


def _in_order(value: Column) -> Column:
    """A group's values by file and counts, nulls first."""
    by = [F.coalesce("file", F.lit("")).alias("a"), F.coalesce("original_lines", F.lit(-1)).alias("b"), F.coalesce("formatted_lines", F.lit(-1)).alias("c")]
    return F.transform(F.array_sort(F.collect_list(F.struct(*by, value.alias("v")))), lambda x: x["v"])


def json_report(checks: DataFrame, by: str) -> DataFrame:
    """``(by, report)``: a JSON array of ``{file, original_lines, formatted_lines}`` in the order of files.

    Null names and counts are null there.
    """
    listed = checks.groupBy(by).agg(_in_order(F.struct("file", "original_lines", "formatted_lines")).alias("results"))
    return listed.select(by, F.to_json("results", {"ignoreNullFields": "false"}).alias("report"))


def sarif_report(checks: DataFrame, by: str, tool: str = TOOL, uri: str = "") -> DataFrame:
    """``(by, report)``: a SARIF 2.1.0 log with one run and a warning for each file."""
    rule = f"{tool}/{RULE}"
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    message = F.concat(F.lit("File needs semantic line break formatting ("), shown("original_lines"), F.lit(" -> "), shown("formatted_lines"), F.lit(" lines)"))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))
    warning = F.struct(
        F.lit(rule).alias("ruleId"), F.lit("warning").alias("level"), F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations")
    )
    about = F.struct(
        F.lit(tool).alias("name"), F.lit(uri).alias("informationUri"),
        F.array(F.struct(F.lit(rule).alias("id"), F.struct(F.lit("File needs semantic line break formatting").alias("text")).alias("shortDescription"))).alias("rules"),
    )
    listed = checks.groupBy(by).agg(_in_order(warning).alias("results"))
    run = F.struct(F.struct(about.alias("driver")).alias("tool"), F.col("results"))
    log = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))
    return listed.select(by, F.to_json(log, {"ignoreNullFields": "false"}).alias("report"))


def text_report(checks: DataFrame) -> DataFrame:
    return checks.select(F.concat(F.lit("would reformat: "), F.col("file")).alias("line"))


def exit_codes(files: DataFrame, by: str, changed: Column) -> DataFrame:
    """``(by, exit_code)``: 1 if any file of a run would change."""
    return files.groupBy(by).agg(F.coalesce(F.max(changed.cast("int")), F.lit(0)).alias("exit_code"))
