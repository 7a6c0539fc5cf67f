"""The queries of the training-data operators, each over its whole tables, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import language, lookalike, markup, mixing, pieces, reading, sentences, templates, tokens
from lectern.runtime import checkpointed, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.starts(table(spark, d, "split_requests"), table(spark, d, "project_configs"))


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    units = sentences.sentence_units(table(spark, d, "split_requests"), table(spark, d, "project_configs"))
    return units.select("call_id", "unit_no", "start_pos", "end_pos", "sentence").distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.residue(table(spark, d, "format_requests"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_texts(table(spark, d, "format_requests")).distinct()


def p2_templates(spark: SparkSession, d: str) -> DataFrame:
    """The method named for the problem: templates of each project's texts."""
    return templates.templates(table(spark, d, "format_requests"))


def p2_slots(spark: SparkSession, d: str) -> DataFrame:
    """What each text has of its own beside its project's template."""
    return templates.slots(table(spark, d, "format_requests"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return language.undeclared(table(spark, d, "format_requests"), table(spark, d, "project_configs"))


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    found = language.segments(table(spark, d, "format_requests"))
    return found.select("call_id", "paragraph", "segment", "lang", "size", F.round("confidence", 4).alias("confidence")).distinct()


def p3_documents(spark: SparkSession, d: str) -> DataFrame:
    """The language of each text."""
    return language.documents(table(spark, d, "format_requests"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.oversized_lines(table(spark, d, "format_requests"), table(spark, d, "project_configs"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "format_requests"), table(spark, d, "project_configs")).distinct()


def _all_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "format_requests").select("call_id", "text").unionByName(table(spark, d, "check_requests").select("call_id", "text"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_pairs(_all_texts(spark, d))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """The calls that look alike, by class instead of by pair."""
    return lookalike.lookalike_classes(_all_texts(spark, d))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_form(_all_texts(spark, d)).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that decode to themselves: every document, null as empty."""
    docs = table(spark, d, "documents")
    back = tokens.decode(tokens.encode(docs))
    same = F.xxhash64(F.coalesce(docs.text, F.lit(""))).alias("h")
    return back.select("doc_id", F.xxhash64("text").alias("g")).join(docs.select("doc_id", same), "doc_id").select("doc_id", (F.col("g") == F.col("h")).alias("same"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Sources and sizes of all documents: three numbers each, read for the totals, the blocks and the places."""
    return checkpointed(tokens.sizes(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.short_sources(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sized(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.most_demanding(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return levels.select("doc_id", "words", F.round("grade", 4).alias("grade"), "level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_units, p2_found, p2_clean, p2_templates, p2_slots, p3_found, p3_segments, p3_documents, p4_found, p4_pieces,
        p5_found, p5_classes, p5_forms,
        p6_ids, p6_round_trip, p7_found, p7_report, p7_mixture, p8_found, p8_levels,
    )
    return {f.__name__: f for f in found}


_WIDTHS = """
WITH latest AS (
  SELECT project_id, arg_max(struct_pack(w := max_width, o := org.max_width, l := latex.max_width, m := markdown.max_width,
    r := rst.max_width, p := plaintext.max_width), (loaded_at, rc_path)) AS c
  FROM project_configs WHERE project_id IS NOT NULL GROUP BY project_id),
calls AS (
  SELECT DISTINCT f.call_id, f.text,
    CASE WHEN f.max_width > 0 THEN f.max_width ELSE coalesce(CASE lower(coalesce(f.format, 'plaintext'))
      WHEN 'plaintext' THEN c.p WHEN 'txt' THEN c.p WHEN 'markdown' THEN c.m WHEN 'md' THEN c.m WHEN 'mkd' THEN c.m WHEN 'org' THEN c.o
      WHEN 'latex' THEN c.l WHEN 'tex' THEN c.l WHEN 'rst' THEN c.r WHEN 'rest' THEN c.r END, c.w, 0) END AS width
  FROM format_requests f LEFT JOIN latest USING (project_id) WHERE f.text IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _WIDTHS
        + """, lines AS (SELECT call_id, width, unnest(list_zip(range(1, len(l) + 1), l)) AS x
  FROM (SELECT call_id, width, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM calls))
SELECT DISTINCT call_id, CAST(x[1] AS BIGINT) AS line_no FROM lines WHERE width > 0 AND length(x[2]) > width""",
        "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    }
