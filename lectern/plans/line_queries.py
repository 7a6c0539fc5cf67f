"""Queries on single lines, line ends, formats and snapshots; see :mod:`lectern.plans.registry`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.abbreviations import DOTTED, WORDS, tail_pattern
from lectern.plans import config
from lectern.plans.oracles import LINES
from lectern.plans.registry import EXT, EXT_CASE, LATEST, oracle_sql, query, texts_of
from lectern.runtime import table
from lectern.sources import files

_WHITE = " || ".join(f"chr({ord(c)})" for c in tx.WHITE)
_KEPT = "|".join(map(re.escape, tx.KEPT_ENVIRONMENTS))
_ROWS = f"""WITH l AS (SELECT call_id, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT call_id, {LINES.format("text")} AS a
  FROM (SELECT DISTINCT call_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM format_requests WHERE text IS NOT NULL AND text <> ''))),
n AS (SELECT call_id, CAST(x[1] AS INT) AS line, x[2] AS body, trim(x[2], {_WHITE}) AS bare, ltrim(x[2], {_WHITE}) AS s FROM l)
"""


@query(
    _ROWS
    + r"""SELECT call_id, line, starts_with(upper(s), '#+BEGIN_') AS org_block_begin, starts_with(upper(s), '#+END_') AS org_block_end,
      starts_with(bare, ':') AND ends_with(bare, ':') AND strlen(bare) > 2 AS org_drawer,
      starts_with(s, '#+') AND NOT starts_with(upper(s), '#+BEGIN_') AND NOT starts_with(upper(s), '#+END_') AS org_keyword,
      starts_with(s, '#') AND NOT starts_with(s, '#+') AS org_comment, starts_with(s, '|') AS org_table, regexp_matches(body, '^\*+[ \t]') AS org_headline,
      starts_with(s, '%') AS latex_comment,
      regexp_matches(body, '\\begin\{(?:""" + _KEPT + r""")\}') AS latex_kept, regexp_matches(body, '\\end\{(?:""" + _KEPT + r""")\}') AS latex_kept_end,
      regexp_matches(body, '\\\][ \t]*$') AS latex_display_close, upper(bare) = ':END:' AS org_drawer_end, regexp_matches(body, '^[ \t]*\\begin\{[^}]+\}') AS org_latex_begin,
      regexp_matches(body, '^[ \t]*\\end\{[^}]+\}') AS org_latex_end, bare = '\[' AS org_display_open, starts_with(bare, '@@') AND regexp_matches(body, '@@[a-zA-Z]+:[^@]*@@') AS org_snippet,
      starts_with(s, '\[') AS latex_display_open, regexp_matches(body, '^#{1,6}[ \t]') AS markdown_heading, regexp_matches(s, '^(?:`{3}|~{3})') AS markdown_fence,
      regexp_matches(body, '^[ \t]*(?:[-*+]|[0-9]+[.)]) ') AS markdown_item, starts_with(bare, '|') AND ends_with(bare, '|') AND strlen(bare) > 1 AS markdown_table,
      regexp_full_match(bare, '==+|--+|~~+|\^\^+|""+|##+|\*\*+|\+\++') AS rst_underline, starts_with(s, '.. ') AND contains(s, '::') AS rst_directive
    FROM n"""
)
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """What each line would be in each markup format, looked at alone."""
    rows = texts_of(spark, d, "format_requests").select("call_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "body"))
    return rows.select("call_id", "line", *[c.alias(n) for n, c in tx.line_predicates(F.col("body")).items()]).distinct()


def _tail_sql(lang: str) -> str:
    words, dotted = "|".join(WORDS[lang]), "|".join(x.replace(".", "[.]") for x in DOTTED[lang])
    space = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
    return rf"""regexp_matches(right(rtrim(body, {_WHITE}), 32), '(?:(?:^|{space}|["''`(\[])(?:{words})|(?:^|{space})(?:{dotted}))[.]$')"""


@query(f"{_ROWS} SELECT call_id, line, {_tail_sql('en')} AS english, {_tail_sql('de')} AS german FROM n WHERE ends_with(rtrim(body, {_WHITE}), '.')")
def abbreviation_ends(spark: SparkSession, d: str) -> DataFrame:
    """Lines that end in a period, and whether in an English or German abbreviation."""
    rows = texts_of(spark, d, "format_requests").select("call_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "body"))
    end = F.rtrim(F.col("body"), F.lit(tx.WHITE))
    is_short = lambda lang: F.right(end, F.lit(32)).rlike(tail_pattern(lang))
    return rows.where(end.endswith(".")).select("call_id", "line", is_short("en").alias("english"), is_short("de").alias("german")).distinct()


@query(
    r"""SELECT call_id, md5(CASE WHEN contains(text, chr(13) || chr(10)) THEN replace(e, chr(10), chr(13) || chr(10)) ELSE e END) AS digest FROM (
      SELECT call_id, text, CASE WHEN ends_with(text, chr(10)) THEN t || chr(10) || chr(10) ELSE regexp_replace(t || chr(10) || chr(10), '\n+\z', '') END AS e
      FROM (SELECT DISTINCT call_id, text, replace(text, chr(13) || chr(10), chr(10)) AS t FROM format_requests WHERE text IS NOT NULL))"""
)
def restored_line_ends(spark: SparkSession, d: str) -> DataFrame:
    """Line ends of the input put back on an output that has two more."""
    longer = F.concat(tx.unified_newlines(F.col("text")), F.lit("\n\n"))
    return texts_of(spark, d, "format_requests").select("call_id", F.md5(tx.restored(F.col("text"), longer)).alias("digest")).distinct()


@query(
    f"""WITH {LATEST}, r AS (SELECT *, {EXT_CASE.format(EXT)} AS f FROM check_reports WHERE file IS NOT NULL AND run_id IS NOT NULL)
    SELECT DISTINCT report_id, CASE WHEN run_id[5:5] = '0' THEN 'org' ELSE f END AS by_document, coalesce(nullif(f, 'plaintext'), p.default_format, 'plaintext') AS resolved
    FROM r LEFT JOIN latest USING (project_id)"""
)
def resolved_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats by an editor's language id before the path, and by path before the project's default."""
    seen = table(spark, d, "check_reports").where(F.col("file").isNotNull() & F.col("run_id").isNotNull()).select("report_id", "run_id", "file", "project_id").distinct()
    known = config.with_project(seen, table(spark, d, "project_configs"))
    language_id = F.when(F.substring("run_id", 5, 1) == "0", "org")
    return known.select(
        "report_id", tx.format_of_document(language_id, F.col("file")).alias("by_document"),
        tx.resolved_format(F.lit(None).cast("string"), F.col("file"), F.col("project.default_format")).alias("resolved"),
    ).distinct()


@query(
    f"""WITH l AS (SELECT doc_id, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT doc_id, {LINES.format("replace(text, chr(13) || chr(10), chr(10))")} AS a FROM documents WHERE text <> ''))
    SELECT doc_id, CAST(x[1] AS INT) AS line, CASE WHEN x[2] LIKE '--- %' OR x[2] LIKE '+++ %' THEN 'bold' WHEN x[2] LIKE '@@%' THEN 'cyan' WHEN x[2] LIKE '+%' THEN 'green' ELSE 'red' END AS colour,
      CAST(length(x[2]) + CASE WHEN x[2] LIKE '--- %' OR x[2] LIKE '+++ %' THEN 8 ELSE 9 END AS INT) AS size
    FROM l WHERE regexp_matches(x[2], '^(?:@@|[-+])')"""
)
def diff_colours(spark: SparkSession, d: str) -> DataFrame:
    """The colours of all lines of diffs in the corpus, and their lengths with them."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "body"))
    painted = rows.select("doc_id", "line", "body", tx.coloured(F.col("body")).alias("shown")).where(F.col("shown") != F.col("body"))
    code = F.regexp_extract("shown", r"\A\x1b\[(\d+)m", 1)
    colour = F.when(code == "1", "bold").when(code == "36", "cyan").when(code == "32", "green").when(code == "31", "red")
    return painted.select("doc_id", "line", colour.alias("colour"), F.length("shown").alias("size"))


@query(
    """WITH old AS (SELECT CAST(project_id AS VARCHAR) AS path, arg_min(lang, (loaded_at, rc_path)) AS t FROM project_configs WHERE project_id IS NOT NULL AND lang IS NOT NULL GROUP BY 1),
    new AS (SELECT path, t FROM (SELECT CAST(project_id AS VARCHAR) AS path, arg_max(coalesce(lang, '-'), (loaded_at, rc_path)) AS t FROM project_configs WHERE project_id IS NOT NULL GROUP BY 1) WHERE t <> '-')
    SELECT coalesce(old.path, new.path) AS path FROM old FULL JOIN new ON old.path = new.path WHERE old.t IS DISTINCT FROM new.t"""
)
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """Paths that changed, appeared or went between two snapshots: the language each project had first, and has now."""
    rows = table(spark, d, "project_configs").where(F.col("project_id").isNotNull())
    rows = rows.select(F.col("project_id").cast("string").alias("path"), "lang", F.struct("loaded_at", "rc_path").alias("at"))
    old = rows.where("lang IS NOT NULL").groupBy("path").agg(F.min_by("lang", "at").alias("text"))
    new = rows.groupBy("path").agg(F.max_by(F.coalesce("lang", F.lit("-")), "at").alias("text")).where("text <> '-'")
    return files.changed_paths(old, new)


@query(
    """WITH a AS (SELECT rc_path AS path, min(loaded_at) AS t, count(*) AS n FROM project_configs WHERE rc_path IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1),
    b AS (SELECT rc_path AS path, max(loaded_at) AS t FROM project_configs WHERE rc_path IS NOT NULL AND loaded_at IS NOT NULL AND lang IS NOT NULL GROUP BY 1)
    SELECT path, CASE WHEN b.t IS NULL THEN 'remove' ELSE 'modify' END AS kind, coalesce(b.t, a.t) AS modified FROM a LEFT JOIN b USING (path) WHERE a.t IS DISTINCT FROM b.t"""
)
def file_events(spark: SparkSession, d: str) -> DataFrame:
    """What happened to configuration files between their first load and their last one with a language."""
    loads = table(spark, d, "project_configs").where("rc_path IS NOT NULL AND loaded_at IS NOT NULL")
    before = loads.groupBy(F.col("rc_path").alias("path")).agg(F.min("loaded_at").alias("modified")).withColumn("length", F.lit(1))
    now = loads.where("lang IS NOT NULL").groupBy(F.col("rc_path").alias("path")).agg(F.max("loaded_at").alias("modified")).withColumn("length", F.lit(1))
    return files.file_events(before, now)


@query(
    """WITH a AS (SELECT rc_path AS path, min(loaded_at) AS t FROM project_configs WHERE rc_path IS NOT NULL AND loaded_at IS NOT NULL GROUP BY 1),
    b AS (SELECT rc_path AS path, max(loaded_at) AS t FROM project_configs WHERE rc_path IS NOT NULL AND loaded_at IS NOT NULL AND lang IS NOT NULL GROUP BY 1)
    SELECT path FROM a JOIN b USING (path) WHERE a.t <> b.t AND path IN (SELECT rc_path FROM project_configs WHERE max_width > 0)"""
)
def watched_changes(spark: SparkSession, d: str) -> DataFrame:
    """Of those events the ones that make a listed file be formatted; listed are the files that set a width."""
    listed = table(spark, d, "project_configs").where("max_width > 0").select(F.col("rc_path").alias("path"))
    return files.to_format(file_events(spark, d), listed).select("path")


_SKIPPED = """SELECT DISTINCT report_id, file, mode, mode IN ('check', 'in_place') AND ignored AS skipped FROM ({0}) CROSS JOIN (SELECT unnest(['print', 'output', 'in_place', 'check', 'diff']) AS mode)"""


@query(_SKIPPED.format(oracle_sql()["ignored_files"]))
def skipped_files(spark: SparkSession, d: str) -> DataFrame:
    """Which reported files a run leaves out in each of its modes."""
    seen = table(spark, d, "check_reports").where(F.col("file").isNotNull()).select("report_id", "file", "project_id").distinct()
    known = config.with_project(seen, table(spark, d, "project_configs"))
    modes = [F.struct(F.lit(m).alias("mode"), tx.is_skipped(F.col("file"), F.col("project.ignored"), m).alias("skipped")) for m in tx.MODES]
    return known.select("report_id", "file", F.explode(F.array(*modes)).alias("m")).select("report_id", "file", "m.mode", "m.skipped").distinct()
