"""All queries over the reference tables, by name, and the SQL that their results can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import checks, diffs, formatting, plain_regions, reports
from lectern.operators.sentences import TOKENS, sentences
from lectern.plans import config, oracles
from lectern.plans.oracles import LINES
from lectern.runtime import one_each, spread, table
from lectern.sources import files
from lectern.streaming.debounce import debounced

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def calls_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Calls to format, each once. Redelivered rows repeat a call's content, so any row of a call will do."""
    return one_each(table(spark, d, "format_requests").select("call_id", *columns), "call_id")


def texts_of(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """All rows of a table that have a text, over all cores; what is made of them is made distinct, so no text is shuffled."""
    rows = table(spark, d, name).where(F.col("call_id").isNotNull() & F.col("text").isNotNull())
    return spread(rows.select("call_id", "text", *columns))


def typed(df: DataFrame) -> DataFrame:
    return df.withColumn("format", tx.format_of_spelling(F.col("format")))


def _configured(spark: SparkSession, d: str) -> DataFrame:
    """Calls with what holds for them: ``call_id, text, format, width, lang, abbreviations``."""
    calls = table(spark, d, "format_requests").select("call_id", "project_id", "text", "format", "max_width", "extra_abbreviations")
    known = config.with_project(calls, table(spark, d, "project_configs")).withColumn("format", tx.format_of_spelling(F.col("format")))
    lang = F.lower(F.substring("project.lang", 1, 2))
    return known.select("call_id", "text", "format", *config.effective(F.col("format"), F.col("max_width"), F.col("extra_abbreviations")), lang.alias("lang"))


# --- scans, functions ---------------------------------------------------------------------------------------------

@query(
    rf"""SELECT call_id, CAST(CASE WHEN text = '' THEN 0 ELSE len({LINES.format("text")}) END AS INT) AS n_lines
    FROM (SELECT DISTINCT call_id, text FROM format_requests WHERE text IS NOT NULL)"""
)
def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each text."""
    return texts_of(spark, d, "format_requests").select("call_id", F.size(tx.lines(F.col("text"))).alias("n_lines")).distinct()


EXT_CASE = """CASE WHEN {0} = 'org' THEN 'org' WHEN {0} IN ('tex', 'latex', 'ltx', 'sty', 'cls') THEN 'latex'
  WHEN {0} IN ('md', 'markdown', 'mkd', 'mdx') THEN 'markdown' WHEN {0} IN ('rst', 'rest') THEN 'rst' ELSE 'plaintext' END"""
EXT = r"regexp_extract(file, '(?:^|/)[^/]+\.([^./]*)$', 1)"


@query(
    f"""SELECT DISTINCT file, {EXT_CASE.format(EXT)} AS by_path, {EXT_CASE.format("split_part(file, '.', -1)")} AS by_name,
    CASE {EXT} WHEN 'org' THEN 'org' WHEN 'tex' THEN 'latex' WHEN 'latex' THEN 'latex' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown'
      WHEN 'rst' THEN 'rst' WHEN 'rest' THEN 'rst' WHEN 'typ' THEN 'typst' WHEN 'adoc' THEN 'asciidoc' WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html'
      WHEN 'docx' THEN 'docx' WHEN 'txt' THEN 'markdown' END AS reader FROM check_reports WHERE file IS NOT NULL"""
)
def file_formats(spark: SparkSession, d: str) -> DataFrame:
    """Formats by path, by name and for the external converter."""
    paths = table(spark, d, "check_reports").where(F.col("file").isNotNull()).select("file").distinct()
    path = F.col("file")
    return paths.select("file", tx.format_of_path(path).alias("by_path"), tx.format_of_name(path).alias("by_name"), tx.reader_of_path(path).alias("reader"))


@query(
    rf"""WITH t AS (SELECT call_id, text, CASE WHEN text = '' THEN [] ELSE {LINES.format("replace(text, chr(13) || chr(10), chr(10))")}[1:20] END AS first
      FROM (SELECT DISTINCT call_id, text FROM format_requests WHERE text IS NOT NULL))
    SELECT call_id, CASE
      WHEN contains(text, '\begin{{') OR contains(text, '\section{{') OR contains(text, '\documentclass') THEN 'latex'
      WHEN len(list_filter(first, lambda x: x LIKE '#+%' OR x LIKE '* %')) > 0
        AND (contains(text, ':PROPERTIES:') OR contains(text, ':END:') OR contains(text, '#+begin_')) THEN 'org'
      WHEN len(list_filter(first, lambda x: x LIKE '# %' OR x LIKE '## %')) > 0 THEN 'markdown'
      WHEN contains(text, '.. ') OR len(list_filter(first, lambda x: strlen(x) > 3 AND regexp_full_match(x, '=+|-+'))) > 0 THEN 'rst'
      ELSE 'plaintext' END AS guess FROM t"""
)
def content_formats(spark: SparkSession, d: str) -> DataFrame:
    """The format guessed from the content of each text."""
    return texts_of(spark, d, "format_requests").select("call_id", tx.format_of_content(F.col("text")).alias("guess")).distinct()


#: How comments look in each format.
_COMMENTS = {"org": "# {0}", "latex": "% {0}", "markdown": "<!-- {0} -->"}
_FORMAT = """CASE lower(trim(format)) WHEN 'txt' THEN 'plaintext' WHEN 'md' THEN 'markdown' WHEN 'mkd' THEN 'markdown' WHEN 'tex' THEN 'latex'
  WHEN 'rest' THEN 'rst' ELSE coalesce(lower(trim(format)), 'plaintext') END"""


def _marker(format: Column, switch: str) -> Column:
    """A marker in the comments of a format."""
    plain = f"{tx.MARKER}:{switch}"
    out = F.lit(plain)
    for name, comment in _COMMENTS.items():
        out = F.when(format == name, F.lit(comment.format(plain))).otherwise(out)
    return out


def _switched(df: DataFrame) -> DataFrame:
    """Each text with formatting switched off before a copy of it, and on behind that."""
    parts = [F.col("text"), _marker(F.col("format"), "off"), F.col("text"), _marker(F.col("format"), "on"), F.lit("Last. One.")]
    return df.withColumn("text", F.concat_ws("\n", *parts))


def _marker_sql(switch: str) -> str:
    plain = f"{tx.MARKER}:{switch}"
    cases = " ".join(f"WHEN '{name}' THEN '{comment.format(plain)}'" for name, comment in _COMMENTS.items())
    return f"CASE f {cases} ELSE '{plain}' END"


_SWITCHED = f"""src AS (SELECT call_id AS id, f AS format, text || chr(10) || {_marker_sql("off")} || chr(10) || text || chr(10) || {_marker_sql("on")} || chr(10) || 'Last. One.' AS text
  FROM (SELECT DISTINCT call_id, text, {_FORMAT} AS f FROM format_requests WHERE text IS NOT NULL))"""


@query(
    f"""WITH {_SWITCHED}, l AS (SELECT id, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT id, {LINES.format("replace(text, chr(13) || chr(10), chr(10))")} AS a FROM src))
    SELECT id AS call_id, CAST(x[1] AS INT) AS line, regexp_extract(x[2], ':(on|off)', 1) AS state FROM l WHERE regexp_full_match(x[2], '(?:# |% |<!-- )?lectern:(on|off)(?: -->)?')"""
)
def pragma_states(spark: SparkSession, d: str) -> DataFrame:
    """The lines that switch formatting off and on in all texts with markers in their format's comments."""
    calls = _switched(typed(texts_of(spark, d, "format_requests", "format")))
    rows = calls.select("call_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "body"))
    return rows.select("call_id", "line", tx.pragma(F.col("body")).alias("state")).where(F.col("state").isNotNull()).distinct()


@query(
    f"""WITH RECURSIVE {_SWITCHED}, {oracles.regions("src")}
    SELECT id AS call_id, kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS size FROM reg GROUP BY id, kind"""
)
def switched_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions, by kind, of texts of which a part is switched off."""
    read = formatting.with_regions(_switched(typed(texts_of(spark, d, "format_requests", "format").distinct())))
    rows = read.select("call_id", F.explode("regions").alias("r"))
    return rows.groupBy("call_id", F.col("r.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("r.text")).alias("size"))


@query(
    r"""SELECT report_id, CASE WHEN a >= 1 AND b >= 1 AND a <= b THEN a END AS first_line, CASE WHEN a >= 1 AND b >= 1 AND a <= b THEN b END AS last_line
    FROM (SELECT DISTINCT report_id, CAST(original_lines AS BIGINT) AS a, CAST(formatted_lines AS BIGINT) AS b FROM check_reports)"""
)
def line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """``start:end`` read back from text."""
    spec = F.concat_ws(":", "original_lines", "formatted_lines")
    found = table(spark, d, "check_reports").select("report_id", tx.line_range(spec).alias("r")).distinct()
    return found.select("report_id", F.col("r.start").alias("first_line"), F.col("r.end").alias("last_line"))


LATEST = """latest AS (SELECT project_id, arg_max(struct_pack(lang, default_format, max_width, extra_abbreviations, ignore_patterns,
  org, latex, markdown, rst, plaintext), (loaded_at, rc_path)) AS p FROM project_configs WHERE project_id IS NOT NULL GROUP BY project_id)"""
_PER_FORMAT = "CASE f WHEN 'org' THEN p.org.{0} WHEN 'latex' THEN p.latex.{0} WHEN 'markdown' THEN p.markdown.{0} WHEN 'rst' THEN p.rst.{0} WHEN 'plaintext' THEN p.plaintext.{0} END"


@query(
    f"""WITH {LATEST}, calls AS (SELECT DISTINCT call_id, project_id, {_FORMAT} AS f, max_width, extra_abbreviations FROM format_requests)
    SELECT call_id, f AS format,
      CAST(CASE WHEN max_width > 0 THEN max_width WHEN coalesce({_PER_FORMAT.format("max_width")}, p.max_width) > 0
        THEN coalesce({_PER_FORMAT.format("max_width")}, p.max_width) ELSE 0 END AS INT) AS width,
      array_to_string(list_concat(list_concat(coalesce(calls.extra_abbreviations, []), coalesce(p.extra_abbreviations, [])),
        coalesce({_PER_FORMAT.format("extra_abbreviations")}, [])), ',') AS abbreviations
    FROM calls LEFT JOIN latest USING (project_id)"""
)
def call_settings(spark: SparkSession, d: str) -> DataFrame:
    """Format, width and abbreviations that hold for each call."""
    held = _configured(spark, d).select("call_id", "format", "width", F.array_join("abbreviations", ",").alias("abbreviations"))
    return held.distinct()


@query(
    rf"""WITH {LATEST}, g AS (SELECT project_id, list_transform(list_filter(coalesce(p.ignore_patterns, []), lambda x: x IS NOT NULL), lambda x:
      '(?s)^' || replace(replace(regexp_replace(replace(replace(regexp_replace(x, '([.+^$(){{}}|\\])', '\\\1', 'g'), '[!', '[^'), '**/', chr(1)),
      '\*+', '.*', 'g'), '?', '.'), chr(1), '(?:.*/)?') || '$') AS patterns FROM latest)
    SELECT DISTINCT report_id, file, coalesce(len(list_filter(patterns, lambda x: regexp_matches(file, x) OR regexp_matches(split_part(file, '/', -1), x))) > 0, false) AS ignored
    FROM check_reports LEFT JOIN g USING (project_id) WHERE file IS NOT NULL"""
)
def ignored_files(spark: SparkSession, d: str) -> DataFrame:
    """Which reported files their project's globs leave out."""
    seen = table(spark, d, "check_reports").where(F.col("file").isNotNull()).select("report_id", "file", "project_id").distinct()
    known = config.with_project(seen, table(spark, d, "project_configs"))
    return known.select("report_id", "file", tx.matches_globs(F.col("file"), F.col("project.ignored")).alias("ignored"))


_S = r"[^\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0b"
_TOKENS_SQL = "|".join(t.replace(r"\S", _S + "]").replace(r"[^.\s", _S + ".").replace("'", "''") for t in TOKENS)


@query(
    f"""SELECT call_id, CAST(len(t) AS INT) AS n_tokens, array_to_string(t, chr(2)) AS tokens
    FROM (SELECT call_id, regexp_extract_all(text, '{_TOKENS_SQL}') AS t FROM (SELECT DISTINCT call_id, text FROM format_requests WHERE text IS NOT NULL)) WHERE len(t) > 0"""
)
def inline_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Links, formulas, code and the like that sentences are never cut inside."""
    found = texts_of(spark, d, "format_requests").select("call_id", F.regexp_extract_all("text", F.lit("(?U)" + "|".join(TOKENS)), F.lit(0)).alias("t"))
    return found.where(F.size("t") > 0).select("call_id", F.size("t").alias("n_tokens"), F.array_join("t", "\x02").alias("tokens")).distinct()


@query(
    f"""WITH {LATEST}, calls AS (SELECT DISTINCT call_id, project_id, {_FORMAT} AS f, max_width FROM format_requests),
    w AS (SELECT call_id, f, CASE WHEN max_width > 0 THEN max_width WHEN coalesce({_PER_FORMAT.format("max_width")}, p.max_width) > 0 THEN coalesce({_PER_FORMAT.format("max_width")}, p.max_width) ELSE 0 END AS w
      FROM calls LEFT JOIN latest USING (project_id))
    SELECT call_id, 'lectern: ' || upper(f[1]) || f[2:] || ' | width: ' || CASE WHEN w > 0 THEN CAST(w AS VARCHAR) ELSE 'unlimited' END AS title FROM w"""
)
def lens_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles that tell the format and width of each call."""
    return _configured(spark, d).select("call_id", tx.lens_title(F.col("format"), F.col("width")).alias("title")).distinct()


# --- regions, sentences, formatting ----------------------------------------------------------------------------------


_CALLS = f"src AS (SELECT DISTINCT call_id AS id, text, {_FORMAT} AS format, CAST(NULL AS VARCHAR) AS lang, CAST([] AS VARCHAR[]) AS extras FROM format_requests)"
_CHECKS = _CALLS.replace("format_requests", "check_requests")
_PLAIN = "src AS (SELECT DISTINCT call_id AS id, text, 'plaintext' AS format, CAST(NULL AS VARCHAR) AS lang, CAST([] AS VARCHAR[]) AS extras FROM split_requests)"


@query(f"WITH RECURSIVE {_PLAIN}, {oracles.regions('src')} SELECT id AS call_id, region_no, kind, text FROM reg")
def plain_text_regions(spark: SparkSession, d: str) -> DataFrame:
    """Prose, structure and blank regions of plain text, by built-in expressions."""
    return plain_regions.plain_regions(texts_of(spark, d, "split_requests"), "call_id").distinct()


@query(f"WITH RECURSIVE {_CALLS}, {oracles.regions('src')} SELECT id AS call_id, region_no, kind, text FROM reg")
def markup_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of all formats: ``(call_id, region_no, kind, text)``."""
    calls = typed(calls_once(spark, d, "text", "format").where(F.col("text").isNotNull()))
    read = formatting.with_regions(calls).select("call_id", F.posexplode("regions").alias("region_no", "r"))
    return read.select("call_id", "region_no", "r.kind", "r.text")


@query(
    """SELECT kind, CAST(sum(n) AS BIGINT) AS same FROM (SELECT 'calls' AS kind, count(DISTINCT call_id) AS n FROM format_requests WHERE text IS NOT NULL) GROUP BY kind"""
)
def regions_keep_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose regions hold all their letters and digits in order: all of them."""
    calls = typed(texts_of(spark, d, "format_requests", "format").distinct())
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    read = formatting.with_regions(calls).where(bare(F.col("text")) == bare(F.array_join(F.transform("regions", lambda r: r["text"]), "")))
    return read.agg(F.count(F.lit(1)).alias("same")).select(F.lit("calls").alias("kind"), "same")


_WORDS = "list_transform(list_filter(coalesce(extra_abbreviations, []), lambda x: x IS NOT NULL), lambda x: rtrim(trim(x), '.'))"


@query(
    f"""WITH src AS (SELECT DISTINCT call_id AS id, text, CAST(NULL AS VARCHAR) AS lang, {_WORDS} AS extras FROM split_requests), {oracles.sentences("src")}
    SELECT id AS call_id, no AS sentence_no, sentence FROM sent"""
)
def split_calls(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each call's text by the rules, with its declared abbreviations: ``(call_id, sentence_no, sentence)``."""
    words = F.transform(F.filter("extra_abbreviations", lambda x: x.isNotNull()), lambda x: F.rtrim(F.trim(x), F.lit(".")))
    calls = texts_of(spark, d, "split_requests", "extra_abbreviations")
    return calls.select("call_id", F.posexplode(sentences(F.col("text"), "en", words)).alias("sentence_no", "sentence")).distinct()


@query()
def format_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each call's text formatted with what holds for it: ``(call_id, formatted)``."""
    calls = one_each(_configured(spark, d), "call_id")
    done = formatting.format_df(calls, "text", "format", F.col("width"), F.col("lang"), F.col("abbreviations"))
    return done.select("call_id", "formatted")


_CONFIGURED = f"""{LATEST}, src AS (SELECT call_id AS id, text, f AS format, lower(p.lang[1:2]) AS lang,
    list_filter(list_concat(list_concat(coalesce(calls.extra_abbreviations, []), coalesce(p.extra_abbreviations, [])), coalesce({_PER_FORMAT.format("extra_abbreviations")}, [])), lambda x: x IS NOT NULL) AS extras
  FROM (SELECT DISTINCT call_id, project_id, text, extra_abbreviations, {_FORMAT} AS f FROM format_requests) calls LEFT JOIN latest USING (project_id))"""


@query(f"WITH RECURSIVE {_CONFIGURED}, {oracles.formatted('src')} SELECT id AS call_id, formatted FROM form")
def format_unwrapped(spark: SparkSession, d: str) -> DataFrame:
    """As ``format_calls``, without regard to widths."""
    calls = one_each(_configured(spark, d), "call_id")
    return formatting.format_df(calls, "text", "format", 0, F.col("lang"), F.col("abbreviations")).select("call_id", "formatted")


@query(
    f"""WITH RECURSIVE src AS (SELECT doc_id AS id, text, 'plaintext' AS format, lang, CAST([] AS VARCHAR[]) AS extras FROM documents), {oracles.formatted("src")}
    SELECT id AS doc_id, formatted FROM form"""
)
def format_documents(spark: SparkSession, d: str) -> DataFrame:
    """Corpus documents as plain text, one sentence to a line: ``(doc_id, formatted)``; nothing leaves the JVM."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    return formatting.format_df(docs, "text", None, 0, F.col("lang")).select("doc_id", "formatted")


_PART = """parts AS (SELECT id, text, format, lang, extras, CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\r?\\n\\z', ''), chr(10)) END AS l FROM src),
part AS (SELECT id, CASE WHEN len(l) > 1 THEN array_to_string(l[2:4], chr(10)) END AS text, format, lang, extras FROM parts)"""


@query(
    f"""WITH RECURSIVE {_CALLS}, {_PART}, {oracles.formatted("part")},
    w AS (SELECT p.id, p.text, len(l) AS n, l[1] || chr(10) || f.formatted || CASE WHEN len(l) > 4 AND NOT ends_with(f.formatted, chr(10)) THEN chr(10) ELSE '' END || array_to_string(l[5:], chr(10)) AS o
      FROM parts p JOIN form f ON f.id = p.id)
    SELECT id AS call_id, CASE WHEN n > 1 THEN CASE WHEN ends_with(text, chr(10)) THEN CASE WHEN ends_with(o, chr(10)) THEN o ELSE o || chr(10) END ELSE regexp_replace(o, '\\n+\\z', '') END ELSE text END AS formatted FROM w"""
)
def format_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 4 of each text formatted, the rest as it is."""
    calls = typed(calls_once(spark, d, "text", "format"))
    return formatting.format_range_df(calls, F.lit(2), F.lit(4)).select("call_id", "formatted")


@query(
    f"""WITH RECURSIVE l AS (SELECT call_id, len(a) AS k, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT DISTINCT call_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM split_requests WHERE text <> '')),
    b AS (SELECT call_id, x[1] AS n, x[2] AS line, x[1] = k - 1 AS last, regexp_full_match(x[2], '[ \\t\\x0b\\f\\r]*') AS blank FROM l),
    c AS (SELECT *, CASE WHEN last THEN lag(blank, 1, false) OVER w ELSE blank END AS gap FROM b WHERE NOT (last AND line = '') WINDOW w AS (PARTITION BY call_id ORDER BY n)),
    e AS (SELECT *, CASE WHEN last AND NOT blank THEN false ELSE gap END AS g FROM c),
    h AS (SELECT *, sum(CASE WHEN g IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY n) - 1 AS no FROM (SELECT *, lag(g) OVER (PARTITION BY call_id ORDER BY n) AS p FROM e)),
    q AS (SELECT call_id, no, string_agg(line || CASE WHEN last THEN '' ELSE chr(10) END, '' ORDER BY n) AS text FROM h GROUP BY call_id, no),
    src AS (SELECT struct_pack(call_id, no) AS id, text, 'plaintext' AS format, CAST(NULL AS VARCHAR) AS lang, CAST([] AS VARCHAR[]) AS extras FROM q
      WHERE NOT regexp_full_match(text, '[{oracles.W}]*')), {oracles.formatted("src")}
    SELECT id.call_id AS call_id, CAST(id.no AS INT) AS paragraph, text AS old_text, formatted AS new_text FROM form"""
)
def paragraph_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each paragraph formatted by itself."""
    return formatting.format_paragraphs_df(texts_of(spark, d, "split_requests"), "call_id").distinct()


@query(
    r"""SELECT count(DISTINCT call_id) AS n_calls, CAST(0 AS BIGINT) AS n_changed FROM split_requests WHERE text IS NOT NULL"""
)
def formatting_is_stable(spark: SparkSession, d: str) -> DataFrame:
    """Formatting plain text again changes nothing: calls, and calls changed by the second time."""
    once = formatting.format_df(texts_of(spark, d, "split_requests"), format=None, out="once")
    twice = formatting.format_df(once, "once", None, out="twice").select("call_id", F.md5("once").alias("once"), F.md5("twice").alias("twice")).distinct()
    return twice.agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(F.col("once") != F.col("twice"), 1)).alias("n_changed"))


# --- checks -------------------------------------------------------------------------------------------------------------


_N_LINES = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split(regexp_replace({0}, '\\r?\\n\\z', ''), chr(10))) END"


@query(
    f"""WITH RECURSIVE {_CHECKS}, {oracles.formatted("src")}
    SELECT id AS call_id, CAST({_N_LINES.format("text")} AS INT) AS original_lines, CAST({_N_LINES.format("formatted")} AS INT) AS formatted_lines FROM form WHERE formatted <> text"""
)
def changed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Texts that formatting would change, with the lines of both."""
    return checks.check_df(typed(texts_of(spark, d, "check_requests", "format")), "call_id").distinct()


_FILES = f"""{_CHECKS}, {oracles.formatted("src")},
checked AS (SELECT DISTINCT coalesce(project_id, -1) AS run, CAST(call_id AS VARCHAR) AS file, CAST({_N_LINES.format("f.text")} AS INT) AS original_lines, CAST({_N_LINES.format("f.formatted")} AS INT) AS formatted_lines,
  f.formatted <> f.text AS changed FROM check_requests c JOIN form f ON f.id = c.call_id WHERE f.text IS NOT NULL)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """A check of all texts by project: ``(run, file, original_lines, formatted_lines, changed)``."""
    calls = typed(texts_of(spark, d, "check_requests", "project_id", "format"))
    done = formatting.format_df(calls)
    counts = [F.size(tx.lines(F.col(c))).alias(n) for c, n in (("text", "original_lines"), ("formatted", "formatted_lines"))]
    run = F.coalesce("project_id", F.lit(-1)).alias("run")
    return done.select(run, F.col("call_id").cast("string").alias("file"), *counts, (F.col("formatted") != F.col("text")).alias("changed")).distinct()


@query(f"WITH RECURSIVE {_FILES} SELECT run, CAST(max(CAST(changed AS INT)) AS INT) AS exit_code FROM checked GROUP BY run")
def checked_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """The exit code of a check of each project's texts."""
    return reports.exit_codes(_checked(spark, d), "run", F.col("changed"))


@query(f"WITH RECURSIVE {_FILES} SELECT run, CAST(to_json(list(struct_pack(file, original_lines, formatted_lines) ORDER BY file)) AS VARCHAR) AS report FROM checked WHERE changed GROUP BY run")
def checked_reports(spark: SparkSession, d: str) -> DataFrame:
    """The JSON report of a check of each project's texts."""
    return reports.json_report(_checked(spark, d).where("changed"), "run")


@query()
def check_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of the texts that formatting would change."""
    calls = typed(one_each(table(spark, d, "check_requests").select("call_id", "text", "format"), "call_id"))
    done = formatting.format_df(calls).where(F.col("formatted") != F.col("text"))
    name = F.col("call_id").cast("string")
    return done.select("call_id", diffs.unified_diff(F.col("text"), F.col("formatted"), name, name).alias("diff"))


_LINE_ROWS = f"""texts AS (SELECT DISTINCT call_id, replace(text, chr(13) || chr(10), chr(10)) AS text, {_FORMAT} AS format FROM check_requests WHERE text IS NOT NULL),
rows AS (SELECT call_id, format, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT call_id, format, {LINES.format("text")} AS a FROM texts WHERE text <> '')),
src AS (SELECT struct_pack(call_id, line := CAST(x[1] AS INT)) AS id, x[2] AS text, format, CAST(NULL AS VARCHAR) AS lang, CAST([] AS VARCHAR[]) AS extras FROM rows)"""


@query(
    f"""WITH {_LINE_ROWS}, {oracles.sentences("src")}, several AS (SELECT id.call_id AS call_id, id.line + 1 AS line FROM sent GROUP BY id HAVING count(*) > 1),
    v AS (SELECT call_id, list(line ORDER BY line) AS violations FROM several GROUP BY call_id)
    SELECT call_id, coalesce(violations, []) AS violations, violations IS NULL AS passed FROM texts LEFT JOIN v USING (call_id)"""
)
def line_violations(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold several sentences."""
    found = texts_of(spark, d, "check_requests").select("call_id", checks.violations(F.col("text")).alias("violations"))
    return found.select("call_id", "violations", (F.size("violations") == 0).alias("passed")).distinct()


@query(
    rf"""WITH texts AS (SELECT DISTINCT call_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM check_requests WHERE text IS NOT NULL AND text <> ''),
    l AS (SELECT call_id, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT call_id, {LINES.format("text")} AS a FROM texts)),
    c AS (SELECT call_id, x[1] AS line, x[2] AS body, unnest(range(2, length(x[2]))) AS j FROM l WHERE length(x[2]) > 2)
    SELECT call_id, CAST(line AS INT) AS line, CAST(j - 1 AS INT) AS start_col, CAST(j AS INT) AS end_col, 'hint' AS severity, 'lectern' AS source,
      'Sentence boundary inside a line' AS message
    FROM c WHERE body[j] = ' ' AND body[j - 1] IN ('.', '!', '?') AND regexp_matches(body[j + 1], '^\p{{Lu}}')"""
)
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Sentence ends inside lines, with their places."""
    return checks.diagnostics_df(texts_of(spark, d, "check_requests"), "call_id").distinct()


@query(
    rf"""WITH texts AS (SELECT DISTINCT call_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM check_requests WHERE text IS NOT NULL AND text <> ''),
    l AS (SELECT call_id, unnest(list_zip(range(0, len(a)), a)) AS x FROM (SELECT call_id, {LINES.format("text")} AS a FROM texts))
    SELECT call_id, CAST(x[1] AS INT) AS line, regexp_matches(x[2], '[.!?][ \t\n\x0b\f\r]+[A-Z]') AS several_sentences, length(x[2]) >= 120 AS long_line FROM l"""
)
def prose_rules(spark: SparkSession, d: str) -> DataFrame:
    """Two rules on each line: several sentences, too long."""
    rows = texts_of(spark, d, "check_requests").select("call_id", F.posexplode(tx.lines(F.col("text"))).alias("line", "body"))
    return rows.select("call_id", "line", checks.prose_rules(F.col("body")).alias("r")).select("call_id", "line", "r.several_sentences", "r.long_line").distinct()


@query(
    f"""WITH RECURSIVE {_LINE_ROWS}, {oracles.formatted("src")}
    SELECT id.call_id AS call_id, id.line AS start_line, CAST(0 AS INT) AS start_col, id.line AS end_line, CAST(length(text) AS INT) AS end_col, formatted AS new_text
    FROM form WHERE formatted <> text AND regexp_matches(text, '[.!?] \\p{{Lu}}')"""
)
def quick_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Edits that fix the lines with a diagnostic."""
    return checks.quick_fixes(typed(texts_of(spark, d, "check_requests", "format")), "call_id").distinct()


_EDIT = f"CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS start_col, CAST({_N_LINES.format('text')} - 1 AS INT) AS end_line, CAST(length(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10))[-1]) AS INT) AS end_col, formatted AS new_text"


@query(f"WITH RECURSIVE {_CHECKS}, {oracles.formatted('src')} SELECT id AS call_id, {_EDIT} FROM form WHERE formatted <> text")
def text_edits(spark: SparkSession, d: str) -> DataFrame:
    """The edit of each text that formatting changes."""
    return checks.text_edits(typed(texts_of(spark, d, "check_requests", "format")), "call_id").distinct()


@query(f"WITH RECURSIVE {_CHECKS}, {oracles.formatted('src')} SELECT id AS call_id, 'source.fixAll' AS kind, 'Format semantic line breaks' AS title, {_EDIT} FROM form WHERE formatted <> text")
def fix_all_actions(spark: SparkSession, d: str) -> DataFrame:
    """The action that fixes each whole text."""
    return checks.fix_all(typed(texts_of(spark, d, "check_requests", "format")), "call_id").distinct()


@query(
    f"""WITH RECURSIVE {_CHECKS}, {_PART}, {oracles.formatted("part")}
    SELECT form.id AS call_id, CAST(1 AS INT) AS start_line, CAST(0 AS INT) AS start_col, CAST(least(len(l), 4) - 1 AS INT) AS end_line, CAST(length(l[least(len(l), 4)]) AS INT) AS end_col, formatted AS new_text
    FROM form JOIN parts ON parts.id = form.id WHERE formatted <> form.text"""
)
def range_edits(spark: SparkSession, d: str) -> DataFrame:
    """The edit of lines 2 to 4 of each text."""
    return checks.range_edits(typed(texts_of(spark, d, "check_requests", "format")), "call_id", F.lit(2), F.lit(4)).distinct()


@query(
    f"""WITH RECURSIVE {_LINE_ROWS}, {oracles.formatted("src")}
    SELECT id.call_id AS call_id, CAST(0 AS INT) AS start_line, CAST(0 AS INT) AS start_col, CAST(0 AS INT) AS end_line, CAST(length(text) AS INT) AS end_col, formatted AS new_text
    FROM form WHERE id.line = 0 AND formatted <> text AND text[-1] IN ('.', ' ', '?', '!')"""
)
def on_type_edits(spark: SparkSession, d: str) -> DataFrame:
    """The edit of each text's first line after its last character was typed."""
    calls = typed(texts_of(spark, d, "check_requests", "format"))
    typed_last = F.right(F.get(tx.lines(F.col("text")), F.lit(0)), F.lit(1))
    return checks.on_type_edits(calls, "call_id", F.lit(0), typed_last).distinct()


@query(
    f"""WITH RECURSIVE {_LINE_ROWS}, {oracles.formatted("src")}
    SELECT id.call_id AS call_id, id.line AS line, formatted AS preview FROM form WHERE formatted <> text AND {_N_LINES.format("formatted")} > 1"""
)
def hover_previews(spark: SparkSession, d: str) -> DataFrame:
    """Previews of lines that would become several."""
    return checks.hover_df(typed(texts_of(spark, d, "check_requests", "format")), "call_id").distinct()


# --- reports, aggregates ---------------------------------------------------------------------------------------------

_REPORTS = "(SELECT DISTINCT run_id, report_id, project_id, file, original_lines, formatted_lines FROM check_reports WHERE run_id IS NOT NULL)"
_ORDER = "ORDER BY coalesce(file, ''), coalesce(original_lines, -1), coalesce(formatted_lines, -1)"


def _reports(spark: SparkSession, d: str) -> DataFrame:
    cols = ("run_id", "report_id", "project_id", "file", "original_lines", "formatted_lines")
    return table(spark, d, "check_reports").where(F.col("run_id").isNotNull()).select(*cols).distinct()


@query(f"SELECT run_id, CAST(to_json(list(struct_pack(file, original_lines, formatted_lines) {_ORDER})) AS VARCHAR) AS report FROM {_REPORTS} GROUP BY run_id")
def json_reports(spark: SparkSession, d: str) -> DataFrame:
    """The JSON report of each run."""
    return reports.json_report(_reports(spark, d), "run_id")


@query(
    f"""SELECT run_id, CAST(to_json(struct_pack("$schema" := '{reports.SARIF_SCHEMA}', version := '2.1.0', runs := [struct_pack(
      tool := struct_pack(driver := struct_pack(name := 'lectern', informationUri := '', rules := [struct_pack(id := 'lectern/needs-reformat',
        shortDescription := struct_pack(text := 'File needs semantic line break formatting'))])),
      results := list(struct_pack(ruleId := 'lectern/needs-reformat', level := 'warning', message := struct_pack(text := 'File needs semantic line break formatting ('
        || coalesce(CAST(original_lines AS VARCHAR), '0') || ' -> ' || coalesce(CAST(formatted_lines AS VARCHAR), '0') || ' lines)'),
        locations := [struct_pack(physicalLocation := struct_pack(artifactLocation := struct_pack(uri := file)))]) {_ORDER}))])) AS VARCHAR) AS report
    FROM {_REPORTS} GROUP BY run_id"""
)
def sarif_reports(spark: SparkSession, d: str) -> DataFrame:
    """The SARIF report of each run."""
    return reports.sarif_report(_reports(spark, d), "run_id")


@query(f"SELECT 'would reformat: ' || file AS line FROM {_REPORTS}")
def text_reports(spark: SparkSession, d: str) -> DataFrame:
    return reports.text_report(_reports(spark, d))


@query(f"SELECT run_id, CAST(coalesce(max(CAST(original_lines <> formatted_lines AS INT)), 0) AS INT) AS exit_code FROM {_REPORTS} GROUP BY run_id")
def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """1 for runs with any file whose lines change."""
    return reports.exit_codes(_reports(spark, d), "run_id", F.col("original_lines") != F.col("formatted_lines"))


@query(
    rf"""SELECT run_id, bool_or(coalesce(e = 'org', false)) AS has_org, bool_or(coalesce(e IN ('tex', 'latex'), false)) AS has_latex,
      bool_or(coalesce(e IN ('md', 'markdown'), false)) AS has_markdown FROM (SELECT run_id, {EXT} AS e FROM {_REPORTS}) GROUP BY run_id"""
)
def formats_in_use(spark: SparkSession, d: str) -> DataFrame:
    """Which formats the files of a run have."""
    e = F.coalesce(tx.extension(F.col("file")), F.lit(""))
    each = _reports(spark, d).groupBy("run_id")
    return each.agg(
        F.bool_or(e == "org").alias("has_org"), F.bool_or(e.isin("tex", "latex")).alias("has_latex"), F.bool_or(e.isin("md", "markdown")).alias("has_markdown")
    )


@query(r"SELECT DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder FROM check_reports WHERE contains(file, '/')")
def watched_folders(spark: SparkSession, d: str) -> DataFrame:
    """The folders of all reported files."""
    return files.parent_folders(table(spark, d, "check_reports"), "file")


@query("SELECT DISTINCT report_id, file FROM check_reports WHERE " + EXT + " IN ('org', 'tex', 'latex', 'ltx', 'sty', 'cls', 'md', 'markdown', 'mkd', 'mdx')")
def prose_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the formats that sentence diffs look at."""
    typed = table(spark, d, "check_reports").select("report_id", "file", tx.format_of_path(F.col("file")).alias("format"))
    return files.prose_files(typed).select("report_id", "file").distinct()


@query(
    """SELECT call_id, max(received_at) AS received_at, arg_max(coalesce(client, ''), received_at) AS client, arg_max(coalesce(project_id, -1), received_at) AS project_id, count(*) AS n_rows
    FROM format_requests GROUP BY call_id"""
)
def latest_calls(spark: SparkSession, d: str) -> DataFrame:
    """Each call as it was delivered last."""
    row = F.struct(F.coalesce("client", F.lit("")).alias("client"), F.coalesce("project_id", F.lit(-1)).alias("project_id"))
    last = table(spark, d, "format_requests").groupBy("call_id").agg(F.max("received_at").alias("received_at"), F.max_by(row, "received_at").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    return last.select("call_id", "received_at", "last.client", "last.project_id", "n_rows")


@query(
    """SELECT user_id, to_timestamp(unnest(list_reduce(list_transform(times, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 3600000000 THEN list_concat(a, x) ELSE a END)) / 1000000)::TIMESTAMP AS ts
    FROM (SELECT user_id, list_sort(list(DISTINCT epoch_us(ts))) AS times FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id)"""
)
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events at least an hour after the last one accepted."""
    return debounced(table(spark, d, "events"), "user_id", "ts", 3_600_000, 24 * 3600)


# --- versions -----------------------------------------------------------------------------------------------------------

_ADDED = "A line is added. It is new."
_VERSIONS = f"""v AS (SELECT id, format, text AS old_text, array_to_string(list_concat(list_concat(l[2:], l[:1]), ['{_ADDED}']), chr(10)) AS new_text
  FROM (SELECT id, format, text, CASE WHEN text = '' THEN [] ELSE {LINES.format("replace(replace(text, chr(13) || chr(10), chr(10)), ' the ', ' THE ')")} END AS l FROM src WHERE text IS NOT NULL))"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of each text: as it is; and with a word changed, the first line moved to the end and one added there."""
    calls = typed(calls_once(spark, d, "text", "format"))
    lines = tx.lines(F.replace(tx.unified_newlines(F.col("text")), F.lit(" the "), F.lit(" THE ")))
    moved = F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, 1, 1), F.array(F.lit(_ADDED)))
    pairs = calls.select("call_id", "format", F.col("text").alias("old_text"), F.array_join(moved, "\n").alias("new_text"))
    return diffs.changed_pairs(pairs)


@query(f"WITH {_CALLS}, {_VERSIONS} SELECT id AS call_id FROM v WHERE old_text <> new_text")
def changed_versions(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose versions differ."""
    return _versions(spark, d).select("call_id")



def _flat_sql(side: str, sign: int) -> str:
    """The flat list of each text of one side, with a sign."""
    return f"""{side}_src AS (SELECT id, format, {side}_text AS text FROM v), {oracles.regions(f"{side}_src", f"{side}_reg")},
{side}_p AS (SELECT struct_pack(a := id, b := region_no) AS id, text, CAST(NULL AS VARCHAR) AS lang, CAST([] AS VARCHAR[]) AS extras FROM {side}_reg WHERE kind = 'prose'), {oracles.sentences(f"{side}_p", f"{side}_sent")},
{side}_flat AS (SELECT id.a AS id, sentence, {sign} AS n FROM {side}_sent UNION ALL SELECT id, '', {sign} FROM {side}_reg WHERE kind = 'blank'
  UNION ALL SELECT id, trim(text, {oracles.WHITE}), {sign} FROM {side}_reg WHERE kind = 'structure' AND trim(text, {oracles.WHITE}) <> '')"""


@query(
    f"""WITH RECURSIVE {_CALLS}, {_VERSIONS}, {_flat_sql("old", -1)}, {_flat_sql("new", 1)}
    SELECT id AS call_id, CASE WHEN sum(n) > 0 THEN 'added' ELSE 'removed' END AS op, sentence, CAST(abs(sum(n)) AS BIGINT) AS n
    FROM (SELECT * FROM old_flat UNION ALL SELECT * FROM new_flat) GROUP BY id, sentence HAVING sum(n) <> 0"""
)
def sentence_changes(spark: SparkSession, d: str) -> DataFrame:
    """Sentences added and removed between versions."""
    return diffs.sentence_changes(_versions(spark, d), "call_id")


@query()
def sentence_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of the sentences of both versions."""
    return diffs.sentence_diff_df(_versions(spark, d), "call_id", reference="HEAD")


@query(
    f"""WITH {_CALLS}, {_VERSIONS}, x AS (SELECT id, unnest(CASE WHEN old_text = '' THEN [] ELSE {LINES.format("replace(old_text, chr(13) || chr(10), chr(10))")} END) AS line, -1 AS n FROM v
      UNION ALL SELECT id, unnest({LINES.format("new_text")}) AS line, 1 AS n FROM v)
    SELECT id AS call_id, CASE WHEN sum(n) > 0 THEN 'added' ELSE 'removed' END AS op, line, CAST(abs(sum(n)) AS BIGINT) AS n FROM x GROUP BY id, line HAVING sum(n) <> 0"""
)
def line_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lines added and removed between versions, as a multiset."""
    pairs = _versions(spark, d)
    side = lambda c, n: F.transform(tx.lines(F.col(c)), lambda x: F.struct(x.alias("line"), F.lit(n).alias("n")))
    net = pairs.select("call_id", F.explode(F.concat(side("old_text", -1), side("new_text", 1))).alias("x")).groupBy("call_id", F.col("x.line").alias("line")).agg(F.sum("x.n").alias("n"))
    return net.where("n <> 0").select("call_id", F.when(F.col("n") > 0, "added").otherwise("removed").alias("op"), "line", F.abs("n").alias("n"))


from lectern.plans import line_queries  # noqa: E402,F401  (adds its queries)
