"""Column functions over texts, lines, paths and configuration; all built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of all kinds.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FORMATS = ("org", "latex", "markdown", "rst", "plaintext")
#: File extensions of each format, case-sensitive; fixed values.
EXTENSIONS = {"org": ("org",), "latex": ("tex", "latex", "ltx", "sty", "cls"), "markdown": ("md", "markdown", "mkd", "mdx"), "rst": ("rst", "rest")}
#: Extensions and the names of an external converter's readers; fixed values.
READERS = {
    "org": "org", "tex": "latex", "latex": "latex", "md": "markdown", "markdown": "markdown", "rst": "rst", "rest": "rst",
    "typ": "typst", "adoc": "asciidoc", "html": "html", "htm": "html", "docx": "docx", "txt": "markdown",
}
#: Editors' language ids; fixed values.
LANGUAGE_IDS = {"org": "org", "latex": "latex", "tex": "latex", "markdown": "markdown", "restructuredtext": "rst", "rst": "rst", "plaintext": "plaintext"}
#: The name in markers that switch formatting off and on: ``name:off`` or ``name:on`` alone on a line, in any comment style.
MARKER = "lectern"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed right there and once.

    Projections are merged, and what they compute is copied into filters and into arguments of Python functions, which
    cannot hold lambdas; a generator of one row is where merging stops.
    """
    kept = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def unicode_trim(c: Column) -> Column:
    """Without white space (of any kind) at both ends; ``trim`` takes off U+0020 only."""
    return F.trim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.rlike(r"(?U)\A\s*\z")


def lines(text: Column) -> Column:
    """Lines ended by LF or CRLF; a final line end opens no further line, and an empty text has no lines."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def _case(key: Column, table: dict[str, str], default: Column | None = None) -> Column:
    out = F
    for a, b in table.items():
        out = out.when(key == a, F.lit(b))
    return out.otherwise(default) if default is not None else out


def format_of_extension(ext: Column) -> Column:
    out = F
    for name, extensions in EXTENSIONS.items():
        out = out.when(ext.isin(*extensions), F.lit(name))
    return out.otherwise(F.lit("plaintext"))


def extension(path: Column) -> Column:
    """After the last period of the file's name; names that only begin with a period have none."""
    return F.regexp_extract(path, r"(?s)(?:\A|/)[^/]+\.([^./]*)\z", 1)


def format_of_path(path: Column) -> Column:
    return format_of_extension(extension(path))


def format_of_name(name: Column) -> Column:
    """As :func:`format_of_path`, but a name without a period is taken for an extension."""
    return format_of_extension(F.substring_index(name, ".", -1))


def format_of_document(language_id: Column, path: Column) -> Column:
    return F.coalesce(_case(language_id, LANGUAGE_IDS), format_of_path(path))


def reader_of_path(path: Column) -> Column:
    return _case(extension(path), READERS)


def format_of_content(text: Column) -> Column:
    """A guess from the content: marks of LaTeX, Org, Markdown and reStructuredText, in this order."""
    first = F.slice(lines(text), 1, 20)
    has = lambda s: F.contains(text, F.lit(s))
    any_line = lambda f: F.exists(first, f)
    return (
        F.when(has("\\begin{") | has("\\section{") | has("\\documentclass"), "latex")
        .when(any_line(lambda x: x.startswith("#+") | x.startswith("* ")) & (has(":PROPERTIES:") | has(":END:") | has("#+begin_")), "org")
        .when(any_line(lambda x: x.startswith("# ") | x.startswith("## ")), "markdown")
        .when(has(".. ") | any_line(lambda x: (F.octet_length(x) > 3) & x.rlike(r"\A(?:=+|-+)\z")), "rst")
        .otherwise("plaintext")
    )


def resolved_format(asked: Column, path: Column, project: Column) -> Column:
    return F.coalesce(asked, F.nullif(format_of_path(path), F.lit("plaintext")), project, F.lit("plaintext"))


def resolved_width(asked: Column, project: Column, editor: Column) -> Column:
    return F.coalesce(F.nullif(F.greatest(asked, F.lit(0)), F.lit(0)), F.nullif(F.greatest(project, F.lit(0)), F.lit(0)), editor, F.lit(0))


def all_abbreviations(top: Column, section: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(top, none), F.coalesce(section, none))


def pragma(line: Column, name: str = MARKER) -> Column:
    """``off``, ``on`` or null for a line; ``name`` is the name that markers have."""
    marker = rf"{re.escape(name)}:(on|off)"
    found = F.regexp_extract(unicode_trim(line), rf"(?U)\A(?:[#%] \s*{marker}|<!-- \s*{marker}\s* -->|{marker})\z", 1)
    second = F.regexp_extract(unicode_trim(line), rf"(?U)\A<!-- \s*{marker}\s* -->\z", 1)
    third = F.regexp_extract(unicode_trim(line), rf"\A{marker}\z", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(second, F.lit("")), F.nullif(third, F.lit("")))


def line_range(spec: Column) -> Column:
    """``struct(start, end)`` of ``start:end``, null unless both are whole numbers of at least 1 in order."""
    good = spec.rlike(r"\A\+?[0-9]{1,18}:\+?[0-9]{1,18}\z")
    part = lambda k: F.split(spec, ":")[k].try_cast("bigint")
    return F.when(good & (part(0) >= 1) & (part(0) <= part(1)), F.struct(part(0).alias("start"), part(1).alias("end")))


def restored(input: Column, output: Column) -> Column:
    """``output`` with the final line ends and the kind of line ends of ``input``."""
    ended = F.when(input.endswith("\n"), F.when(output.endswith("\n"), output).otherwise(F.concat(output, F.lit("\n")))).otherwise(F.regexp_replace(output, r"\n+\z", ""))
    return F.when(F.contains(input, F.lit("\r\n")), F.replace(ended, F.lit("\n"), F.lit("\r\n"))).otherwise(ended)


def unified_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def coloured(line: Column) -> Column:
    """A line of a diff in its terminal colour."""
    paint = lambda code: F.concat(F.lit(f"\x1b[{code}m"), line, F.lit("\x1b[0m"))
    return (
        F.when(line.startswith("--- ") | line.startswith("+++ "), paint(1))
        .when(line.startswith("@@"), paint(36))
        .when(line.startswith("+"), paint(32))
        .when(line.startswith("-"), paint(31))
        .otherwise(line)
    )


def lens_title(format: Column, width: Column, tool: str = "lectern") -> Column:
    shown = F.when(width > 0, width.cast("string")).otherwise("unlimited")
    return F.concat(F.lit(f"{tool}: "), F.initcap(format), F.lit(" | width: "), shown)


def glob_regex(pattern: Column) -> Column:
    """A glob as a regular expression: ``**`` any path, ``*`` and ``?`` also across slashes, ``[...]`` a class."""
    out = F.regexp_replace(pattern, r"([.+^$(){}|\\])", r"\\$1")
    out = F.regexp_replace(out, r"\[!", "[^")
    out = F.regexp_replace(out, r"\*\*/", "\x01")
    out = F.regexp_replace(out, r"\*+", ".*")
    out = F.regexp_replace(out, r"\?", ".")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(out, "\x01", "(?:.*/)?"), F.lit(r"\z"))


def globs_regex(patterns: Column) -> Column:
    """All globs of a list as one regular expression, to be made once a project; null where no glob is usable."""
    usable = F.filter(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: p.isNotNull() & ~p.rlike(r"\[[^\]]*\z"))
    return F.when(F.size(usable) > 0, F.array_join(F.transform(usable, glob_regex), "|"))


def matches_globs(path: Column, regex: Column, folder: str | None = None) -> Column:
    """Whether any glob of :func:`globs_regex` matches the whole path, the path seen from ``folder``, or the file's name."""
    names = [path, F.substring_index(path, "/", -1)]
    if folder is not None:
        prefix = folder.rstrip("/") + "/"
        names.append(F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))))
    out = F.lit(False)
    for name in names:
        out = out | F.coalesce(F.rlike(name, regex), F.lit(False))
    return out


def is_ignored(path: Column, patterns: Column, folder: str | None = None) -> Column:
    """Whether any glob of a list matches; null and unusable globs match nothing."""
    return matches_globs(path, globs_regex(patterns), folder)


#: What a run does with its results; files to ignore are left out only where files are checked or written.
MODES = ("print", "output", "in_place", "check", "diff")


def is_skipped(path: Column, regex: Column, mode: str, folder: str | None = None) -> Column:
    """Whether a run in this mode leaves the file out."""
    return matches_globs(path, regex, folder) if mode in ("check", "in_place") else F.lit(False)


def per_format_of(struct: str, format: Column, field: str) -> Column:
    """A field of the section for ``format`` inside a configuration struct."""
    return F.coalesce(*[F.when(format == f, F.col(f"{struct}.{f}.{field}")) for f in FORMATS])


#: Spellings of a call's format besides its name; fixed values.
SPELLINGS = {"txt": "plaintext", "md": "markdown", "mkd": "markdown", "tex": "latex", "rest": "rst"}


def format_of_spelling(c: Column) -> Column:
    """A call's format in any spelling and case; null is plain text."""
    low = F.lower(F.trim(c))
    return F.coalesce(_case(low, SPELLINGS), low, F.lit("plaintext"))


#: Environments of LaTeX that hold no prose; fixed values.
KEPT_ENVIRONMENTS = tuple(
    "equation equation* align align* gather gather* multline multline* eqnarray eqnarray* figure figure* table table*"
    " tabular tabular* lstlisting verbatim minted tikzpicture array matrix pmatrix bmatrix".split()
)


def line_predicates(line: Column) -> dict[str, Column]:
    """What single lines are in the markup formats, by name."""
    environments = "|".join(map(re.escape, KEPT_ENVIRONMENTS))
    bare = unicode_trim(line)
    start = F.ltrim(line, F.lit(WHITE))
    upper = F.upper(start)
    return {
        "org_block_begin": upper.startswith("#+BEGIN_"),
        "org_block_end": upper.startswith("#+END_"),
        "org_drawer": bare.startswith(":") & bare.endswith(":") & (F.octet_length(bare) > 2),
        "org_keyword": start.startswith("#+") & ~upper.startswith("#+BEGIN_") & ~upper.startswith("#+END_"),
        "org_comment": start.startswith("#") & ~start.startswith("#+"),
        "org_drawer_end": F.upper(bare) == ":END:",
        "org_latex_begin": line.rlike(r"\A[ \t]*\\begin\{[^}]+\}"),
        "org_latex_end": line.rlike(r"\A[ \t]*\\end\{[^}]+\}"),
        "org_display_open": bare == "\\[",
        "org_snippet": bare.startswith("@@") & line.rlike(r"@@[a-zA-Z]+:[^@]*@@"),
        "org_table": start.startswith("|"),
        "org_headline": line.rlike(r"\A\*+[ \t]"),
        "latex_comment": start.startswith("%"),
        "latex_kept": line.rlike(rf"\\begin\{{(?:{environments})\}}"),
        "latex_kept_end": line.rlike(rf"\\end\{{(?:{environments})\}}"),
        "latex_display_close": line.rlike(r"\\\][ \t]*\z"),
        "latex_display_open": start.startswith("\\["),
        "markdown_heading": line.rlike(r"\A#{1,6}[ \t]"),
        "markdown_fence": start.rlike(r"\A(?:`{3}|~{3})"),
        "markdown_item": line.rlike(r"\A[ \t]*(?:[-*+]|[0-9]+[.)]) "),
        "markdown_table": bare.rlike(r"(?s)\A\|.*\|\z"),
        "rst_underline": bare.rlike(r"\A(?:==+|--+|~~+|\^\^+|\"\"+|##+|\*\*+|\+\++)\z"),
        "rst_directive": start.startswith(".. ") & F.contains(start, F.lit("::")),
    }
