"""Project configuration: TOML, editors' width settings, and what holds for a call or a file."""

from __future__ import annotations

import fnmatch
import tomllib
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.runtime import small_side


@dataclass(frozen=True)
class Section:
    extra_abbreviations: tuple[str, ...] = ()
    max_width: int | None = None


@dataclass(frozen=True)
class ProjectConfig:
    extra_abbreviations: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    format: str | None = None
    max_width: int | None = None
    lang: str | None = None
    sections: dict[str, Section] = field(default_factory=dict)

    @classmethod
    def parse(cls, toml: str) -> ProjectConfig:
        """Unknown keys are tolerated, missing ones take their defaults."""
        raw = tomllib.loads(toml)
        sections = {
            f: Section(tuple(raw[f].get("extra_abbreviations", ())), raw[f].get("max_width")) for f in tx.FORMATS if isinstance(raw.get(f), dict)
        }
        return cls(tuple(raw.get("extra_abbreviations", ())), tuple(raw.get("ignore", ())), raw.get("format"), raw.get("max_width"), raw.get("lang"), sections)

    @classmethod
    def find(cls, folder: str | Path, name: str, explicit: str | None = None) -> ProjectConfig:
        """The explicit file, else the nearest ``name`` in the folder or above it, else the defaults."""
        if explicit:
            return cls.parse(Path(explicit).read_text(encoding="utf-8"))
        here = Path(folder).resolve()
        for at in (here, *here.parents):
            if (at / name).is_file():
                return cls.parse((at / name).read_text(encoding="utf-8"))
        return cls()

    def abbreviations(self, format: str) -> list[str]:
        return [*self.extra_abbreviations, *self.sections.get(format, Section()).extra_abbreviations]

    def width(self, format: str) -> int | None:
        own = self.sections.get(format, Section()).max_width
        return self.max_width if own is None else own

    def abbreviations_column(self, format: Column) -> Column:
        out = F.lit(list(self.extra_abbreviations)) if self.extra_abbreviations else F.array().cast("array<string>")
        for f in self.sections:
            words = self.abbreviations(f)
            out = F.when(format == f, F.lit(words) if words else F.array().cast("array<string>")).otherwise(out)
        return out

    def width_column(self, format: Column) -> Column:
        out = F.lit(self.max_width or 0)
        for f in self.sections:
            out = F.when(format == f, F.lit(self.width(f) or 0)).otherwise(out)
        return out


def editor_width(editorconfig: str, path: str) -> int | None:
    """``max_line_length`` of the last matching section of an editor's configuration file."""
    width, matches = None, False
    for line in editorconfig.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            globs = _alternatives(line[1:-1])
            matches = any(fnmatch.fnmatch(path if "/" in g else path.rsplit("/", 1)[-1], g.lstrip("/")) for g in globs)
        elif matches and "=" in line and not line.startswith(("#", ";")):
            name, value = (x.strip().lower() for x in line.split("=", 1))
            if name == "max_line_length":
                width = int(value) if value.isdigit() else None
    return width


def editor_width_of(path: str | Path) -> int | None:
    """``max_line_length`` for a file: of the nearest editor configuration that gives one, up to a ``root`` one.

    Paths in sections are seen from the folder of the configuration.
    """
    path = Path(path).resolve()
    for folder in path.parents:
        if not (folder / ".editorconfig").is_file():
            continue
        text = (folder / ".editorconfig").read_text(encoding="utf-8")
        if (width := editor_width(text, path.relative_to(folder).as_posix())) is not None:
            return width
        head = text.split("\n[", 1)[0].lower().replace(" ", "")
        if not text.lstrip().startswith("[") and "root=true" in head.splitlines():
            return None
    return None


def editor_widths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, editor_width)`` of files on the driver's machine, for a join with documents; null where none is set."""
    return spark.createDataFrame([(p, editor_width_of(p)) for p in paths], "path string, editor_width int")


def _alternatives(glob: str) -> list[str]:
    if "{" not in glob or "}" not in glob:
        return [glob]
    head, _, rest = glob.partition("{")
    inner, _, tail = rest.partition("}")
    return [x for part in inner.split(",") for x in _alternatives(head + part + tail)]


def latest(configs: DataFrame) -> DataFrame:
    """Each project's configuration as last loaded; the largest path among ties."""
    rest = [c for c in configs.columns if c != "project_id"]
    held = configs.where(F.col("project_id").isNotNull()).groupBy("project_id").agg(F.max_by(F.struct(*rest), F.struct("loaded_at", "rc_path")).alias("c"))
    return held.select("project_id", "c.*")


def with_project(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """``calls`` with ``project``, a struct of its project's configuration (null where there is none).

    The struct has a field more, ``ignored``: the globs to ignore as one regular expression, made once a project.
    """
    known = latest(configs).withColumn("ignored", tx.globs_regex(F.col("ignore_patterns")))
    held = known.select("project_id", F.struct(*[c for c in known.columns if c != "project_id"]).alias("project"))
    return calls.join(small_side(held), "project_id", "left")


def effective(format: Column, width: Column, extras: Column, editor: Column | None = None) -> list[Column]:
    """Columns ``width`` and ``abbreviations`` that hold for a call with a ``project`` struct.

    ``editor`` is the width of an editor's configuration, which holds where neither call nor project give one.
    """
    section = lambda f: tx.per_format_of("project", format, f)
    project_width = F.coalesce(section("max_width"), F.col("project.max_width"))
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce(extras, none), F.coalesce(F.col("project.extra_abbreviations"), none), F.coalesce(section("extra_abbreviations"), none))
    editor = F.lit(None).cast("int") if editor is None else editor
    return [tx.resolved_width(width, project_width, editor).alias("width"), words.alias("abbreviations")]
