"""Files as documents, and documents back to files, in order or in place."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """``(path, text)`` of whole files: a path, a glob, several of them, or a folder with all below it.

    When folders are walked, files in folders below them whose name begins with a period are left out.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    found = reader.text(roots, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    if not recursive:
        return found
    hidden = F.lit(False)
    for root in roots:
        at = F.locate(root.rstrip("/") + "/", F.col("path"))
        below = F.substr("path", at + F.lit(len(root.rstrip("/"))))
        hidden = hidden | F.when(at > 0, below.rlike(r"/\.[^/]+/")).otherwise(F.lit(False))
    return found.where(~hidden)


def in_order(documents: DataFrame, paths: Sequence[str], path: str = "path") -> DataFrame:
    """``documents`` with ``ordinal``, the place of each path among those asked for; others are left out."""
    session = documents.sparkSession
    asked = session.createDataFrame([(p, k) for k, p in reversed(list(enumerate(paths)))], "asked string, ordinal int").groupBy("asked").agg(F.min("ordinal").alias("ordinal"))
    return documents.join(F.broadcast(asked), F.col(path) == F.col("asked")).drop("asked")  # what the caller listed


def print_in_order(formatted: DataFrame, out: str = "formatted", order: str = "ordinal", write=None) -> None:
    """Each output, in the order of inputs; one partition at a time reaches the driver. Null outputs are left out."""
    import sys

    write = write or sys.stdout.write
    for row in formatted.where(F.col(out).isNotNull()).orderBy(order).select(out).toLocalIterator():
        write(row[0])


def write_output(formatted: DataFrame, target: str, out: str = "formatted", order: str = "ordinal") -> None:
    """One file with the output of the last of the inputs, as each overwrites the one before."""
    last = formatted.where(F.col(out).isNotNull()).agg(F.max_by(out, order).alias("text")).first()["text"]
    if last is not None:
        with open(target, "w", encoding="utf-8", newline="") as f:
            f.write(last)


def local_path(path: str) -> str:
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme == "file" else path


def write_back(formatted: DataFrame, path: str = "path", text: str = "text", out: str = "formatted") -> None:
    """Changed documents to the very files they came from (a file system that all executors share), each put in place whole."""

    def put(rows: Iterator) -> None:
        for row in rows:
            target = local_path(row[0])
            with open(f"{target}.new", "w", encoding="utf-8", newline="") as f:
                f.write(row[1])
            os.replace(f"{target}.new", target)

    changed_only(formatted, text, out).select(path, out).foreachPartition(put)


def listed(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``(path, modified, length)`` of files, without reading them."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load([paths] if isinstance(paths, str) else list(paths)).select("path", F.col("modificationTime").alias("modified"), "length")


def file_events(before: DataFrame, now: DataFrame) -> DataFrame:
    """``(path, kind, modified)`` between two listings: ``create``, ``modify`` or ``remove``."""
    a = before.select("path", F.col("modified").alias("a"), F.col("length").alias("m"))
    b = now.select("path", F.col("modified").alias("b"), F.col("length").alias("n"))
    both = a.join(b, "path", "full")
    kind = F.when(F.col("a").isNull(), "create").when(F.col("b").isNull(), "remove").when((F.col("a") != F.col("b")) | (F.col("m") != F.col("n")), "modify")
    return both.select("path", kind.alias("kind"), F.coalesce("b", "a").alias("modified")).where(F.col("kind").isNotNull())


def to_format(events: DataFrame, watched: DataFrame | None = None) -> DataFrame:
    """The events after which a file is formatted: creations and changes, of the watched paths where these are listed."""
    kept = events.where(F.col("kind").isin("create", "modify"))
    return kept if watched is None else kept.join(watched.select("path"), "path", "left_semi")


def one_document(spark: SparkSession, text: str, path: str | None = None) -> DataFrame:
    """A single text, such as what comes from standard input."""
    return spark.createDataFrame([(path, text)], "path string, text string")


def version_of(versions: DataFrame, version: str, column: str = "version") -> DataFrame:
    return versions.where(F.col(column) == version)


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose text differs between two snapshots, or that only one of them has."""
    a, b = old.select("path", F.xxhash64("text").alias("a"), F.lit(1).alias("in_a")), new.select("path", F.xxhash64("text").alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, "path", "full")
    return both.where(F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("a") != F.col("b"))).select("path")


def prose_files(files: DataFrame, format: str = "format") -> DataFrame:
    """Those formats that sentence diffs of a working tree look at."""
    return files.where(F.col(format).isin("org", "latex", "markdown"))


def changed_only(formatted: DataFrame, text: str = "text", out: str = "formatted") -> DataFrame:
    """What an in-place write has to write."""
    return formatted.where(F.col(text) != F.col(out))


def write_in_place(formatted: DataFrame, folder: str, text: str = "text", out: str = "formatted") -> None:
    """Changed documents only, as a table of ``(path, text)`` beside the old one."""
    changed_only(formatted, text, out).select("path", F.col(out).alias("text")).write.mode("overwrite").parquet(folder)


def parent_folders(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(F.col(path).contains("/")).select(F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1).alias("folder")).distinct()
