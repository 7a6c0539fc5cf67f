"""Streams of documents: formatting files as they change, and the latest state of open documents."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions import text as tx
from lectern.operators.checks import diagnostics_df
from lectern.operators.formatting import format_df
from lectern.plans.config import ProjectConfig
from lectern.sources import files


def watched(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of ``(path, text)``: each file of a folder as a whole, once, when it appears.

    A file source remembers paths, so a file that changes in place is not seen again: for that see :func:`watch_files`.
    """
    stream = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", pattern).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def formatted_files(documents: DataFrame, config: ProjectConfig) -> DataFrame:
    """``(path, text, formatted)`` of files that are not ignored and would change."""
    kept = documents.where(~tx.is_ignored(F.col("path"), F.lit(list(config.ignore)))) if config.ignore else documents
    typed = kept.withColumn("format", tx.resolved_format(F.lit(None).cast("string"), F.col("path"), F.lit(config.format)))
    extras = config.abbreviations_column(F.col("format"))
    done = format_df(typed, "text", "format", config.width_column(F.col("format")), config.lang, extras)
    return done.where(F.col("formatted") != F.col("text")).select("path", "text", "formatted")


def watch(stream: DataFrame, load_config: Callable[[], ProjectConfig], write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Format what changes and hand it to ``write(formatted, batch)``; the configuration is read again for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        write(formatted_files(batch, load_config()), number)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(checkpoint, "watch"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="200 milliseconds")).start()


def watch_files(
    spark: SparkSession, paths: Sequence[str], load_config: Callable[[], ProjectConfig], write: Callable[[DataFrame, int], None], checkpoint: str,
    every: str = "200 milliseconds",
) -> StreamingQuery:
    """Format listed files, folders or globs when they are created or changed in place.

    Each batch lists the files and compares with the listing of the batch before, which lies beside the stream's
    checkpoint.  Files that are there at the start are taken as known.  The configuration is read again each time.  A
    batch that fails is logged and skipped.
    """
    folder = os.path.join(checkpoint, "listing")
    known: list[str] = []  # the last listing that was written whole

    def each(_: DataFrame, number: int) -> None:
        try:
            now = files.listed(spark, list(paths)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).persist()
            if known:
                events = files.to_format(files.file_events(spark.read.parquet(known[-1]), now))
                changed = [r["path"] for r in events.select("path").collect()]  # of the listed files, those just touched
                if changed:
                    write(formatted_files(files.read_documents(spark, [files.local_path(p) for p in changed]), load_config()), number)
            target = f"{folder}-{int(known[-1:] == [f'{folder}-0'])}"
            now.write.mode("overwrite").parquet(target)
            now.unpersist()
            known[:] = [target]
        except Exception as e:  # a file went away between listing and reading
            logging.getLogger(__name__).warning("batch %s skipped: %s", number, e)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    return ticks.writeStream.foreachBatch(each).option("checkpointLocation", os.path.join(checkpoint, "ticks")).trigger(processingTime=every).start()


def latest_documents(changes: DataFrame, key: str = "uri", order: str = "version", closed: str = "closed") -> DataFrame:
    """Of opens, changes and closes, the last of each document that is still open; the largest text among ties."""
    rest = [c for c in changes.columns if c != key]
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x"))
    return last.select(key, "x.*").where(~F.coalesce(F.col(closed), F.lit(False)))


def open_diagnostics(changes: DataFrame, key: str = "uri") -> DataFrame:
    """Diagnostics of the latest text of every open document."""
    return diagnostics_df(latest_documents(changes, key), key)


def merged_state(state: DataFrame | None, batch: DataFrame, key: str = "uri", order: str = "version") -> DataFrame:
    """The state of open documents after a batch of changes (for ``foreachBatch``): closed ones leave it."""
    return latest_documents(batch if state is None else state.unionByName(batch), key, order)


def republished(state: DataFrame, config: ProjectConfig, key: str = "uri", path: str | None = None) -> DataFrame:
    """Diagnostics of all open documents, to be sent again when the configuration was read again; ignored ones have none."""
    kept = state.where(~tx.is_ignored(F.col(path or key), F.lit(list(config.ignore)))) if config.ignore else state
    return diagnostics_df(kept, key)
