"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import types

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many rows may be broadcast by :func:`small_side`.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, so that a model or vocabulary is loaded once per worker."""
    return sys.modules.setdefault("_lectern_worker_cache", types.ModuleType("_lectern_worker_cache")).__dict__


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (Spark then joins by shuffle)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_sample(df: DataFrame, key: str, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows chosen by a hash of ``key`` (all of them if there are fewer); the same rows on every run.

    The hash filter runs in the scan, so no more than the sample ever leaves the executors.  Null keys are left out.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df.where(F.col(key).isNotNull())
    parts = 1 << 53
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(parts)) < int(parts * rows / total))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: computed once, and kept if executors are lost.

    The folder is the cluster's own (``spark.checkpoint.dir``).  Only a session on this one machine, as in tests, that has
    none gets a temporary one, removed at its end; elsewhere that is an error.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lectern-checkpoint-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()


def tasks_of(df: DataFrame) -> int:
    """How many tasks a shuffle for heavy work per row should have: all cores, or the session's setting if that is more."""
    session = df.sparkSession
    return max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, at_most: int = 8 << 20) -> DataFrame:
    """``df`` over all cores if the files it reads are small, as one small file is read by one task; else unchanged.

    Only for heavy work per row: at this size moving the rows costs next to nothing.
    """
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # no estimate in this kind of session
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= at_most else df


def one_each(df: DataFrame, key: str) -> DataFrame:
    """One row for each key, spread by it for heavy work per row; null keys are left out.

    For tables whose rows of one key repeat each other, where the result is as large as the texts.  Where it is small, the
    work is done on all rows and its results are made distinct, so that no texts are shuffled.
    """
    return df.where(F.col(key).isNotNull()).repartition(tasks_of(df), key).dropDuplicates([key])
