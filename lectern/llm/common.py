"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.plans import config
from lectern.runtime import small_side

FORMATS = text.FORMATS
#: The format's name of any spelling; null is plain text, an unknown spelling stays as it is in lower case.
format_key = text.format_of_spelling
#: The row with the latest ``loaded_at`` of each project; among ties the one with the largest path.
latest_configs = config.latest


def with_config(calls: DataFrame, configs: DataFrame, *columns: Column) -> DataFrame:
    """``calls`` left-joined with columns of its project's configuration.

    There is one row per project; it is broadcast only while its size is checked to be small.
    """
    return calls.join(small_side(latest_configs(configs).select("project_id", *columns)), "project_id", "left")


STEP_BYTES = 16 << 20


def _parts(batch: pa.RecordBatch, rows: int, step_bytes: int) -> Iterator[pa.RecordBatch]:
    step = max(1, min(rows, batch.num_rows * step_bytes // max(batch.nbytes, 1)))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def map_rows(df: DataFrame, of_batch: Callable[[pa.RecordBatch], dict | None], schema: str, rows: int = 512, step_bytes: int = STEP_BYTES) -> DataFrame:
    """``mapInArrow`` for a function from at most ``rows`` rows to columns (lists or arrays) in the schema's order.

    Of rows with long texts fewer are given at a time, so that a step holds about ``step_bytes`` at most.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in _parts(b, rows, step_bytes)):
            cols = of_batch(batch)
            if cols is not None:
                arrays = [
                    (x.cast(t) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=t))
                    for x, t in zip(cols.values(), target.types)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)
