"""Debouncing: of each key's events, those that come at least so long after the last *accepted* one.

Which events are accepted follows from the one accepted last, so a key's events are a walk.  In batch the walk is cut:
events are split by (key, stretch of time), and each stretch works out by itself, for every event that may be the first
accepted one in it, which one would be the last.  These few rows are composed along a key's stretches, and then each
stretch, told where it is entered, gives its accepted events.  A hot key is spread over its stretches, however steady it
is.  In a stream the last accepted time is the state of a key.

Defined results: events with a null key or time are left out; of events at one time one is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, in parts that never split a group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(key)
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        at = int(np.flatnonzero(changed)[-1]) if changed.any() else 0  # the last group may go on
        is_new = held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        if held and (at or is_new):
            whole = [*held, batch.slice(0, at)] if at else held
            yield pa.Table.from_batches(whole)
            held = []
        elif at:
            yield pa.Table.from_batches([batch.slice(0, at)])
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group."""
    changed = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(changed)


def _walk(times: np.ndarray, group: np.ndarray, quiet: int, stretch: int) -> np.ndarray:
    """Of each event the next one that would be accepted after it in its group, or itself; times count from the stretch."""
    placed = group * (stretch + quiet + 1) + times
    after = np.searchsorted(placed, placed + quiet, side="left")
    ends = np.searchsorted(group, group, side="right")
    return np.where(after < ends, after, np.arange(len(times)))


def debounced(events: DataFrame, key: str, ts: str, quiet_ms: int = 200, stretch_s: int = 3600) -> DataFrame:
    """``(key, ts)`` of accepted events."""
    quiet = quiet_ms * 1000
    stretch = max(stretch_s * 1_000_000, quiet)
    at = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).distinct()
    at = at.withColumn("s", F.floor(F.col("t") / stretch))
    kind = events.schema[key].dataType.simpleString()

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch the events that may be its first accepted ones, and for each the last accepted one.

        The former are its first event, all less than ``quiet`` behind its start, and the first one later than those.
        """
        for table in _whole_groups(batches, ["k", "s"]):
            group, t = _numbers(table, ["k", "s"]), table.column("t").to_numpy()
            times = t - table.column("s").to_numpy() * stretch
            last = _walk(times, group, quiet, stretch)
            while not np.array_equal(further := last[last], last):
                last = further
            is_new = np.append(True, group[1:] != group[:-1])
            late = times >= quiet
            may = is_new | ~late | late & np.append(True, ~late[:-1] | is_new[1:])
            yield pa.RecordBatch.from_arrays([*(table.column(c).filter(pa.array(may)).combine_chunks() for c in ("k", "s")), pa.array(t[may]), pa.array(t[last[may]])], ["k", "s", "first", "last"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where each stretch of a key is entered, given where the one before was left."""
        held, last, done = None, None, None
        for batch in batches:
            rows: list[tuple] = []
            for k, s, first, exit_at in zip(*(batch.column(c).to_pylist() for c in ("k", "s", "first", "last"))):
                if k != held:
                    held, last, done = k, None, None
                if s != done and (last is None or first >= last + quiet):
                    rows.append((k, s, first))
                    last, done = exit_at, s
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field("k").type, pa.int64(), pa.int64()))], ["k", "s", "entry"])

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["k", "s"]):
            group, t = _numbers(table, ["k", "s"]), table.column("t").to_numpy()
            after = _walk(t - table.column("s").to_numpy() * stretch, group, quiet, stretch).tolist()
            kept = []
            for i in np.flatnonzero(t == table.column("entry").to_numpy()).tolist():
                kept.append(i)
                while after[i] != i:
                    i = after[i]
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([table.column("k").take(at).combine_chunks(), pa.array(t[kept] if kept else [], pa.int64())], ["k", "t"])

    walks = at.repartition("k", "s").sortWithinPartitions("k", "s", "t").mapInArrow(exits, f"k {kind}, s bigint, first bigint, last bigint")
    entries = walks.repartition("k").sortWithinPartitions("k", "s", "first").mapInArrow(entered, f"k {kind}, s bigint, entry bigint")
    both = at.join(entries, ["k", "s"]).select("k", "s", "t", "entry")
    out = both.repartition("k", "s").sortWithinPartitions("k", "s", "t").mapInArrow(accepted, f"k {kind}, t bigint")
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").cast(events.schema[ts].dataType).alias(ts))


def stream_debounced(events: DataFrame, key: str, ts: str, quiet_ms: int = 200, ttl: str = "10 minutes") -> DataFrame:
    """The same over a stream; state of keys without events for ``ttl`` of event time is dropped.

    The stream gets a watermark of ``ttl``; later events are dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def accept(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(t for b in batches for t in b["t"].tolist())
        kept = []
        for t in times:
            if last is None or t - last >= quiet_ms * 1000:
                kept.append(t)
                last = t
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs() + 1) + quiet_ms)
        if kept:
            yield pd.DataFrame({key: [k[0]] * len(kept), "t": kept})

    marked = events.where(F.col(key).isNotNull()).withWatermark(ts, ttl).select(key, ts, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"))
    kind = events.schema[key].dataType.simpleString()
    out = marked.groupBy(key).applyInPandasWithState(accept, f"{key} {kind}, t bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("t").alias(ts))
