"""Tumbling, sliding and session windows, on tables and on streams.

On a stream the windows are Spark's own over a watermarked column. On a table
sliding and session windows first collapse the rows to small time cells with a
hash aggregate, which has a map-side step: a key or a window holding a large
share of all rows is reduced before anything is shuffled.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.time import epoch_floor
from millrace.schemas import DEFAULT_WINDOW_SECS

EVENT_TIME = "publish_time"
BY_TYPE = ("event_type",)
BY_TYPE_AND_USER = ("event_type", "user_id")


@dataclass(frozen=True)
class Tumbling:
    size: int = DEFAULT_WINDOW_SECS


@dataclass(frozen=True)
class Sliding:
    size: int
    slide: int


@dataclass(frozen=True)
class Session:
    gap: int


def assign_window(
    events: DataFrame, size: int = DEFAULT_WINDOW_SECS, event_time: str = EVENT_TIME
) -> DataFrame:
    """Each row with the tumbling window it falls in, as `window` (start, end)."""
    return events.withColumn("window", F.window(event_time, f"{size} seconds"))


def tumbling_counts(
    events: DataFrame,
    size: int = DEFAULT_WINDOW_SECS,
    keys: Sequence[str] = BY_TYPE,
    event_time: str = EVENT_TIME,
    lateness: str | None = None,
) -> DataFrame:
    """Events per window and key. `lateness` sets the watermark of a stream."""
    window = F.window(event_time, f"{size} seconds")
    return _count(_watermarked(events, event_time, lateness), window, keys)


def sliding_counts(
    events: DataFrame,
    size: int,
    slide: int,
    keys: Sequence[str] = BY_TYPE,
    event_time: str = EVENT_TIME,
    lateness: str | None = None,
    panes: bool = False,
) -> DataFrame:
    """Events per overlapping window and key.

    On a table each row is counted once, into a pane no longer than the slide;
    the panes, not the rows, are then copied into the windows they belong to.
    On a stream every row is copied into its windows, unless `panes`: then an
    aggregate of panes is followed by one of windows, which holds a row for each
    pane and window instead of taking each event size / slide times. A window is
    given out at the same watermark; an event that is later than `lateness` is
    dropped with its pane, also from windows that are still open.
    """
    window = (f"{size} seconds", f"{slide} seconds")
    if events.isStreaming and panes:
        counted = _watermarked(events, event_time, lateness).groupBy(
            F.window(event_time, f"{math.gcd(size, slide)} seconds").alias("_pane"), *keys
        ).agg(F.count("*").alias("_rows"))
        return _flat(
            counted.groupBy(F.window(F.window_time("_pane"), *window).alias("_window"), *keys).agg(
                F.sum("_rows").alias("event_count")),
            keys,
        )
    if events.isStreaming:
        watermarked = _watermarked(events, event_time, lateness)
        return _count(watermarked, F.window(event_time, *window), keys)
    panes = (
        events.where(F.col(event_time).isNotNull())
        .groupBy(epoch_floor(event_time, math.gcd(size, slide)).alias("_pane"), *keys)
        .agg(F.count("*").alias("_rows"))
    )
    return _flat(
        panes.groupBy(F.window("_pane", *window).alias("_window"), *keys).agg(
            F.sum("_rows").alias("event_count")
        ),
        keys,
    )


def session_counts(
    events: DataFrame,
    gap: int,
    keys: Sequence[str] = ("user_id",),
    event_time: str = EVENT_TIME,
    lateness: str | None = None,
) -> DataFrame:
    """Events per session; events up to `gap` seconds apart share a session."""
    return _sessions(events, F.lit(gap), gap, keys, event_time, lateness)


def session_counts_by_type(
    events: DataFrame,
    gaps: Mapping[str, int],
    default_gap: int,
    keys: Sequence[str] = ("user_id",),
    event_time: str = EVENT_TIME,
    lateness: str | None = None,
) -> DataFrame:
    """Sessions whose patience depends on the type of the event just seen."""
    gap = _per_type(gaps, F.lit(default_gap))
    shortest = min([default_gap, *gaps.values()])
    return _sessions(events, gap, shortest, keys, event_time, lateness)


def counts_by_strategy(
    events: DataFrame,
    strategies: Mapping[str, Tumbling | Sliding | Session],
    event_time: str = EVENT_TIME,
    lateness: str | None = None,
    session_keys: Sequence[str] = BY_TYPE_AND_USER,
) -> DataFrame:
    """Window counts per type, each type with a windowing strategy of its own.

    Grid windows (tumbling, sliding) count per type. Sessions are per
    `session_keys`, which must begin with the type; the further keys are columns
    of the result, null for grid windows. On a table all strategies share one
    pass over the rows and one exchange of their cells. On a stream each distinct
    strategy is an aggregate of its own, over its own event types, and all share one
    watermark: it follows the rows of every type, so a type that falls silent holds
    back no other.
    """
    if session_keys[0] != "event_type":
        raise ValueError("session keys begin with event_type")
    if not events.isStreaming:
        return _counts_in_one_pass(events, strategies, event_time, session_keys)
    extra = list(session_keys[1:])
    columns = ["window_start", "window_end", "event_type", *extra, "event_count"]
    types_of: dict[Tumbling | Sliding | Session, list[str]] = {}
    for event_type, strategy in strategies.items():
        types_of.setdefault(strategy, []).append(event_type)
    marked = _held(_watermarked(events, event_time, lateness))
    parts = []
    for strategy, types in types_of.items():
        rows = marked.where(F.col("_held").isin(types))
        if isinstance(strategy, Session):
            part = session_counts(rows, strategy.gap, session_keys, event_time)
        elif isinstance(strategy, Sliding):
            part = sliding_counts(rows, strategy.size, strategy.slide, BY_TYPE, event_time)
        else:
            part = tumbling_counts(rows, strategy.size, BY_TYPE, event_time)
        for name in extra:
            if name not in part.columns:
                part = part.withColumn(name, F.lit(None).cast(events.schema[name].dataType))
        parts.append(part.select(columns))
    return reduce(DataFrame.unionByName, parts)


def _held(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The rows with their event type once more, as `_held`, from a generator.

    The optimizer moves no filter through a generator: one on `_held` stays
    above what comes before it, such as a watermark or a shared aggregate. Nor does
    it leave out a column that the generator reads: with the columns `also`, which
    go through it, an exchange below is the same for all that read it, and is made once.
    """
    again = F.inline(F.array(F.struct(
        F.col("event_type").alias("_held"), *[F.col(c).alias(f"_held_{c}") for c in also])))
    return rows.select("*", again).drop(*[f"_held_{c}" for c in also])


def closed_at(query: StreamingQuery) -> dt.datetime:
    """The watermark at which a stream that was run to its end has stopped."""
    marks = [p["eventTime"]["watermark"] for p in query.recentProgress
             if p["eventTime"] and "watermark" in p["eventTime"]]
    mark = max(marks, default="1970-01-01T00:00:00.000Z")
    return dt.datetime.fromisoformat(mark.replace("Z", "+00:00"))


def with_open_windows(
    appended: DataFrame, counted: DataFrame, closed: dt.datetime
) -> DataFrame:
    """All windows after a stream was run to its end.

    `appended` are the windows the stream gave out, which end by the watermark
    `closed`; those that were still open are taken from `counted`, the same
    counts over the stored messages. Nothing is counted twice, as a window is
    either closed or open.
    """
    # The bound is laid on finished windows; it must not reach the rows.
    bounds = F.inline(F.array(F.struct(F.col("window_end").alias("_end"))))
    still_open = counted.select("*", bounds).where(F.col("_end") > F.lit(closed)).drop("_end")
    return appended.unionByName(still_open)


def late_rows(appended: DataFrame, counted: DataFrame, closed: dt.datetime) -> DataFrame:
    """Closed windows with the rows that came too late for the stream.

    Per window and key: `event_count` as the stream gave it out (0 if not at
    all), `late_count` that is missing there, and the reason.
    """
    keys = [c for c in appended.columns if c != "event_count"]
    done = counted.withColumn("late_count", F.col("event_count")).withColumn(
        "event_count", F.lit(0).cast("long"))
    given = appended.withColumn("late_count", -F.col("event_count"))
    both = done.where(F.col("window_end") <= F.lit(closed)).unionByName(given).groupBy(*keys).agg(
        F.sum("event_count").alias("event_count"), F.sum("late_count").alias("late_count"))
    return both.withColumn("reason", F.when(F.col("late_count") > 0, "behind_watermark"))


def _counts_in_one_pass(
    events: DataFrame,
    strategies: Mapping[str, Tumbling | Sliding | Session],
    event_time: str,
    session_keys: Sequence[str],
) -> DataFrame:
    """Rows to cells once; then cells of grid types to windows, the others to sessions."""
    gaps = {t: s.gap for t, s in strategies.items() if isinstance(s, Session)}
    grids = {
        t: (s.size, s.slide if isinstance(s, Sliding) else s.size)
        for t, s in strategies.items() if not isinstance(s, Session)
    }
    # A cell divides every window and is no longer than any gap.
    grid = math.gcd(*[n for pair in grids.values() for n in pair])
    shortest = min(gaps.values(), default=grid)
    width = math.gcd(grid, shortest) if grid > shortest else grid or shortest
    extra = list(session_keys[1:])
    rows = events.where(F.col("event_type").isin(list(strategies)))
    # Only sessions look at the further keys.
    is_session = F.col("event_type").isin(list(gaps))
    rows = rows.select("event_type", event_time, *[
        F.when(is_session, F.col(k)).alias(k) for k in extra])
    cells = _cells(rows, width, _per_type(gaps, F.lit(0)), session_keys, event_time)
    cells = _held(cells, ["_from", "_to", "_rows"])

    def starts(size: int, slide: int) -> Column:
        at, step = F.unix_micros("_cell"), slide * 1_000_000
        last = at - F.pmod(at, F.lit(step))
        before = at - size * 1_000_000
        return F.sequence(last, before - F.pmod(before, F.lit(step)) + step, F.lit(-step))

    parts = []
    if grids:
        begins = _per_type({t: starts(*g) for t, g in grids.items()}, F.array().cast("array<bigint>"))
        size = _per_type({t: F.lit(n * 1_000_000) for t, (n, _) in grids.items()}, F.lit(None))
        placed = cells.where(F.col("_held").isin(list(grids))).select(
            "event_type", *extra, "_rows", F.explode(begins).alias("_begin"))
        counted = placed.groupBy("event_type", *extra, "_begin").agg(F.sum("_rows").alias("event_count"))
        parts.append(counted.select(
            F.timestamp_micros("_begin").alias("window_start"),
            F.timestamp_micros(F.col("_begin") + size).alias("window_end"),
            "event_type", *extra, "event_count"))
    if gaps:
        own = cells.where(F.col("_held").isin(list(gaps))).drop("_held")
        parts.append(_merged(own, session_keys))
    return reduce(DataFrame.unionByName, parts)


def _per_type(values: Mapping[str, Column | int], default: Column) -> Column:
    """The value that belongs to the row's event type."""
    chosen = default
    for event_type, value in values.items():
        value = F.lit(value) if isinstance(value, int) else value
        chosen = F.when(F.col("event_type") == event_type, value).otherwise(chosen)
    return chosen


def _watermarked(events: DataFrame, event_time: str, lateness: str | None) -> DataFrame:
    return events.withWatermark(event_time, lateness) if lateness is not None else events


def _flat(windowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return windowed.select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        *keys,
        "event_count",
    )


def _count(events: DataFrame, window: Column, keys: Sequence[str]) -> DataFrame:
    counted = events.groupBy(window.alias("_window"), *keys).agg(
        F.count("*").alias("event_count")
    )
    return _flat(counted, keys)


def _sessions(
    events: DataFrame,
    gap: Column,
    shortest_gap: int,
    keys: Sequence[str],
    event_time: str,
    lateness: str | None,
) -> DataFrame:
    if shortest_gap <= 0:
        raise ValueError("a session gap must be positive")
    if events.isStreaming:
        window = F.session_window(event_time, F.make_interval(secs=gap)).alias("_window")
        counted = (
            _watermarked(events, event_time, lateness)
            .groupBy(window, *keys)
            .agg(F.count("*").alias("event_count"))
        )
        # A session's bounds are known only after merging, but the optimizer
        # takes them for a plain grouping key and would push a later filter on
        # them down to the rows. It pushes none through a generator.
        bounds = F.struct(
            F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end")
        )
        return counted.select(F.inline(F.array(bounds)), *keys, "event_count")
    return _merged(_cells(events, shortest_gap, gap, keys, event_time), keys)


def _merged(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions of cells."""
    return (
        _numbered_sessions(cells, keys)
        .groupBy(*keys, "_session")
        .agg(
            F.timestamp_micros(F.min("_from")).alias("window_start"),
            F.timestamp_micros(F.max("_to")).alias("window_end"),
            F.sum("_rows").alias("event_count"),
        )
        .select("window_start", "window_end", *keys, "event_count")
    )


def _cells(
    events: DataFrame, width: int, gap: Column, keys: Sequence[str], event_time: str
) -> DataFrame:
    """Rows per key and epoch-aligned cell, with the time they reach.

    Rows in one cell no longer than the shortest gap are always in the same
    session. So a cell is a session in small, and the number of cells of a key
    is bounded by the time it spans, not by its rows.
    """
    micros = F.unix_micros(event_time)
    return (
        events.where(F.col(event_time).isNotNull())
        .groupBy(epoch_floor(event_time, width).alias("_cell"), *keys)
        .agg(
            F.min(micros).alias("_from"),
            F.max(micros + gap.cast("bigint") * 1_000_000).alias("_to"),
            F.count("*").alias("_rows"),
        )
    )


def _numbered_sessions(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells with the number of their session within the key."""
    # A cell that starts after everything before it has ended opens a session.
    in_order = Window.partitionBy(*keys).orderBy("_from")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    up_to = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.max("_to").over(before) >= F.col("_from"), 0).otherwise(1)
    return cells.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(up_to))
