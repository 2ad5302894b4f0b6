"""Tumbling windows that say what came too late for them.

Spark's windowed aggregates drop rows behind the watermark without a word. Here a
window is state of its own with a timer: when the watermark passes its end its count
is given out, and every row that comes after that is given out, too, as it comes, with
the count as it would be by then. Nothing is read again to find late rows.

Spark also drops rows behind the watermark before they reach such an operator. The
watermark it is told is therefore `GRACE` behind the one that closes windows, and the
operator adds it again. A row that is later than that is lost.

Python is called once per key and window that a batch has rows of; rows come in Arrow
batches and are only counted unless they are late. What is kept is two numbers for each
window that is open, or that was closed less than `refine` seconds ago.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from millrace.schemas import DEFAULT_WINDOW_SECS
from millrace.streaming.windows import BY_TYPE, EVENT_TIME

# Ten years, in seconds.
GRACE = 3650 * 86400


def tumbling_with_late_rows(
    events: DataFrame,
    size: int = DEFAULT_WINDOW_SECS,
    lateness: int = 600,
    refine: int = 86400,
    keys: Sequence[str] = BY_TYPE,
    event_time: str = EVENT_TIME,
    row_id: str = "event_id",
) -> DataFrame:
    """A stream's windows and its late rows: kind, window_start, window_end, keys, event_count, and of a late row its id and time.

    * kind `window`: the count of a window, when the watermark (latest time seen at the
      end of the batch before, minus `lateness` seconds) has passed its end
    * kind `late`: a row that came after that; `event_count` is the window's count with
      this row and all late ones before it, null if the window was closed more than
      `refine` seconds earlier and is forgotten

    Windows still open when the stream stops are not given out. Rows without a time
    belong to no window.
    """
    start = F.unix_micros(event_time) - F.pmod(F.unix_micros(event_time), F.lit(size * 1_000_000))
    marked = events.where(F.col(event_time).isNotNull()).withWatermark(event_time, f"{lateness + GRACE} seconds")
    rows = marked.select(
        *[F.col(k) for k in keys], start.alias("_start"), F.unix_micros(event_time).alias("_time"),
        F.col(row_id).cast("string").alias("_id"), F.col(event_time).alias("_mark"))
    out = T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("_start", T.LongType()),
        *[events.schema[k] for k in keys], T.StructField("event_count", T.LongType()),
        T.StructField("_id", T.StringType()), T.StructField("_time", T.LongType())])
    found = rows.groupBy(*keys, "_start").transformWithState(
        _processor(out.fieldNames(), len(keys), size, refine), out, "Append", "EventTime")
    return found.select(
        "kind", F.timestamp_micros("_start").alias("window_start"),
        F.timestamp_micros(F.col("_start") + size * 1_000_000).alias("window_end"), *keys, "event_count",
        F.col("_id").alias(row_id), F.timestamp_micros("_time").alias(event_time))


def _processor(names: Sequence[str], n_keys: int, size: int, refine: int) -> StatefulProcessor:
    # A class within a function is sent to the tasks whole: they need not have this package.
    grace, made = GRACE * 1000, Row(*names)

    class Windows(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("counts", "given long, late long")

        def handleInputRows(self, key, rows, timerValues):
            keys, start = list(key)[:n_keys], key[n_keys]
            end = start // 1000 + size * 1000
            mark = timerValues.getCurrentWatermarkInMs()
            closed = mark > 0 and mark + grace >= end
            known = self.state.exists()
            given, late = self.state.get() if known else (0, 0)
            if not closed:
                if not known:
                    self.handle.registerTimer(end - grace)
                self.state.update((given + sum(1 for _ in rows), late))
                return
            if not known and mark + grace < end + refine * 1000:
                # No row of it came in time; it is remembered like others.
                known = True
                self.handle.registerTimer(end + refine * 1000 - grace)
            for row in rows:
                late += 1
                yield made("late", start, *keys, given + late if known else None, row["_id"], row["_time"])
            if known:
                self.state.update((given, late))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            keys, start = list(key)[:n_keys], key[n_keys]
            end = start // 1000 + size * 1000
            forget = True
            if expiredTimerInfo.getExpiryTimeInMs() == end - grace:
                yield made("window", start, *keys, self.state.get()[0], None, None)
                if refine > 0 and timerValues.getCurrentWatermarkInMs() + grace < end + refine * 1000:
                    self.handle.registerTimer(end + refine * 1000 - grace)
                    forget = False
            if forget:
                self.state.clear()

        def close(self) -> None:
            pass

    return Windows()
