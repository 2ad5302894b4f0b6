"""Time helpers, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text with offset; the fraction is left out when it is zero."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fine = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(fine)


def epoch_floor(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned cell of `seconds` that holds `ts`."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))
