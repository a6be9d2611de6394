"""Times as the jobs carry them: epoch milliseconds and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of a year of 365 days, in which ages are counted.
YEAR_MS = 31_536_000_000
SECONDS = "yyyy-MM-dd HH:mm:ss"


def timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def epoch_date(ms: Column, zone: str | None = None, pattern: str = "yyyyMMdd") -> Column:
    """The day of epoch milliseconds, in the session's time zone or another."""
    at = F.timestamp_millis(ms)
    return F.date_format(at if zone is None else F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz")), pattern)


def text_millis(text: Column, zone: str | None = None) -> Column:
    """Epoch milliseconds of text like 2024-01-31 08:00:00; null where it is none."""
    if zone is None:
        return F.unix_millis(F.try_to_timestamp(text, F.lit(SECONDS)))
    local = F.try_to_timestamp(text, F.lit(SECONDS)).cast("timestamp_ntz")
    return F.unix_millis(F.convert_timezone(F.lit(zone), F.current_timezone(), local).cast("timestamp"))


def whole_second(ms: Column) -> Column:
    """The timestamp of epoch milliseconds, cut to whole seconds."""
    return F.timestamp_seconds(F.floor(ms / 1000))


def age(birthday_ms: Column, now_ms: Column) -> Column:
    """Whole years of 365 days between two times, cut towards zero: a birthday to come gives 0 up to a year ahead."""
    return F.call_function("div", now_ms - birthday_ms, F.lit(YEAR_MS)).cast("int")


def bounds(window: str = "window") -> list[Column]:
    """Start and end of a window as text."""
    return [F.date_format(f"{window}.start", SECONDS).alias("stt"), F.date_format(f"{window}.end", SECONDS).alias("edt")]


def stamped(rows: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """rows with ``ts``, when they were made: the clock of the run in milliseconds, or a time that the caller gives."""
    return rows.withColumn("ts", F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms)
