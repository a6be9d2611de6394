"""Keyed state of visitors on streams. Rows carry their log as text.

Visitors are dealt into a fixed number of buckets by a hash: a call of a function and its tables cost more than a visitor's
few rows, so they come once a bucket and batch. A bucket's state has a small entry for every visitor that needs one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.functions.times import epoch_date
from tidewater.operators.logs import entry_page
from tidewater.operators.visits import BOUNCE_MS

ROW = "mid string, ts long, flag string, log string"
DAY_MS = 86_400_000
BUCKETS = 1024


def _in_order(batches: Iterator[pd.DataFrame]) -> list[tuple[str, int, str, str, str]]:
    """(mid, ts, flag, log, day) of a bucket's new rows, in order of visitor, time and then of the log."""
    return sorted((mid, int(ts), flag, log, day) for b in batches for mid, ts, flag, log, day in zip(b["mid"], b["ts"], b["flag"], b["log"], b["day"], strict=True))


def _rows(rows: list[tuple[str, int, str, str]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["mid", "ts", "flag", "log"])


def _held(state: GroupState) -> Iterator[tuple]:
    return zip(*state.get, strict=True) if state.exists else iter(())


def _hold(state: GroupState, entries: list[tuple]) -> None:
    if entries:
        state.update(tuple(map(list, zip(*entries, strict=True))))
    elif state.exists:
        state.remove()


def new_visitors(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """flag is is_new; the day of a visitor's first claim stays, and claims of another day become 0."""
    first, out = dict(_held(state)), []
    for mid, ts, flag, log, day in _in_order(batches):
        if flag == "1":
            flag = "1" if day == first.setdefault(mid, day) else "0"
        out.append((mid, ts, flag, log))
    _hold(state, list(first.items()))
    yield _rows(out)


def unique_visits(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entry pages of another day than the visitor's last one.

    The day is forgotten when the watermark is a day past it: whatever comes then is of another day. (In time of the
    clock, as a stream that never ends might forget, one that ends with its input would wait for ever.)
    """
    known, out = {mid: (day, until) for mid, day, until in _held(state)}, []
    now, met = state.getCurrentWatermarkMs(), set()
    for mid, ts, flag, log, day in [] if state.hasTimedOut else _in_order(batches):
        if mid not in known or day != known[mid][0]:
            out.append((mid, ts, flag, log))
        known[mid] = day, max(ts, now) + DAY_MS
        met.add(mid)
    kept = [(mid, day, until) for mid, (day, until) in known.items() if mid in met or until > now]
    _hold(state, kept)
    if kept:
        state.setTimeoutTimestamp(min(until for _, _, until in kept))
    yield _rows(out)


def bounces(timeout_ms: int):
    """flag is 1 for entry pages. Rows wait until the watermark is more than a timeout past them, and are judged then."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(_held(state))
        if not state.hasTimedOut:
            held += [row[:4] for row in _in_order(batches)]
        held.sort()
        ripe = state.getCurrentWatermarkMs() - timeout_ms
        ends = [*held[1:], None]
        out = [row for row, after in zip(held, ends, strict=True) if row[1] < ripe and row[2] == "1" and (after is None or after[0] != row[0] or after[1] - row[1] >= timeout_ms)]
        rest = [row for row in held if row[1] >= ripe]
        _hold(state, rest)
        if rest:
            state.setTimeoutTimestamp(min(row[1] for row in rest) + timeout_ms)
        yield _rows(out)

    return judge


def _keyed(logs: DataFrame, flag: Column, zone: str | None = None) -> DataFrame:
    return logs.where("common.mid is not null and ts is not null").select(
        F.col("common.mid").alias("mid"), "ts", flag.alias("flag"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in logs.columns])).alias("log"), F.timestamp_millis("ts").alias("at"),
        epoch_date(F.col("ts"), zone).alias("day"), F.pmod(F.xxhash64("common.mid"), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )


def new_visitor_stream(logs: DataFrame, *, zone: str | None = None) -> DataFrame:
    """mid, ts, flag (the repaired is_new) and log of every log. Days are those of ``zone``, or of the session's time zone."""
    return _keyed(logs, F.col("common.is_new"), zone).groupBy("bucket").applyInPandasWithState(new_visitors, ROW, "mid array<string>, day array<string>", "append", GroupStateTimeout.NoTimeout)


def unique_visit_stream(pages: DataFrame, *, delay: str = "0 seconds", zone: str | None = None) -> DataFrame:
    rows = _keyed(pages.where(entry_page()), F.lit("1"), zone).withWatermark("at", delay)
    return rows.groupBy("bucket").applyInPandasWithState(unique_visits, ROW, "mid array<string>, day array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def bounce_stream(pages: DataFrame, *, timeout_ms: int = BOUNCE_MS, delay: str = "0 seconds") -> DataFrame:
    """Bounces as the watermark passes them; those within a timeout of the stream's end are still open. Late rows are dropped."""
    rows = _keyed(pages, F.when(entry_page(), F.lit("1")).otherwise(F.lit("0"))).withWatermark("at", delay)
    return rows.groupBy("bucket").applyInPandasWithState(bounces(timeout_ms), ROW, "mid array<string>, ts array<long>, flag array<string>, log array<string>", "append", GroupStateTimeout.EventTimeTimeout)
