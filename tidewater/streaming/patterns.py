"""Patterns and visitors' days on streams: state of a key in a state store, timers, time to live."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewater.functions.times import epoch_date
from tidewater.operators.logs import entry_page
from tidewater.operators.patterns import FOUND, Automaton, Pattern, find_pattern, keyed_rows, typed
from tidewater.operators.visits import BOUNCE_MS, bounce_pattern
from tidewater.session import shared_folder
from tidewater.sources import files
from tidewater.streaming.runs import finish_batches

DAY_MS = 86_400_000


def _tie(columns: list[str]) -> Column:
    """The values of columns as a JSON text that _place() reads; nulls come first."""
    return F.to_json(F.struct(F.lit(0).alias("none"), *columns), {"ignoreNullFields": "false"})


def _place(at: int, tie: str) -> tuple:
    return at, *((v is not None, v) for v in json.loads(tie).values())


class PatternProcessor(StatefulProcessor):
    """Rows wait until the watermark has passed them, then go through the key's automaton in order of time."""

    def __init__(self, pattern: Pattern):
        self.pattern = pattern

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at long, tie string, met int, row string")
        self.matches = handle.getValueState("matches", "waiting string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Gives nothing yet: rows are judged when their time has passed."""
        times = set()
        for batch in rows:
            self.rows.appendList(list(batch[["at", "tie", "met", "row"]].itertuples(index=False, name=None)))
            times |= set(batch["at"].tolist())
        if times:
            # one timer a batch is enough: it runs when the watermark is past the first row, and sets the next
            self.handle.registerTimer(int(min(times)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self.rows.get()), key=lambda r: _place(r[0], r[1])) if self.rows.exists() else []
        machine = Automaton(self.pattern, json.loads(self.matches.get()[0]) if self.matches.exists() else None)
        out = []
        ripe = [r for r in held if r[0] < now]
        for at, _, met, row in ripe:
            out += machine.feed(at, met, row)
        out += machine.expired(now - 1)  # the watermark is past the window's end
        rest = held[len(ripe) :]
        if ripe:
            self.rows.put(rest) if rest else self.rows.clear()
        waiting = [list(q) for q in machine.waiting]
        if any(waiting):
            self.matches.update((json.dumps(waiting),))
        elif self.matches.exists():
            self.matches.clear()
        first = machine.first_start()
        due = [rest[0][0]] if rest else []
        due += [first + self.pattern.window_ms] if first is not None else []
        if due:
            self.handle.registerTimer(int(min(due)))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["key", "kind", "started", "rows"])

    def close(self) -> None:
        pass


def pattern_stream(rows: DataFrame, pattern: Pattern, *, key: str, at: str = "ts", tie: list[str] = (), delay: str = "0 seconds") -> DataFrame:
    """find_pattern() of a stream: key, kind, started, rows.

    A row counts once the watermark, ``delay`` behind the latest time, is past it; late rows are dropped. What is under
    way when the stream ends has neither matched nor timed out. State holds a key's rows of the delay and its matches.
    """
    named = keyed_rows(rows, pattern.checked(), key, at, _tie(list(tie)))
    timed = named.withColumn("time", F.timestamp_millis("at")).withWatermark("time", delay)
    found = timed.groupBy("key").transformWithStateInPandas(PatternProcessor(pattern), FOUND, "append", "eventTime")
    return typed(found, rows)


def bounces_of_stream(pages: DataFrame, *, timeout_ms: int = BOUNCE_MS, delay: str = "0 seconds") -> DataFrame:
    """The entry pages among timeouts of the bounce pattern, with the columns of pages."""
    found = pattern_stream(pages, bounce_pattern(timeout_ms), key="common.mid", delay=delay)
    return found.where("kind = 'timeout'").select(F.col("rows")[0].alias("row")).select("row.*")


def finish_pattern(
    rows: DataFrame, pattern: Pattern, name: str, *, key: str, at: str = "ts", tie: list[str] = (), delay_ms: int = 0, pick: Callable[[DataFrame], DataFrame] = lambda found: found,
    spent: tuple[str, ...] = (), state: str | None = None, out: str | None = None,
) -> DataFrame:
    """Works off a stream through pattern_stream(), but by batches of tables: gives ``pick`` of its rows, from files in ``out``.

    A call of a function for every key of a batch is most of the work where keys have few rows. Here a batch's rows go through
    find_pattern() with those that an open window needs, which wait in Parquet files; what the watermark passes in this batch
    is given, what it had passed before is known. ``at`` holds whole milliseconds. The folders in ``spent`` are deleted then,
    and so is the state, unless the caller names a folder for it (and for the results, which add up).
    """
    spark, window = rows.sparkSession, pattern.checked().window_ms
    kept, target = state or shared_folder(spark, f"{name}-state"), out or shared_folder(spark, name)
    root, time = f"{kept}-open", F.col(at).cast("long")
    ended = lambda: reduce(lambda c, part: c[part], at.split("."), F.element_at("rows", -1)).cast("long")
    find = lambda known: find_pattern(known, pattern, key=key, at=at, tie=list(tie))

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mark = json.loads(files.read_text(session, f"{root}/{batch_id - 1:012d}.json"))["watermark"] if batch_id else None
        fresh = batch.where(F.col(key).isNotNull() & (time.isNotNull() if mark is None else time > mark))
        folder = f"{root}/{batch_id}"
        fresh.write.mode("overwrite").parquet(f"{folder}/new")
        read = lambda path: session.read.schema(rows.schema).parquet(path)
        known = read(f"{folder}/new")
        latest = known.agg(F.max(time)).first()[0]
        after = max((t for t in (mark, None if latest is None else latest - delay_ms) if t is not None), default=None)
        known = known.unionByName(read(f"{root}/{batch_id - 1}/open")) if batch_id else known
        # a match is known when the watermark is past its last row, a timeout when it is past the window's end
        known_at = F.when(F.col("kind") == "match", ended()).otherwise(F.col("started") + window)
        found = find(known.where(F.lit(False) if after is None else time < after))
        found = found.where((known_at < (0 if after is None else after)) & (F.lit(True) if mark is None else known_at >= mark))
        pick(found).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        known.where(F.lit(True) if after is None else time >= after - window).write.mode("overwrite").parquet(f"{folder}/open")
        files.remove(session, f"{folder}/new", f"{root}/{batch_id - 2}")
        files.write_text(session, f"{root}/{batch_id:012d}.json", json.dumps({"watermark": after}))

    finish_batches(rows, write, name, state=kept)
    files.remove(spark, *spent, *([] if state else [kept, root]))
    shown = pick(find(spark.createDataFrame([], rows.schema))).schema
    return spark.read.schema(shown).option("recursiveFileLookup", "true").parquet(target) if files.exists(spark, target) else spark.createDataFrame([], shown)


def finish_bounces(pages: DataFrame, name: str, *, timeout_ms: int = BOUNCE_MS, delay_ms: int = 0, **how) -> DataFrame:
    """Works off a stream of pages; gives bounces_of_stream() by way of finish_pattern()."""
    first = lambda found: found.where("kind = 'timeout'").select(F.col("rows")[0].alias("row")).select("row.*")
    return finish_pattern(pages, bounce_pattern(timeout_ms), name, key="common.mid", delay_ms=delay_ms, pick=first, **how)


class DayProcessor(StatefulProcessor):
    """The first page of each visitor and day; the visitor's last day lives for ``ttl_ms`` of the clock."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.day = handle.getValueState("day", "day string", self.ttl_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.day.update((str(initialState["day"].iloc[0]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.day.get()[0] if self.day.exists() else None
        known, out = last, []
        new = [r for batch in rows for r in batch[["at", "tie", "day", "row"]].itertuples(index=False, name=None)]
        for at, _, day, row in sorted(new, key=lambda r: _place(r[0], r[1])):
            if day != last:
                last = day
                out.append((key[0], at, row))
        if last != known:
            self.day.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["mid", "ts", "row"])

    def close(self) -> None:
        pass


def unique_visits_by_clock(
    pages: DataFrame, *, zone: str | None = None, ttl_ms: int = DAY_MS, tie: list[str] = (), initial: DataFrame | None = None
) -> DataFrame:
    """Entry pages of another day than the visitor's last one, as pages came in, with the columns of pages.

    Days are those of ``zone`` (the session's, if none). A visitor's day is forgotten when it was set longer ago than ttl_ms by
    the clock. ``initial`` (mid, day) says which days are known when the stream first starts, say from a batch before it;
    see known_days(). A run that is to end with its input has to be started by runs.finish(clock=True).
    """
    entries = pages.where(entry_page()).where("common.mid is not null and ts is not null")
    named = entries.select(
        F.col("common.mid").alias("mid"), F.col("ts").alias("at"), _tie(list(tie)).alias("tie"), epoch_date(F.col("ts"), zone).alias("day"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in pages.columns])).alias("row"),
    )
    before = None if initial is None else initial.select("mid", "day").groupBy("mid")
    found = named.groupBy("mid").transformWithStateInPandas(DayProcessor(ttl_ms), "mid string, ts long, row string", "append", "processingTime", before)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return found.select(F.from_json("row", schema).alias("row")).select("row.*")


def last_days(pages: DataFrame, *, zone: str | None = None) -> DataFrame:
    """mid and day of every visitor's last entry page in a batch: a state to begin a stream with."""
    entries = pages.where(entry_page()).where("common.mid is not null and ts is not null")
    return entries.groupBy(F.col("common.mid").alias("mid")).agg(F.max_by(epoch_date(F.col("ts"), zone), "ts").alias("day"))


def known_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """mid, day and forgotten (epoch milliseconds) as a run of unique_visits_by_clock() left them in its state."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "day").load()
    return held.select(F.col("key.mid").alias("mid"), F.col("value.value.day").alias("day"), F.col("value.ttlExpirationMs").alias("forgotten"))
