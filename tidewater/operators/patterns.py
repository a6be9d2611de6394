"""Patterns over the rows of a key in order of time: a chain of steps, compiled to an automaton.

    Pattern("entry", "last_page_id is null").next("second", "true").within(10_000)

Every row that meets the first step's condition begins a match. ``next`` asks the very next row of the key to meet a
condition, and the match is dropped if it doesn't; ``followed_by`` waits for the first later row that does. A match whose
next step has not come in less than ``within`` milliseconds after its first row is a timeout.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Output of the automaton: kind is match or timeout, rows are those of the steps that were met.
FOUND = "key string, kind string, started long, rows array<string>"


@dataclass(frozen=True)
class Pattern:
    """Steps as (name, condition in SQL, strict); a window in milliseconds."""

    first: str
    condition: str
    further: tuple[tuple[str, str, bool], ...] = ()
    window_ms: int = 0

    def next(self, name: str, condition: str) -> Pattern:
        return replace(self, further=(*self.further, (name, condition, True)))

    def followed_by(self, name: str, condition: str) -> Pattern:
        return replace(self, further=(*self.further, (name, condition, False)))

    def within(self, milliseconds: int) -> Pattern:
        return replace(self, window_ms=milliseconds)

    @property
    def names(self) -> list[str]:
        return [self.first, *[n for n, _, _ in self.further]]

    def met(self) -> Column:
        """Bit n of a number says whether a row meets the condition of step n; null conditions are not met."""
        conditions = [self.condition, *[c for _, c, _ in self.further]]
        bits = [F.when(F.expr(c), F.lit(1 << n)).otherwise(F.lit(0)) for n, c in enumerate(conditions)]
        return sum(bits[1:], bits[0]).cast("int")

    def checked(self) -> Pattern:
        if not self.further or self.window_ms <= 0 or len(self.further) > 30:
            raise ValueError("a pattern has from 2 to 31 steps and a window")
        return self


class Automaton:
    """The matches of one key that are under way, by the number of steps that they have met.

    Each is (time of its first row, rows so far). Those that wait for one step move on together, so each queue is in
    order of time, and the work of a row is that of its steps and of the matches that it moves or ends.
    """

    def __init__(self, pattern: Pattern, waiting: list[list[tuple[int, list[str]]]] | None = None):
        self.strict, self.window = [s for _, _, s in pattern.further], pattern.window_ms
        self.waiting = [deque(w) for w in waiting or [[]] * len(self.strict)]

    def expired(self, now: int) -> Iterator[tuple[str, int, list[str]]]:
        """Timeouts of all that began a window or more before ``now``."""
        for queue in self.waiting:
            while queue and now - queue[0][0] >= self.window:
                yield ("timeout", *queue.popleft())

    def feed(self, at: int, met: int, row: str, begins: bool = True) -> Iterator[tuple[str, int, list[str]]]:
        """What the key's next row ends; rows come in order of time."""
        yield from self.expired(at)
        last = len(self.strict) - 1
        for n in range(last, -1, -1):  # from the end, so that a row is one step of a match at most
            queue = self.waiting[n]
            if not queue:
                continue
            if met >> n + 1 & 1:
                while queue:
                    started, rows = queue.popleft()
                    if n == last:
                        yield "match", started, [*rows, row]
                    else:
                        self.waiting[n + 1].append((started, [*rows, row]))
            elif self.strict[n]:
                queue.clear()
        if begins and met & 1:
            self.waiting[0].append((at, [row]))

    def first_start(self) -> int | None:
        return min((q[0][0] for q in self.waiting if q), default=None)


def keyed_rows(rows: DataFrame, pattern: Pattern, key: str, at: str, tie: Column) -> DataFrame:
    """key, at, tie, met and row (as JSON): what the automaton reads. Rows without key or time take no part."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    named = rows.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), tie.alias("tie"), pattern.met().alias("met"), row.alias("row"))
    return named.where("key is not null and at is not null")


def find_pattern(rows: DataFrame, pattern: Pattern, *, key: str, at: str = "ts", tie: list[str] = ()) -> DataFrame:
    """key, kind, started and rows of every match and timeout in a batch, whose end is the end of all windows.

    ``rows`` are those of the steps met, in order, as structs of the input's columns. Rows come in order of ``at`` and ``tie``.

    Time falls into buckets as wide as the window. A row is sent to its own bucket, where it may begin a match, and to the
    one before, where it only goes on with what began there: a key with a third of all rows is spread over time, and a
    task reads its buckets as a sorted stream.
    """
    window = pattern.checked().window_ms
    named = keyed_rows(rows, pattern, key, at, F.struct(F.lit(0).alias("none"), *tie))
    bucket = F.floor(F.col("at") / F.lit(window))
    sent = named.withColumn("sent", F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("begins")), F.struct((bucket - 1).alias("bucket"), F.lit(False).alias("begins")))))
    dealt = sent.select("key", "sent.bucket", "at", "tie", "sent.begins", "met", "row").repartition("key", "bucket").sortWithinPartitions("key", "bucket", "at", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, machine = None, None
        end = float("inf")
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5)]
            for name, part, time, begins, met, row in zip(*columns, strict=True):
                if (name, part) != group:
                    if machine is not None:
                        out += [(group[0], *x) for x in machine.expired(end)]
                    group, machine = (name, part), Automaton(pattern)
                out += [(name, *x) for x in machine.feed(time, met, row, begins)]
            yield _table(out)
        if machine is not None:
            yield _table([(group[0], *x) for x in machine.expired(end)])

    found = dealt.select("key", "bucket", "at", "begins", "met", "row").mapInArrow(run, FOUND)
    return typed(found, rows)


def _table(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "kind", "started", "rows"])


def typed(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The automaton's output with rows as structs of the input's columns."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return found.withColumn("rows", F.transform("rows", lambda r: F.from_json(r, schema)))
