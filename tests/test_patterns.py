"""Patterns against every way to match, on batches and streams; segmentation against every way to cut."""

import json
import math
import os
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewater.functions.segments import Segmenter, dictionary_of, segments
from tidewater.operators import patterns, visits
from tidewater.operators.patterns import Pattern
from tidewater.plans import catalog
from tidewater.streaming.patterns import bounces_of_stream, finish_bounces, finish_pattern, pattern_stream
from tidewater.streaming.runs import finish

ROWS = "k string, ts long, n int, a string"
SHAPES = [
    Pattern("x", "a = 'x'").next("y", "a = 'y'").within(10),
    Pattern("x", "a = 'x'").followed_by("y", "a = 'y'").within(10),
    Pattern("x", "a = 'x'").followed_by("y", "a = 'y'").next("z", "a in ('z', 'x')").within(25),
    Pattern("x", "a in ('x', 'y')").next("y", "a = 'y'").followed_by("z", "a = 'z'").followed_by("x", "a = 'x'").within(40),
]


def holds(condition, a):
    return a is not None and (f"'{a}'" in condition)


def by_definition(rows, pattern):
    """rows of one key in order; each row that begins is followed on its own."""
    out = []
    for i, (_, ts, n, a) in enumerate(rows):
        if not holds(pattern.condition, a):
            continue
        met, step, kind = [n], 0, "timeout"
        for _, later, m, b in rows[i + 1 :]:
            if later - ts >= pattern.window_ms:
                break
            _, condition, strict = pattern.further[step]
            if holds(condition, b):
                met.append(m)
                step += 1
                if step == len(pattern.further):
                    kind = "match"
                    break
            elif strict:
                kind = None
                break
        if kind:
            out.append((kind, ts, tuple(met)))
    return out


def made(seed, n=600, keys=3, span=1500):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"[:keys]) if rng.random() < 0.6 else "hot", rng.randint(-20, span), i, rng.choice(["x", "y", "z", None])) for i in range(n)]
    return [*rows, (None, 5, n, "x"), ("a", None, n + 1, "x")]


def expected(rows, pattern):
    keys = {r[0] for r in rows if r[0] is not None}
    return sorted((k, *x) for k in keys for x in by_definition(sorted((r for r in rows if r[0] == k and r[1] is not None), key=lambda r: (r[1], r[2])), pattern))


def read(found):
    return sorted((r.key, r.kind, r.started, tuple(x.n for x in r.rows)) for r in found.collect())


@pytest.mark.parametrize("pattern", SHAPES)
def test_batches(spark, pattern):
    rows = made(1)
    df = spark.createDataFrame(rows, ROWS)
    assert read(patterns.find_pattern(df, pattern, key="k", tie=["n"])) == expected(rows, pattern) != []
    assert patterns.find_pattern(df.limit(0), pattern, key="k").collect() == []


def test_streams_in_several_batches(spark, tmp_path):
    rows = sorted((r for r in made(2, 300) if r[0] and r[1] is not None and r[1] >= 0), key=lambda r: r[1])
    for i in range(3):
        part = rows[100 * i : 100 * (i + 1)]
        random.Random(i).shuffle(part)
        (tmp_path / str(i)).write_text("".join(json.dumps(dict(zip(("k", "ts", "n", "a"), r, strict=True))) + "\n" for r in part))
        os.utime(tmp_path / str(i), (1_700_000_000 + i,) * 2)
    end = rows[-1][1]
    for pattern in SHAPES[1:3]:
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path))
        got = read(finish(pattern_stream(stream, pattern, key="k", tie=["n"], delay="40 milliseconds"), "pattern"))
        want = expected(rows, pattern)
        assert set(got) <= set(want)
        # what the watermark, 40 behind the end, has passed
        assert {w for w in want if w[2] + pattern.window_ms < end - 40} <= set(got)


def by_batches(spark, folder, schema, files):
    """A stream that takes each list of rows as a batch."""
    folder.mkdir()
    names = [part.split()[0] for part in schema.split(", ")]
    for i, part in enumerate(files):
        (folder / str(i)).write_text("".join(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in part))
        os.utime(folder / str(i), (1_700_000_000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_patterns_by_batches_of_tables(spark, tmp_path):
    """Each batch gives what the watermark passes in it, once; late rows and rows without key or time take no part."""
    rows = sorted((r for r in made(4, 300) if r[0] and r[1] is not None and r[1] >= 0), key=lambda r: r[1])
    late = [("a", rows[100][1] - 60, 1000, "x"), ("hot", rows[100][1] - 60, 1001, "z")]
    parts = [[*rows[:130], (None, 9000, 2000, "x"), ("a", None, 2001, "x")], [], [*rows[110:180], *late], rows[180:]]
    parts[2] = [r for r in parts[2] if r not in rows[110:130]]
    end = rows[-1][1] - 40
    for n, pattern in enumerate(SHAPES):
        got = read(finish_pattern(by_batches(spark, tmp_path / str(n), ROWS, parts), pattern, "pattern", key="k", tie=["n"], delay_ms=40))
        # rows that the watermark hasn't passed aren't judged, nor is what waits for them
        ends = {r[2]: r[1] for r in rows}
        want = [w for w in expected(rows, pattern) if (ends[w[3][-1]] if w[1] == "match" else w[2] + pattern.window_ms) < end]
        assert got == want != []
    assert finish_pattern(by_batches(spark, tmp_path / "none", ROWS, []), SHAPES[0], "pattern", key="k").collect() == []


def test_bounces_by_batches_are_those_of_state(spark, tmp_path):
    """One function call for every visitor and batch took most of the time (F10); the bounces are the same ones."""
    schema = "common struct<mid:string>, page struct<last_page_id:string>, ts long, n int"
    pages = [({"mid": k}, {"last_page_id": a}, ts, n) for k, ts, n, a in ((k, 7 * ts + n % 7, n, "x" if n % 3 else None) for k, ts, n, _ in made(6, 200)[:-2] if ts >= 0)]
    pages = list({(p[0]["mid"], p[2]): p for p in sorted(pages, key=lambda p: p[2])}.values())  # no ties
    parts = [pages[:60], pages[60:120], pages[120:]]
    by_tables = finish_bounces(by_batches(spark, tmp_path / "a", schema, parts), "bounces", timeout_ms=50, delay_ms=20)
    stream = bounces_of_stream(by_batches(spark, tmp_path / "b", schema, parts), timeout_ms=50, delay="20 milliseconds")
    by_state = finish(stream, "bounces")
    assert sorted(r.n for r in by_tables.collect()) == sorted(r.n for r in by_state.collect()) != []


def test_bounces_are_a_pattern(spark):
    rows = [(k, ts, n, "x" if n % 3 else None) for k, ts, n, _ in made(3) if k and ts is not None]
    pages = spark.createDataFrame([((k,), (a,), ts, n) for k, ts, n, a in rows], "common struct<mid:string>, page struct<last_page_id:string>, ts long, n int")
    found = patterns.find_pattern(pages, visits.bounce_pattern(10), key="common.mid", tie=["n"]).where("kind = 'timeout'")
    assert sorted(r.rows[0].n for r in found.collect()) == sorted(r.n for r in visits.bounces(pages, timeout_ms=10, tie=["n"]).collect())


def test_what_is_no_pattern(spark):
    for pattern in (Pattern("x", "true"), Pattern("x", "true").next("y", "true")):
        with pytest.raises(ValueError):
            pattern.checked()


def every_cut(run, counts, likeliest):
    """The best of all ways to cut, by definition."""
    total, best = sum(counts.values()), None
    for size in range(len(run)):
        for marks in combinations(range(1, len(run)), size):
            words = [run[a:b] for a, b in zip((0, *marks), (*marks, len(run)), strict=True)]
            if any(w not in counts and len(w) > 1 for w in words):
                continue
            unknown, cost = sum(w not in counts for w in words), 0.0
            for w in words:
                cost += math.log(total / counts[w]) if w in counts else 0.0
            known = len(words) if not likeliest else cost
            key = (unknown, known + (0 if not likeliest else 0), cost if not likeliest else len(words))
            if best is None or key < best[0]:
                best = (key, words)
    return best[0] if best else (0, 0, 0)


def test_segments_against_every_cut():
    rng = random.Random(5)
    for likeliest in (False, True):
        for _ in range(150):
            counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(1, 8))}
            run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
            made = Segmenter(counts, likeliest=likeliest)
            words = made.cut(run)
            assert "".join(words) == run and all(w in counts or len(w) == 1 for w in words)
            total, cost = sum(counts.values()), sum(math.log(total_of(counts) / counts[w]) for w in words if w in counts)
            unknown = sum(w not in counts for w in words)
            want = every_cut(run, counts, likeliest)
            have = (unknown, cost, len(words)) if likeliest else (unknown, len(words), cost)
            assert have == pytest.approx(want), (run, counts, words, total)


def total_of(counts):
    return sum(counts.values())


def test_overlaps_that_forward_matching_gets_wrong():
    counts = {"研究": 5, "研究生": 3, "生命": 5, "命": 1, "起源": 4}
    assert Segmenter(counts).cut("研究生命起源") == ["研究", "生命", "起源"]
    assert Segmenter(counts).tokens("Das 研究生命起源x, y2") == ["das", "研究", "生命", "起源", "x", "y2"]
    assert Segmenter({}).tokens("小米") == ["小", "米"] and Segmenter(counts).tokens(None) == Segmenter(counts).tokens("") == []


def test_segments_of_a_table(spark):
    rows = catalog.queries()["keyword_segments"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        tokens = catalog.words.tokenize(texts[r.item_id])
        assert r.text.replace(" ", "") == "".join(tokens) and r.n_words == len(r.text.split()) <= len(tokens)
    words = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "w string")
    assert dictionary_of(words, "w") == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        dictionary_of(words, "w", most=1)
    assert [r[0] for r in spark.createDataFrame([("aab",), (None,)], "t string").select(segments(F.col("t"), {"aa": 1}, runs="[a-z]+")).collect()] == [["aa", "b"], []]
