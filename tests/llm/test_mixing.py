import math
import random
from collections import Counter

import duckdb
import pytest

from tidewater.llm.mixing import mix, mix_copies, mix_plan, oracle

SCHEMA = "doc_id long, text string, source string, n_tokens string, whole long, p_source string"


def corpus():
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), rng.choices(["big", "mid", "small", "tiny"], [60, 25, 12, 3])[0]) for i in range(600)]
    rows += [(1000, None, "big"), (1001, "", "none"), (1002, " \n", None), (1003, "a b c", None), (None, "x y", "mid"), (5, rows[5][1], rows[5][2]), (1004, "w\t" * 5000, "mid")]
    return [(i, t, s, "clash", 9, "clash") for i, t, s in rows]


@pytest.mark.parametrize("how", [{"entropy": 1.8}, {"entropy": 9.0}, {"entropy": 0.0}, {"repetition": 3.0}, {"repetition": 1.0}, {"repetition": 1000.0}])
def test_plan_matches_sql(spark, how):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = sorted(map(tuple, mix_plan(docs, **how, row_tokens=50).collect()), key=str)
    with duckdb.connect() as db:
        documents = docs.toArrow()  # noqa: F841
        want = db.sql(oracle(how.get("entropy"), how.get("repetition"))).fetchall()
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in sorted(want, key=str)]


@pytest.mark.parametrize("how", [{"entropy": 2.0}, {"repetition": 4.0}])
def test_copies_match_sql_and_the_mix(spark, how):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = mix_copies(docs, **how, row_tokens=50).collect()
    with duckdb.connect() as db:
        documents = docs.toArrow()  # noqa: F841
        made = db.sql(oracle(how.get("entropy"), how.get("repetition"), copies=True))
        assert made.columns == mix_copies(docs, **how).columns
        want = made.fetchall()
    rounded = lambda rows: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    assert rounded(got) == rounded(want)
    # every row is there as often as it is passed, or once without a place
    plan = Counter()
    for r in mix_plan(docs, **how, row_tokens=50).collect():
        plan[r.doc_id, r.source] += r.passes
    assert Counter((r.doc_id, r.source) for r in got if r.number is not None) == +plan
    assert all((r.number is None) == (r.place is None) == (r.passes == 0) for r in got) and any(r.passes == 0 for r in got) == ("entropy" in how)
    # each pass of a source is a permutation of its own, and passes follow one another
    copies = sorted((r for r in got if r.source == "tiny" and r.n_tokens and r.place is not None), key=lambda r: r.place)
    assert [r.number for r in copies] == sorted(r.number for r in copies)
    if "repetition" in how:
        orders = [[r.doc_id for r in copies if r.number == n] for n in range(2)]
        assert set(orders[1]) < set(orders[0]) and [d for d in orders[0] if d in orders[1]] != orders[1]  # the last pass is a part
    assert mix_copies(docs.limit(0), **how).collect() == []


def test_arranged_mix_is_read_back_in_order(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    mix(docs, repetition=3.0, place="at", arranged=True).write.parquet(str(tmp_path / "mix"))
    files = sorted((tmp_path / "mix").glob("*.parquet"))
    read = [r.at for f in files for r in spark.read.parquet(str(f)).collect()]
    assert read == sorted(read) and sorted(read) == sorted(r.at for r in mix(docs, repetition=3.0, place="at").collect())


def test_targets_are_met(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    sums = lambda rows: Counter({s: sum(r.n_tokens * r.passes for r in rows if r.source == s) for s in {r.source for r in rows}})
    rows = mix_plan(docs, entropy=1.8).collect()
    weights = {r.source: r.weight for r in rows if r.weight is not None}
    assert abs(sum(weights.values()) - 1) < 1e-6
    assert 1.8 - 1e-6 <= -sum(w * math.log2(w) for w in weights.values()) < 1.801
    for source, made in sums(rows).items():
        budget = next((r.source_budget for r in rows if r.source == source), None)
        assert not budget or budget <= made < budget + 5001
    rows = mix_plan(docs, repetition=3.0).collect()
    assert min(r.passes for r in rows) == 1 and max(r.passes for r in rows) == 3
    rows = mix_plan(docs, repetition=2.0, budget=4000).collect()
    made = sums(rows)
    assert all(made[s] <= 2 * sum(r.n_tokens for r in rows if r.source == s) for s in made)


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = mix_plan(docs, repetition=3.0).collect()
    got = mix(docs, repetition=3.0, place="at").collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source] += r.passes
    assert Counter((r.doc_id, r.source) for r in got) == want
    assert {r.whole for r in got} == {9} and {r.p_source for r in got} == {"clash"} and all(0 <= r.at < 1 for r in got)
    # every stretch of the mix has about the weights of the whole
    half = sorted(got, key=lambda r: r.at)[: len(got) // 2]
    total, first = (Counter(r.source for r in x) for x in (got, half))
    assert abs(first["big"] / len(half) - total["big"] / len(got)) < 0.1
    assert mix(docs.limit(0), repetition=3.0).collect() == [] and mix_plan(docs.limit(0), entropy=1.0).collect() == []
