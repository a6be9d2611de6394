import random

import numpy as np
from pyspark.sql import functions as F

from tests.compare import differences
from tidewater.llm import registry
from tidewater.llm.hard_negatives import hard_negatives, products, whole

SCHEMA = "vec_id long, label int, v array<double>, rank string, score int"


def brute(rows, step):
    """rows: (vec_id, label, list of ints), each id once."""
    out = []
    for a, label, v in rows:
        if a % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, other, w in rows if i != a))
        for s, i, other in [x for x in scored if x[2] == label][:5]:
            near = [(n, j) for n, j, o in scored if o != label and 30 * -s <= 100 * -n <= 90 * -s][:10]
            out += [(a, i, rank + 1, j, -s, -n) for rank, (n, j) in enumerate(near)]
    return sorted(out)


def made(rng, n, spread, dim=6, labels=4):
    centres = [[rng.gauss(0, 90) for _ in range(dim)] for _ in range(5)]
    return [(i, rng.randrange(labels), [float(int(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df, F.expr("vec_id % 10 = 0"), **options).collect()))


def test_against_brute_force(spark):
    rng = random.Random(1)
    for n, spread, options in ((400, 20, {}), (300, 200, {"sample_rows": 40, "pivots": 5, "packet_rows": 4, "least_blocks": 6}), (60, 5, {"sample_rows": 1, "pivots": 3})):
        rows = made(rng, n, spread)
        rows += [(n + i, rows[0][1], rows[0][2]) for i in range(n // 3)]  # a third of all rows are one vector
        assert run(spark, rows, **options) == brute(rows, 10) != []


def test_edges(spark):
    rng = random.Random(2)
    rows = made(rng, 80, 30)
    twice = [*rows, rows[10], rows[20], (11, 99, rows[11][2])]  # of one id the smallest label counts
    odd = [(1000, None, rows[0][2]), (None, 1, rows[0][2]), (1010, 1, None), (1020, 1, [1.0]), (1030, 1, [])]
    assert run(spark, twice + odd) == brute(rows, 10)
    assert run(spark, rows[:1]) == run(spark, []) == run(spark, odd[3:4]) == []
    zeros = [(i, i % 2, [0.0, 0.0]) for i in range(30)]
    assert run(spark, zeros) == brute(zeros, 10) and run(spark, [(i, 1, v) for i, _, v in rows]) == []
    large = [(i, i % 2, [float(rng.randint(0, 1 << 29)) for _ in range(8)]) for i in range(40)]
    assert run(spark, large) == brute([(i, x, list(map(int, v))) for i, x, v in large], 10)
    assert products(np.array([[1e18, 1e18]]), np.array([1e18, 0.0])).tolist() == [(1 << 63) - 1]


def test_whole_numbers(spark):
    rows = [([0.5, -0.001],), (None,), ([None, 1.0],), ([float("nan")],), ([float("-inf")],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(whole(F.col("e"))).collect()]
    assert got == [[128.0, -1.0], None, None, None, None, []]


def test_query_agrees_with_sql(spark):
    for sf in ("sf0.001", "sf0.1"):
        more, less, n = differences(spark, f"/root/testdata/{sf}", registry.op12_hard_negatives, registry.HARD_NEGATIVES_SQL)
        assert not more and not less and n
