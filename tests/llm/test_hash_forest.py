import math

import numpy as np

from tidewater.llm.hash_forest import Forest, fit_planes, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, block string"


def brute(index, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 8
    rows = {}
    for i, v in index:
        if i is not None and ok(v):
            rows.setdefault(i, []).append(np.array(v, dtype=np.float32).astype(float))
    out = {}
    for i, v in queries:
        if i is None or not ok(v):
            continue
        q = np.array(v, dtype=np.float32).astype(float)
        out[i] = sorted((-max(float((x * q).sum()) for x in xs), j) for j, xs in rows.items() if j != i)[:k]
    return out


def test_longest_prefix_ranges():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8))
    planes, offset = fit_planes(x, 3, 1)
    forest = Forest(np.arange(200), x, planes, offset)
    for codes, order in zip(forest.codes, forest.order, strict=True):
        assert (np.diff(codes.astype(float)) >= 0).all() and sorted(order) == list(range(200))
    for enough in (1, 10, 100, 600):
        for i, found in enumerate(forest.candidates(x[:20], enough, 0)):
            assert i in found
            # the deepest common level at which the trees hold enough
            for level in range(32, -1, -1):
                low, high = forest._ranges(np.stack([c[np.argsort(o)][[i]] for c, o in zip(forest.codes, forest.order, strict=True)]), level)
                if (high - low).sum() >= enough:
                    break
            want = set().union(*[set(o[a:b]) for o, a, b in zip(forest.order, low[:, 0], high[:, 0], strict=True)])
            assert set(found) == want


def test_exhaustive_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(90)]
    vectors += [(i, vectors[3][1]) for i in range(100, 140)]  # ties
    vectors += [(200, None), (201, [0.0] * 8), (202, [None] + [1.0] * 7), (203, [math.nan] + [1.0] * 7), (204, [math.inf] + [1.0] * 7), (205, [1.0]), (206, []), (None, [1.0] * 8), (3, vectors[3][1])]
    df = spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in vectors], SCHEMA)
    for k in (5, 500):
        got = {}
        for r in nearest(df, df.where("vec_id % 10 = 0 or vec_id > 199"), k=k, trees=4, visit=10.0, block_rows=20, query_rows=7, least_blocks=3).collect():
            got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
        want = brute(vectors, [x for x in vectors if x[0] is not None and (x[0] % 10 == 0 or x[0] > 199)], k)
        assert {q: [x[1:] for x in sorted(rows)] for q, rows in got.items()} == want
        assert all([x[0] for x in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values())
    assert nearest(df.limit(0), df).collect() == [] and nearest(df, df.limit(0)).collect() == []


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 64)) + 2 * rng.normal(size=(10, 64))[rng.integers(0, 10, 4000)] * 0.2
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 1, "", "") for i, v in enumerate(x)], SCHEMA)
    x = x.astype(np.float32).astype(float)
    rows = nearest(df, df.where("vec_id % 20 = 0")).collect()
    hits = 0
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:20]) & {r.vec_id for r in rows if r.query_id == q})
    assert len(rows) == 4000 and hits / 4000 >= 0.9
