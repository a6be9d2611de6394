import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidewater.llm.labelled import fit_logistic, labelled_sample
from tidewater.llm.quality_classifier import dual_descent, fit, fit_quality, indicators, quality_scores, shapes


def test_indicators_see_shapes_and_repeats():
    assert len(indicators("")) == 0 and (np.diff(indicators("abc def abc")) > 0).all()
    plain, shouted, again = shapes(np.frombuffer(b"some words here", np.uint8)), shapes(np.frombuffer(b"SOME!! WORDS!! HERE!!", np.uint8)), shapes(np.frombuffer(b"word word", np.uint8))
    assert not set(plain) & set(shouted) and again[0] != again[1]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.5 * rng.normal(size=60))
    w, b = dual_descent([np.arange(5)] * 60, list(x), y, 5, np.full(60, 0.5), 2000, 1)

    def loss(w, b):
        return (w @ w + b * b) / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(2000):
        assert loss(w + rng.normal(size=5) * 0.02, b + rng.normal() * 0.02) >= best - 1e-3


def test_one_class_and_logistic():
    assert fit([np.array([1])], np.array([1.0])).score(np.array([1])) == pytest.approx(0.75)
    w = fit_logistic(np.array([[0.0], [1], [0], [1]] * 50), np.array([0.0, 1, 1, 1] * 50), ridge=0.0)
    assert 1 / (1 + np.exp(-w[-1])) == pytest.approx(0.5, abs=0.01)


def test_held_out_accuracy_and_rows(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("er tion the an ou".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    bad = [lambda: " ".join(w + "###" for w in prose(40).split()), lambda: " ".join(w.upper() + "!!" for w in prose(40).split()), lambda: " ".join(" ".join([w] * 9) for w in prose(8).split())]
    rows = [(i, prose(rng.randint(5, 120)), 1) if rng.random() < 0.7 else (i, rng.choice(bad)(), 0) for i in range(500)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t, _ in rows] + [(None, "x", "", 0.0), (900, None, "", 0.0), (900, "", "", 0.0), (3, rows[3][1], "", 0.0), (901, "word " * 50_000, "", 0.0)], "doc_id long, text string, quality string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    # labels of the held-out fold have no influence
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality", "toxic")
    assert sorted(map(str, quality_scores(docs, flipped).collect())) == sorted(map(str, got))
    assert quality_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def plain_indicators(text):
    """By definition, with Python's integers: byte trigrams, and runs of one to three word shapes."""
    raw, found = text.encode(), set()
    put = lambda code, space: found.add((code * 0x9E3779B97F4A7C15 % 2**64 >> 64 - 17) + (space << 17))
    for i in range(len(raw) - 2):
        put(raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2], 0)
    words = raw.split()
    codes = []
    for i, w in enumerate(words):
        upper, lower = sum(65 <= b <= 90 for b in w), sum(97 <= b <= 122 or b >= 128 for b in w)
        case = 0 if not upper else 2 if upper > 1 and not lower else 1 if upper == 1 and 65 <= w[0] <= 90 else 3
        marks = [any(b in s for b in w) for s in (b"#*$%&|<>@^~_=+", b"!", b"0123456789", b".,;:?'\"()[]{}-/")]
        length = sum(len(w) >= n for n in (2, 4, 7, 11, 21, 41, 101))
        codes.append(case | sum(m << 2 + k for k, m in enumerate(marks)) | (i > 0 and w == words[i - 1]) << 6 | length << 7)
    run = [0] * len(codes)
    for n in range(3):
        run = [((r << 10 | c) + ((n + 1) << 40)) % 2**64 for r, c in zip(run, codes[n:], strict=False)]
        for r in run:
            put(r, 1)
    return sorted(found)


def test_scores_against_plain_arithmetic(spark):
    """Features, class log-count ratios and scores, each computed once more by their definitions."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("er tion the an ou É".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [prose(rng.randint(0, 30)) if i % 3 else " ".join(w.upper() + rng.choice(["!!", "#1", "", "-"]) for w in prose(12).split()) for i in range(160)]
    rows = [(i, t, int(i % 3 > 0)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, "z" + texts[5]), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    for t in texts:
        assert indicators(t).tolist() == plain_indicators(t)
    model = fit_quality(docs, labels, parts=4, held_out=2, train_rows=1000, train_ngrams=10**7)
    learned = [(min(t, "z" + t, key=lambda s: hashlib.sha256(s.encode()).hexdigest()) if i == 5 else t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    held = [Counter(g for t, y in learned if y == z for g in plain_indicators(t)) for z in (0, 1)]
    size = [sum(y == z for _, y in learned) for z in (0, 1)]
    ratio = {g: math.log((held[1][g] + 1) / (size[1] + 2)) - math.log((held[0][g] + 1) / (size[0] + 2)) for g in held[0] | held[1] if held[0][g] + held[1][g] >= 3}
    assert {g: pytest.approx(r * r) for g, r in ratio.items() if abs(r) > 1e-12} == {g: x for g, x in enumerate(model.square.tolist()) if x > 1e-24}
    for r in quality_scores(docs, labels).collect():
        if r.doc_id != 5:
            found = plain_indicators((texts + [""])[min(r.doc_id, 160)])
            norm = math.sqrt(sum(ratio.get(g, 0.0) ** 2 for g in found))
            margin = model.bias + (sum(model.weight[g] for g in found) / norm if norm else 0.0)
            assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.shift))), abs=1e-9)


def test_rows_with_too_many_ngrams_are_passed_over(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 5 if i else " ".join(f"w{n}" for n in range(5000))) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = fit_quality(docs, labels, parts=4, held_out=2, train_rows=100, train_ngrams=2000)
    assert model.square.sum() > 0


def test_an_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {n % 50}") for n in range(500)] + [(2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    got = labelled_sample(docs, labels, "quality", 4, 9, 100).collect()
    first = min((f"text {n}" for n in range(50)), key=lambda s: hashlib.sha256(s.encode()).hexdigest())
    assert sorted(map(tuple, got)) == [(1, first, 1), (2, "b", 0), (2, "b", 1), (3, "", 0)]
