import hashlib
import random
import zlib

import numpy as np

from tidewater.llm.periodic import collapse, periodic_runs, planted, run_digest, runs_of, squares

SCHEMA = "doc_id long, text string, runs string, h int"


def brute(words):
    """Every maximal stretch of each period, by definition."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # periods rise, so the smallest stays
            i = max(j, i + 1) if j > i else i + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def by_hand(words):
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def changed(doc, text):
    words = [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in text or "").split(" ") if w]
    if doc is not None and words and (h := zlib.crc32(str(doc).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "x " * 5000, "ab " * 3 + "c " + "ab " * 9, "é é " * 8, "  " * 7]
    for _ in range(250):
        alphabet = "abcde"[: rng.randint(1, 5)]
        words = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
        for _ in range(rng.randint(0, 3)):
            at, q = rng.randint(0, len(words)), rng.randint(1, 6)
            words[at:at] = [rng.choice(alphabet) for _ in range(q)] * rng.randint(2, 7)
        out.append(rng.choice([" ", "\n", "  ", "\t"]).join(words))
    prose = ["w" + str(rng.randint(0, 80)) for _ in range(3000)]
    prose[700:700] = prose[300:350] * 6
    return [*out, " ".join(prose)]


def test_runs_of_every_short_text():
    rng = np.random.default_rng(1)
    for _ in range(3000):
        words = rng.integers(0, rng.integers(1, 4), rng.integers(0, 30))
        assert runs_of(words) == brute(words.tolist()), words.tolist()


def test_starts_of_squares_are_exact():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.randint(0, 2) for _ in range(rng.randint(2, 40))]
        for (period, start), end in squares(words).items():
            assert end - start + 1 >= 2 * period and all(words[i] == words[i + period] for i in range(start, end - period + 1))
            assert start == 0 or words[start - 1] != words[start - 1 + period]


def test_query_against_brute_force(spark):
    made = texts()
    rows = [(i, t) for i, t in enumerate(made)] + [(None, "a " * 9), (8, made[8]), (-30, "a b c d " * 9)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in run_digest(planted(df)).collect()), key=str)
    want = []
    for doc, text in rows:
        words = changed(doc, text)
        runs, kept = by_hand(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((doc, len(runs), *top, None if top[1] is None else 1000 * top[1] // top[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(), len(words)))
    assert got == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 60 and run_digest(planted(df.limit(0))).collect() == []


def test_real_outputs_and_very_long_texts(spark):
    long = "one two three " * 100_000 + " ".join(f"u{i}" for i in range(100_000)) + " z" * 200_000
    row = periodic_runs(spark.createDataFrame([(1, long, "", 1)], SCHEMA)).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 3), (400_000, 200_000, 1)] and row.n_words == 600_000
    assert row.collapsed == "one two three " + " ".join(f"u{i}" for i in range(100_000)) + " z"
    assert collapse("") == (0, [], "")
