import random

import numpy as np

from tidewater.llm.quality_rules import DIMS, FLOORS, _consistency, chi_square, chi_square_quantile, mcd, quality_rules, repeated_words, statistics

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, n long"


def plain(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    dups = sum(bool(x.strip(" \t\n\v\f\r")) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dups, len(covered)


def test_statistics_match_a_plain_count():
    rng = random.Random(5)
    for n in [0, 1, 4, 5, 9, 30, 200]:
        for _ in range(20):
            text = "".join(rng.choice(["a", "b", "É", "x#", "\x1c", "\x85"]) + rng.choice([" ", "\n", "\t", "  ", "\n\n"]) for _ in range(n))
            assert statistics(text)[:5] == plain(text)
    assert statistics(None) == (0,) * 8
    assert repeated_words([b"a"] * 100_000) == 100_000


def test_chi_square():
    assert abs(chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(chi_square(3.0, 2) - (1 - np.exp(-1.5))) < 1e-12


def test_mcd_finds_a_determinant_as_small_as_many_random_starts(spark):
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(len(DIMS), len(DIMS)))
    clean = rng.normal(size=(160, len(DIMS))) @ mix
    x = np.vstack([clean, 25 + rng.normal(size=(30, len(DIMS)))])
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], ["grp", *DIMS])
    got = mcd(df, 0.75, 30).first()
    h = int(np.ceil(0.75 * len(x)))
    floor = np.diag([f * f for f in FLOORS.values()])
    best = np.inf
    for _ in range(60):
        at = rng.choice(len(x), len(DIMS) + 1, replace=False)
        for _ in range(30):
            m, c = x[at].mean(axis=0), np.cov(x[at].T, bias=True) * _consistency(0.75) + floor
            at = np.argsort(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))[:h]
        best = min(best, np.linalg.slogdet(c)[1])
    assert got.log_det < best + 0.05
    assert np.abs(np.array(got["mean"]) - clean.mean(axis=0)).max() < 1.0


def test_rows_of_every_kind(spark):
    rng = random.Random(7)
    syllables = "tion er the an re ou in es".split()

    def prose(n):
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    rows = [(i, prose(rng.randint(20, 200)), "en", rng.choice(["big", "big", "small"])) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "***" for w in prose(80).split()), "en", "big") for i in range(12)]
    rows += [(2000, None, None, None), (2001, "", "en", "big"), (2002, "few words", "xx", None), (2003, prose(60), "xx", "rare"), (None, prose(50), None, "big")]
    rows += [(2004, prose(90) + "\n" + "x" * 50_000, "en", "big"), (5, rows[5][1], "en", rows[5][3])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = quality_rules(df, carry=("text", "n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept is not None and not (r.kept and r.base_failed)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & set(range(1000, 1012)) and not kept & {2000, 2001, 2002}
    assert len(kept & set(range(300))) == 300
    assert quality_rules(df.limit(0)).collect() == []
