import random

import numpy as np
import pytest
import xxhash

from tidewater.llm.simhash import covering_masks, fingerprint, links, simhash_components

SCHEMA = "doc_id long, text string, lang string, fp string, n long"


def brute(rows, shingle, radius):
    def fp(text):
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        if not words:
            return 0
        n = max(1, len(words) - shingle + 1)
        h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), 42) for i in range(n)]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)

    codes = [fp(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                group[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{codes[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def made(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "en", "clash", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in simhash_components(df, **how).collect()), key=str)


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    masks = covering_masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & (m % 2**64) == 0 for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta".split()) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed" + str(rng.randint(0, 9))
        rows.append((i * 3 % 161, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "É É"), (904, "One two"), (905, "one TWO"), (None, "one two"), (904, "One two"), (None, "alone in here, no id")]
    assert made(spark, rows) == brute(rows, 4, 4)
    # blocks and bundles of any size give the same
    assert made(spark, rows, block_rows=3, bundle_rows=16) == brute(rows, 4, 4)


def test_links_of_dense_codes_in_blocks(spark):
    rng = np.random.default_rng(3)
    codes = {0}
    for _ in range(400):
        codes.add(int(rng.choice(list(codes))) ^ (1 << int(rng.integers(40))) ^ (1 << int(rng.integers(40))))
    df = spark.createDataFrame([(c,) for c in codes], "fp long")
    edges = links(df, 4, 64, 256).collect()
    seen, todo = {0}, [0]
    near = {}
    for e in edges:
        assert (e.a ^ e.b).bit_count() <= 4
        near.setdefault(e.a, []).append(e.b)
        near.setdefault(e.b, []).append(e.a)
    while todo:
        for x in near[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    assert seen == codes


def test_links_of_codes_that_differ_in_the_sign_and_a_low_bit(spark):
    base = 0x0123456789ABCDEF
    low = [base ^ (1 << 63) ^ (1 << b) for b in (0, 13, 40, 56)]
    pairs = [(base, x) for x in low] + [(base, base ^ (1 << 63) ^ 0b1110)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for pair in pairs:  # buckets of two
        df = spark.createDataFrame([(signed(c),) for c in pair], "fp long")
        assert {frozenset(e) for e in links(df, 4, 64, 256).collect()} == {frozenset(map(signed, pair))}
    # all three meet in a bucket, and the base differs from both of the others in the sign and a low bit
    codes = [signed(c) for c in (base, low[0], low[1])]
    edges = links(spark.createDataFrame([(c,) for c in codes], "fp long"), 4, 64, 256).collect()
    assert {c for e in edges for c in e} == set(codes)


def test_empty_table_and_long_text(spark):
    assert made(spark, []) == []
    long = "word " * 200_000
    assert fingerprint(long, 4) == xxhash.xxh64_intdigest(b"word word word word", 42)


@pytest.mark.parametrize("text", [None, "", "\t\n"])
def test_no_words_is_zero(text):
    assert fingerprint(text, 4) == 0
