import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline as pipeline
from tests.llm.test_secrets import base, entropy
from tests.llm.test_simhash import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choice("er tion the an ou in es".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.randint(15, 90))) for i in range(150)]
    rows += [(200 + i, rows[i % 7][1] + (" extra" if i % 2 else "")) for i in range(40)]
    rows += [(300 + i, " ".join(w + "###" for w in prose(60).split())) for i in range(9)]
    rows += [(400 + i, " ".join(" ".join([w] * 8) for w in prose(9).split())) for i in range(5)]
    rows += [(500, prose(30) + " password = hunter2hunter2 " + prose(9)), (501, prose(30) + " AKIA" + "Q7" * 9), (502, None), (503, ""), (504, "short"), (None, prose(40)), (5, rows[5][1])]
    return spark.createDataFrame([(d, t, rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b", None]), len(t or "")) for d, t in rows], SCHEMA)


def test_stages_against_brute_force(spark, docs):
    steps = dict(pipeline.STAGES)
    ruled = steps["quality rules"](spark, docs, "").collect()
    ids = {r.doc_id for r in ruled}
    assert {*range(150), *range(200, 240), 500, 501, None} == ids and all(tuple(r) in set(map(tuple, docs.collect())) for r in ruled)

    left = spark.createDataFrame(ruled, SCHEMA)
    unique = steps["SimHash near-dedup"](spark, left, "").collect()
    want = {d for d, _, c in brute([(r.doc_id, r.text) for r in ruled], 4, 4) if d == c}
    assert Counter(r.doc_id for r in unique) == Counter(want | {None})

    clean = steps["secret scans"](spark, spark.createDataFrame(unique, SCHEMA), "").collect()
    assert [r.doc_id for r in clean] == [r.doc_id for r in unique]
    for before, after in zip(unique, clean, strict=True):
        assert not base(after.text) and after.n_chars == len(after.text)
        if not base(before.text) and not entropy(before.text):
            assert before == after
    assert sum("[SECRET]" in r.text for r in clean) == 2

    mixed = steps["mixing sources to target weights"](spark, spark.createDataFrame(clean, SCHEMA), "").collect()
    assert {tuple(r) for r in mixed} == {tuple(r) for r in clean} and max(Counter(mixed).values()) <= 2

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    done = steps["SentencePiece encoding and decoding"](spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    assert [(r.doc_id, r.ids) for r in done] == [(r.doc_id, library.encode(r.text)) for r in mixed] and all(r.round_trip for r in done)


def test_run_on_files_and_on_an_empty_table(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    out = pipeline.run(spark, f"{tmp_path}/full")
    assert out.columns == ["doc_id", "n_ids", "ids", "decoded_sha256", "round_trip"] and out.count() > 150
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_repeated_ids(spark):
    """A third of all rows under one id: unlike texts stay, near copies and equal rows become one."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("er tion the an ou in es".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    own = [(i, prose(60), "en", "a", 1) for i in range(100, 140)]
    unlike = [(7, prose(60), "en", "a", 1) for _ in range(20)]
    rows = [*own, *unlike, *[unlike[0]] * 5, (7, unlike[1][1] + " more", "de", "b", 2), (9, unlike[2][1], "en", "a", 1), (None, own[0][1], "en", "a", 1), (7, None, None, None, None)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), "").collect()
    ids, left = Counter(r.doc_id for r in got), {r.text for r in got}
    assert ids[7] == 21 and ids[9] == 0 and ids[None] == 1 and sum(ids.values()) == 40 + 21 + 1
    assert {r[1] for r in unlike} - {unlike[1][1]} <= left and len({unlike[1][1], unlike[1][1] + " more"} & left) == 1
    assert all(tuple(r) in set(rows) for r in got)


def test_every_stage_works_on_all_rows(spark, docs):
    """Rows counted stage by stage: only rules and near duplicates take any away, and each only what it judges."""
    assert [name for name, _ in pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    steps = dict(pipeline.STAGES)
    rng, rows = random.Random(2), []
    for n in range(20):
        for r in docs.where("doc_id < 150").collect():
            words = r.text.split()
            rng.shuffle(words)
            rows.append((1000 * (n + 1) + r.doc_id, " ".join(words), r.lang, r.source, r.n_chars))
    many = spark.createDataFrame(rows, SCHEMA)
    kept = steps["quality rules"](spark, many, "")
    assert kept.count() == many.count() == len(rows)
    for name in ("secret scans", "SentencePiece encoding and decoding"):
        assert sorted(r.doc_id for r in steps[name](spark, many, "").select("doc_id").collect()) == sorted(r.doc_id for r in many.collect())
    mixed = Counter(r.doc_id for r in steps["mixing sources to target weights"](spark, many, "").collect())
    assert set(mixed) == {r.doc_id for r in many.collect()}
