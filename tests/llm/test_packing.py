import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tidewater.llm.packing import encoder, pack, piece_lengths, write_buckets

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, length int"


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(PATH)
    return lambda text: model.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_library(library):
    encode = encoder(PATH)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "|".join(f"a{c}1 {c}{c} b\n{c} " for c in points[at : at + 4096])
        assert encode(text) == library(text), at
    for text in ("", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "x" * 100_000, " " * 600_000 + "x", "\r\n" * 99, "don't  stop's"):
        assert encode(text) == library(text), text[:30]


def test_other_models_go_through_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    assert encoder(path)("Hello  wide World") == model.encode("Hello  wide World", add_special_tokens=False).ids


def test_lengths():
    for n in [*range(1, 300), 2047, 2048, 2049, 10_000]:
        sizes = piece_lengths(n, 2048)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and all(s & (s - 1) == 0 and s <= 2048 for s in sizes)
        assert len([s for s in sizes if s < 2048]) == len({s for s in sizes if s < 2048})
    assert piece_lengths(7, 1) == [1] * 7


def test_every_token_in_one_piece(spark, library, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "Été", "小米", "x1", "<|endoftext|>", "\n"]) for _ in range(rng.randint(0, 900)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id"), (3, rows[3][1]), (502, "long " * 60_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    made = pack(df, PATH, batch_tokens=4096)
    pieces = made.collect()
    docs = defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        assert p.length == len(p.ids) <= 2048 and p.length & (p.length - 1) == 0 and p.offset == 0
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, dtype="<u4").tobytes())
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for doc, text in set(rows):
        want = [*library(text or ""), 1]
        own = sorted(docs[doc], key=lambda p: p.start)
        times = sum(r[0] == doc for r in rows)
        assert len(own) == times * len(piece_lengths(len(want), 2048)) and {p.doc_tokens for p in own} == {len(want)}
        at = 0
        for p in own[::times]:
            assert p.start == at and p.ids == want[at : at + p.length]
            at += p.length
        assert at == len(want)
    batches = defaultdict(list)
    for p in pieces:
        batches[p.batch_id].append(p.length)
    assert all(len(set(b)) == 1 and sum(b) <= 4096 for b in batches.values()) and max(map(len, batches.values())) > 1
    lean = pack(df, PATH, batch_tokens=4096, ids=False)
    assert sorted(map(str, lean.collect())) == sorted(map(str, made.drop("ids").collect())) and pack(df.limit(0), PATH).collect() == []
    write_buckets(made, f"{tmp_path}/packed")
    assert {r.bucket: r["count"] for r in spark.read.parquet(f"{tmp_path}/packed").groupBy("bucket").count().collect()} == {
        n: sum(p.length == n for p in pieces) for n in {p.length for p in pieces}}
    with pytest.raises(ValueError):
        pack(df, PATH, longest=1000)
