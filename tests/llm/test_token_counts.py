import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewater.llm.common import shared_dir
from tidewater.llm.token_counts import count_tokens, token_counts, tokenizer_digest

ODD = [
    "", " ", "a <|endoftext|> b", "  a<|endoftext|>b\n\t c", "<|END OFTEXT|> <|startoftext|>x", "It's he'll 's 't", "ÉTÉ été ́x",
    "ΣΑΣ σας İstanbul ß ẞ", "汉字 かな 한국어 \U0001F600\U0001F468‍\U0001F469", "nbsp em x\u0085y\x1cz", "a\x0bb\x0cc\rd", "1234 5 6,7.8!!! ***", "word " * 5000 + "x" * 3000,
]


def library(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    t = Tokenizer.from_file(path)
    t.no_truncation()
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    rng = random.Random(4)
    path = public_tokenizers.path(name)
    bits = ["a", "B", "é", " ", "\n", "'s", "<|endoftext|>", "1", "!", "́", "中", "\t", " ", "the"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    assert count_tokens(texts, path, 100) == library(path, texts)


def test_rows_cache_and_second_run(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, t, "c") for i, t in enumerate(ODD)] + [(3, ODD[3], "c"), (None, None, "c"), (50, "a  b", "c"), (51, "a b ", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content string")
    cache = f"{shared_dir(spark)}/cache-test"
    want = sorted(((d, len((t or "").encode()), n, n > 4) for (d, t, _), n in zip(rows, library(path, [r[1] or "" for r in rows]), strict=True)), key=str)
    assert sorted(map(tuple, token_counts(docs, path, cache, limit=4).collect()), key=str) == want
    stored = spark.read.parquet(cache).count()
    assert stored == spark.read.parquet(cache).select("content").distinct().count()
    assert sorted(map(tuple, token_counts(docs, path, cache, limit=4).collect()), key=str) == want
    assert spark.read.parquet(cache).count() == stored
    assert {r.tokenizer for r in spark.read.parquet(cache).select("tokenizer").distinct().collect()} == {tokenizer_digest(path)}
    assert token_counts(docs.limit(0), path, cache).collect() == []
