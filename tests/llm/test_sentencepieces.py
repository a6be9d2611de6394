import hashlib
import random

import public_tokenizers
import sentencepiece

from tidewater.llm.sentencepieces import BLANK, Pieces, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a", " a", "  a  b ", "        a", " " * 40, "x" + " " * 100 + "y", "\n", "a\nb\n\n c", "▁a ▁", "é ü ß ñ", "汉字 かな 한국어 \U0001F600\U0001F468‍\U0001F469",
    "<s> </s> <unk> <0x41> ⁇", "\x00\x01 tab\there", "aaaaaaaaaaaaaaaa", "1234567890", "The cat's 3.14% (of) [all] {sets}!", "中 中  中", "é   x", "Hello world " * 3000, "z" * 3000,
]


def test_ids_are_the_librarys():
    library, own, rng = sentencepiece.SentencePieceProcessor(model_file=PATH), Pieces(PATH, 50), random.Random(1)
    bits = ["a", "B", "the", "ing", "é", " ", "  ", "\n", "\t", "中", "\U0001F600", "1", "!", "…", "tion", "schaft", "▁", "'s", "ción", "z"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        assert own.encode(text) == library.encode(text), text
        assert own.decode(own.encode(text)) == library.decode(library.encode(text)) == text.replace(BLANK, " ")


def test_words_that_come_once_drive_no_others_out():
    own, library = Pieces(PATH, 10_000), sentencepiece.SentencePieceProcessor(model_file=PATH)
    text = "stay stay " + " ".join(f"q{i}x{i * 7919}z" for i in range(1000))
    assert own.encode(text) == library.encode(text) and BLANK + "stay" in own.memo and len(own.memo) < 30


def test_viterbi_finds_the_best_sum_of_scores():
    own, rng = Pieces(PATH, 50), random.Random(2)
    own.merging = False
    own.scores = [rng.uniform(-9, -1) for _ in own.scores]
    for _ in range(150):
        text = "".join(rng.choice("thereinga") for _ in range(rng.randint(1, 9)))

        def all_paths(rest):
            if not rest:
                yield 0.0
            for n in range(1, len(rest) + 1):
                if (i := own.ids.get(rest[:n])) is not None:
                    yield from (own.scores[i] + s for s in all_paths(rest[n:]))

        got = own.viterbi(text)
        assert "".join(own.shown[i] for i in got) == text
        assert abs(sum(own.scores[i] for i in got) - max(all_paths(text))) < 1e-9


def test_rows_of_every_kind(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, ids string, n_ids int")
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    encoded = encode_documents(docs, PATH, memo_bytes=2000)
    got = encoded.collect()
    for (d, t), r in zip(rows, got, strict=True):
        assert (r.doc_id, r.ids, r.n_ids) == (d, library.encode(t or ""), len(r.ids)) and r.round_trip
        assert r.decoded_sha256 == hashlib.sha256((t or "").replace(BLANK, " ").encode()).hexdigest()
    assert [r.text for r in decode_documents(encoded, PATH).collect()] == [(t or "").replace(BLANK, " ") for _, t in rows]
    assert encode_documents(docs.limit(0), PATH).collect() == []
