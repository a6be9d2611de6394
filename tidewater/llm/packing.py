"""Packing by powers of two: documents are cut into pieces of binary length, and equal lengths share a bucket.

A document of n tokens gives n div ``longest`` pieces of the longest length and one piece for every bit of the rest, the
longest first. A piece is a sequence of its own, so that none crosses documents and none is padded. Sequences of one
length form a bucket, and batches of a fixed number of tokens are cut from a bucket alone.

Sequences are numbered where they are made: bucket, partition and place in both make up the number. Nothing is
shuffled or counted ahead, whatever the number of documents and however often one of them occurs.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, batch_id long"
#: Bits of a sequence's number below the bucket and below the partition.
BUCKET_AT, PART_AT = 58, 34


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@functools.cache
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids as the tokenizers library gives them, without added special tokens.

    A byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same ids in a fifth of the time (the
    tests compare both over every code point); texts that it refuses, and all other models, go through the library.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    slow = lambda text: library.encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    model, split, added = made["model"], made.get("pre_tokenizer") or {}, made.get("added_tokens", [])
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = (
        model["type"] == "BPE" and made.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        and all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges))
        and all(a["special"] and not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) for a in added)
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    )
    if not plain:
        return slow
    special, symbols = {a["content"]: a["id"] for a in added}, _bytes_of_symbols()
    ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:  # its expression gives up on very long runs of blanks
            return slow(text)

    return encode


def piece_lengths(n: int, longest: int) -> list[int]:
    """Powers of two up to ``longest`` (itself one) that add up to n, the largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, longest: int = 2048, batch_tokens: int = 65_536, ids: bool = True,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, batch_id and, with ``ids``, its ids.

    A document's tokens are its text's and ``end_id``. Every one lies in one piece; the piece is the whole of sequence
    sequence_id, so its offset is 0. Sequences of one batch_id have one length and together at most batch_tokens tokens
    (a longer sequence is a batch alone). ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers.

    Null texts count as empty: one piece that holds end_id alone. Repeated rows and null ids are packed like any other,
    with sequences of their own. An empty table gives no rows; other columns are not read. Numbers are unique within one
    result; write it before reading it twice, since they follow the partitions.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        placed: Counter[int] = Counter()
        for rows in text_slices(batches, 1):
            out: list[list] = [[] for _ in range(8)]
            held = []
            for doc, source in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                tokens = np.array([*encode(source or ""), end_id], dtype="<u4")
                start = 0
                for size in piece_lengths(len(tokens), longest):
                    piece, bucket = tokens[start : start + size], size.bit_length() - 1
                    nth, own = placed[bucket], bucket << BUCKET_AT | part << PART_AT
                    placed[bucket] += 1
                    row = (doc, start, size, zlib.crc32(piece.tobytes()), len(tokens), own | nth, 0, own | nth // max(1, batch_tokens // size))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    start += size
                    if ids:
                        held.append(piece)
            columns = [pa.array(c, pa.int64()) for c in out]
            if ids:
                ends = np.cumsum([0, *out[2]], dtype=np.int32)
                flat = np.concatenate(held).astype(np.int32) if held else np.zeros(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    schema = PIECES + (", ids array<int>" if ids else "")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")).mapInArrow(run, schema)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Packed pieces as Parquet, a folder a bucket (bucket=length): what is read from one needs no padding."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
