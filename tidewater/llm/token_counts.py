"""Token counts through a digest cache.

A text's blank runs become one space where its tokenizer drops blanks anyway; the SHA-256 of that content and of
the tokenizer's version are the key of a stored count. Only contents without a stored count are encoded, once
each, and appended. Copies meet in a partial aggregation before any shuffle, so a third of all rows may be one text.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
import json
import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import BLANKS, map_texts, materialise, text_or_empty

CACHE_SCHEMA = "content string, n_tokens long, tokenizer string"


def _drops_blanks(path: str) -> bool:
    """Whether a text has the tokens of its blank-separated words, one after the other."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    return any(s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps) and (
        splits.get("type"), splits.get("behavior"), splits.get("invert")) == ("Split", "Removed", True) and r"[^\s" in str(splits.get("pattern"))


def tokenizer_digest(path: str) -> str:
    """Names what a count depends on: the file, the library's version and how contents are normalised."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        seen = hashlib.sha256(f.read())
    seen.update(f"{library} {importlib.metadata.version(library)} blanks:{_drops_blanks(path)}".encode())
    return seen.hexdigest()


@functools.cache
def _encoder(path: str):
    """A function from texts to token counts, built once a worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


@functools.cache
def _words_seen(path: str) -> dict[bytes, int]:
    return {}


_held: dict[str, int] = {}  # bytes of _words_seen


#: What a remembered word takes besides its own bytes: an object, its number and its place in the table.
WORD_BYTES = 150


def count_tokens(texts: list[str], path: str, memo_bytes: int) -> list[int]:
    """The library's counts of whole texts.

    Where a tokenizer drops blanks, words are encoded once and remembered, in about memo_bytes of memory a worker; a
    text with more words than that has them all in memory while it is counted.
    """
    encode = _encoder(path)
    if not _drops_blanks_cached(path):
        return [n for at in range(0, len(texts), 64) for n in encode(texts[at : at + 64])]
    seen, counts = _words_seen(path), []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        if new := list(set(words) - seen.keys()):
            held = _held[path] = _held.get(path, 0) + sum(map(len, new)) + WORD_BYTES * len(new)
            if held > memo_bytes and seen:
                seen.clear()
                new = list(set(words))
                _held[path] = sum(map(len, new)) + WORD_BYTES * len(new)
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                seen.update(zip(part, encode([w.decode("utf-8", "surrogatepass") for w in part]), strict=True))
        counts.append(sum(map(seen.__getitem__, words)))
    return counts


_drops_blanks_cached = functools.cache(_drops_blanks)


def _stored(spark, cache: str, tokenizer: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.select("content", "n_tokens")


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache: str,
    *,
    limit: int = 2048,
    memo_bytes: int = 64_000_000,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens (as the library gives), over_limit.

    The folder ``cache`` holds (content digest, count) by tokenizer digest; this call appends what was missing, and
    a second call over the same texts encodes nothing. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows
    and null ids stay, an empty table gives no rows, other columns are not read. Two writers at once may store a
    count twice; readers take one.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(tokenizer_path)
    raw = text_or_empty(text)
    content = F.trim(F.regexp_replace(raw, f"[{BLANKS}]+", " ")) if _drops_blanks(tokenizer_path) else raw
    digested = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), content.alias("body"))
    digested = digested.withColumn("content", F.sha2(F.col("body"), 256))

    def counted(bodies: list[str]) -> list[list[int]]:
        return [count_tokens(bodies, tokenizer_path, memo_bytes)]

    misses = digested.groupBy("content").agg(F.first("body").alias("body")).join(_stored(spark, cache, tokenizer), "content", "left_anti")
    made = map_texts(misses.select("content", "body"), "body", "n_tokens long", counted)
    made.withColumn("tokenizer", F.lit(tokenizer)).write.partitionBy("tokenizer").mode("append").parquet(cache)
    # written, so that the join can split the rows of one text with very many copies
    counts = materialise(_stored(spark, cache, tokenizer).groupBy("content").agg(F.first("n_tokens").alias("n_tokens")), "counts")
    return digested.select("doc_id", "n_bytes", "content").join(counts, "content").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
