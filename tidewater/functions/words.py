"""Tokens of search keywords and product names, and the table functions for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
CJK = re.compile(r"[㐀-鿿]+")
#: What product keyword rows are called, in the order in which they come.
SOURCES = ("CLICK", "CART", "ORDER")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def dictionary_tokens(text: Column, dictionary: Iterable[str]) -> Column:
    """As tokens(), with runs of Chinese characters cut by a dictionary. Batches go to Python; without one, use tokens()."""
    known = frozenset(dictionary)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tokenize(t, known))

    return cut(text)


def segment(run: str, dictionary: frozenset[str], longest: int) -> Iterator[str]:
    """Forward maximum matching: at every place the longest word of the dictionary, or else one character."""
    at = 0
    while at < len(run):
        size = next((n for n in range(min(longest, len(run) - at), 1, -1) if run[at : at + n] in dictionary), 1)
        yield run[at : at + size]
        at += size


def tokenize(text: str | None, dictionary: frozenset[str] = frozenset()) -> list[str]:
    """As tokens(), except that runs of Chinese characters are cut by a dictionary, if there is one."""
    found = re.findall(r"[^\W_]+", (text or "").lower())
    if not dictionary:
        return found
    longest = max(map(len, dictionary))
    out: list[str] = []
    for word in found:
        last = 0
        for run in CJK.finditer(word):
            out += [word[last : run.start()]] * (run.start() > last)
            out += segment(run[0], dictionary, longest)
            last = run.end()
        out += [word[last:]] * (last < len(word))
    return out


def action_rows(click: Column, cart: Column, order: Column) -> Column:
    """array<struct<ct, source>> of the positive counts, clicks first."""
    rows = F.array(*[F.struct(n.cast("long").alias("ct"), F.lit(s).alias("source")) for n, s in zip((click, cart, order), SOURCES, strict=True)])
    return F.filter(rows, lambda r: r["ct"] > 0)


def register_functions(spark: SparkSession, dictionary: Iterable[str] = ()) -> None:
    """ik_analyze(text) and keywordProductC2R(click, cart, order) as table functions for LATERAL in SQL."""
    words = frozenset(dictionary)

    class Analyze:
        def eval(self, text: str):
            for word in tokenize(text, words):
                yield (word,)

    class Unpivot:
        def eval(self, click: int, cart: int, order: int):
            for ct, source in zip((click, cart, order), SOURCES, strict=True):
                if ct is not None and ct > 0:
                    yield ct, source

    spark.udtf.register("ik_analyze", F.udtf(Analyze, returnType="word string"))
    spark.udtf.register("keywordProductC2R", F.udtf(Unpivot, returnType="ct bigint, source string"))
