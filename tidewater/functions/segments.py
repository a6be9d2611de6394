"""Segmentation of unspaced text by a dictionary: all words of a run form a graph, and the best path through it is taken.

One pass of an Aho-Corasick automaton finds every dictionary word of a run. Where words overlap, forward matching takes the
first and is stuck with it; here every way to cut the run competes: as few characters as possible that belong to no
word, then as few words as possible, then the likeliest words by their counts (or the likeliest before the fewest).
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
#: Runs of Chinese characters, the default of what is cut.
CJK = r"[㐀-鿿]+"


class Segmenter:
    """Words with their counts, as an automaton."""

    def __init__(self, counts: Mapping[str, int], *, likeliest: bool = False, runs: str = CJK):
        total = sum(counts.values())
        self.likeliest, self.runs = likeliest, re.compile(runs)
        self.automaton = ahocorasick.Automaton()
        for word, n in counts.items():
            if word and n > 0:
                self.automaton.add_word(word, (len(word), math.log(total / n)))
        self.known = len(self.automaton) > 0
        if self.known:
            self.automaton.make_automaton()

    def graph(self, run: str) -> list[list[tuple[int, float]]]:
        """By end, the start and cost of every dictionary word that ends there."""
        edges: list[list[tuple[int, float]]] = [[] for _ in range(len(run) + 1)]
        if self.known:
            for last, (size, cost) in self.automaton.iter(run):
                edges[last + 1].append((last + 1 - size, cost))
        return edges

    def cut(self, run: str) -> list[str]:
        """The words of the best path; characters of no word are words of their own. Of equal paths, the longest last word."""
        best: list[tuple] = [(0, 0, 0)]
        back = [0]
        for end, edges in enumerate(self.graph(run)[1:], start=1):
            ways = []
            for start, cost in [*edges, (end - 1, None)]:
                unknown, a, b = best[start]
                if cost is None:
                    step = (unknown + 1, a + (not self.likeliest), b + self.likeliest)
                else:
                    step = (unknown, a + cost, b + 1) if self.likeliest else (unknown, a + 1, b + cost)
                ways.append((step, start))
            step, start = min(ways)
            best.append(step)
            back.append(start)
        out, at = [], len(run)
        while at:
            out.append(run[back[at] : at])
            at = back[at]
        return out[::-1]

    def tokens(self, text: str | None) -> list[str]:
        """Lower-cased runs of letters and digits, of which those that ``runs`` matches are cut."""
        out: list[str] = []
        for word in WORDS.findall((text or "").lower()):
            last = 0
            for run in self.runs.finditer(word):
                if run.start() > last:
                    out.append(word[last : run.start()])
                out += self.cut(run[0])
                last = run.end()
            if last < len(word):
                out.append(word[last:])
        return out


def dictionary_of(words: DataFrame, column: str, *, most: int = 500_000) -> dict[str, int]:
    """Words of a column with their counts, for a Segmenter. More than ``most`` different words are an error."""
    counts = words.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    got = counts.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a dictionary has at most {most} words")
    return {r["word"]: r["n"] for r in sorted(got)}


def segments(text: Column, counts: Mapping[str, int], *, likeliest: bool = False, runs: str = CJK) -> Column:
    """array<string> of tokens. A worker builds the automaton once; batches of texts go to Python."""
    built: list[Segmenter] = []

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        if not built:
            built.append(Segmenter(counts, likeliest=likeliest, runs=runs))
        return texts.map(built[0].tokens)

    return cut(text)
