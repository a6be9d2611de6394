"""Periodic runs of words by a suffix automaton.

The automaton of a text joins the end positions of its repeated stretches: a state's set is that of its children in
the tree of suffix links, and its length L is how far back the words before any two of its ends from different
children agree, no further. Sets are merged from the longest state up, the smaller into the larger, in order. When an
end enters a set, its distance d to each new neighbour is compared with L: if d <= L, the stretch before the later of
both ends has period d for L + d words, which is at least a square. Its start is exact; its end is extended while words
d apart agree.

Of a run with smallest period q and at least 4 q words, the last two ends q apart are neighbours in the set in which
they first meet: an end between them would give the run a smaller period. So every such run is found. A multiple of q
may be seen as well, before the ends between have come in; it covers the same stretch, of which the smallest period is
kept.

A run of 4 q (and 6) words or more holds each of its pairs of words three times or more, and each of its fours twice
or more. Pairs and fours that the text holds less often bound the stretches in which runs can lie; an automaton is
built for each stretch of 6 words or more.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, map_texts

LEAST_WORDS, LEAST_PERIODS = 6, 4
MADE = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Ends in a block of an ordered set; a full one is halved.
BLOCK = 512
_first = itemgetter(0)


class Ends:
    """An ordered set of end positions in blocks, so that an insertion moves one block's ends at most."""

    __slots__ = ("blocks", "size")

    def __init__(self, end: int):
        self.blocks, self.size = [[end]], 1

    def add(self, end: int) -> tuple[int, int]:
        """Its neighbours before and after, or -1; the end itself is new."""
        blocks = self.blocks
        i = max(bisect_right(blocks, end, key=_first) - 1, 0) if len(blocks) > 1 else 0
        block = blocks[i]
        j = bisect_left(block, end)
        before = block[j - 1] if j else -1
        after = block[j] if j < len(block) else blocks[i + 1][0] if i + 1 < len(blocks) else -1
        block.insert(j, end)
        self.size += 1
        if len(block) > BLOCK:
            blocks[i : i + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]
        return before, after


def automaton(words: list[int]) -> tuple[array, array, array, int]:
    """(length, link, end, number) of the states of the suffix automaton of numbers; end is -1 for clones and the root.

    Most states have one transition, which two arrays hold; only the others have a table.
    """
    top = 2 * len(words) + 1
    length, link, end, word, to = (array("i", [-1]) * top for _ in range(5))
    more: dict[int, dict[int, int]] = {}
    length[0], size, last = 0, 1, 0
    for at, c in enumerate(words):
        new, state, met = size, last, -1
        size += 1
        length[new], end[new] = at + 1, at
        while state >= 0:
            if word[state] == c:
                met = to[state]
                break
            if word[state] < 0:
                word[state], to[state] = c, new
            else:
                further = more.setdefault(state, {})
                if (known := further.get(c)) is not None:
                    met = known
                    break
                further[c] = new
            state = link[state]
        last = new
        if met < 0:
            link[new] = 0
        elif length[state] + 1 == length[met]:
            link[new] = met
        else:
            clone = size
            size += 1
            length[clone], link[clone], word[clone], to[clone] = length[state] + 1, link[met], word[met], to[met]
            if met in more:
                more[clone] = dict(more[met])
            while state >= 0:
                if word[state] == c:
                    if to[state] != met:
                        break
                    to[state] = clone
                else:
                    further = more.get(state)
                    if further is None or further.get(c) != met:
                        break
                    further[c] = clone
                state = link[state]
            link[met] = link[new] = clone
    return length, link, end, size


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """The largest end by (period, start) of stretches that hold a period twice or more; starts can't be moved back."""
    length, link, end, size = automaton(words)
    sets: dict[int, Ends] = {}
    found: dict[tuple[int, int], int] = {}
    for state in np.argsort(-np.frombuffer(length, dtype=np.int32)[:size], kind="stable").tolist():
        above = link[state]
        if above <= 0:  # the root's length is 0
            sets.pop(state, None)
            continue
        own = sets.pop(state, None) or Ends(end[state])
        held = sets.get(above)
        if held is None and end[above] >= 0:
            held = Ends(end[above])
        if held is None:
            sets[above] = own
            continue
        if held.size < own.size:
            held, own = own, held
        sets[above], long, mine = held, length[above], -1
        for block in own.blocks:
            for at in block:
                before, after = held.add(at)
                # an end of the same child has met this one before, with a longer length
                if before != mine and at - before <= long:
                    key = (at - before, before - long + 1)
                    if found.get(key, -1) < at:
                        found[key] = at
                if 0 <= after - at <= long:
                    key = (after - at, at - long + 1)
                    if found.get(key, -1) < after:
                        found[key] = after
                mine = at
    return found


def _stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches of LEAST_WORDS or more that can hold runs."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    _, pairs, counts = np.unique(words[:-1] * n + words[1:], return_inverse=True, return_counts=True)
    good = counts[pairs] >= 3
    if good.sum() < LEAST_WORDS - 1:
        return []
    _, fours, counts = np.unique(pairs[:-2] * n + pairs[2:], return_inverse=True, return_counts=True)
    four = (counts[fours] >= 2) & good[:-2] & good[1:-1] & good[2:]
    edges = np.flatnonzero(np.diff(np.r_[False, four, False]))
    return [(a, b + 3) for a, b in edges.reshape(-1, 2).tolist() if b + 3 - a >= LEAST_WORDS]


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of numbered words (from 0, below their count), by start and then period."""
    out = []
    for low, high in _stretches(words):
        part = words[low:high].tolist()
        best: dict[tuple[int, int], int] = {}
        for (period, start), end in squares(part).items():
            while end + 1 < len(part) and part[end + 1] == part[end + 1 - period]:
                end += 1
            if end - start + 1 >= max(LEAST_WORDS, LEAST_PERIODS * period):
                best[start, end] = min(period, best.get((start, end), period))
        out += [(low + start, end - start + 1, period) for (start, end), period in best.items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(text: str) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that no run holds after its first period, joined by one space."""
    words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at the ASCII blanks alone
    numbers: dict[bytes, int] = {}
    runs = runs_of(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64))
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept).tolist()]
        return len(kept), runs, b" ".join(words).decode("utf-8", "surrogatepass")
    return len(words), runs, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (by start, then period) and collapsed, the text without repetitions.

    A run is a stretch of consecutive words with smallest period q, at least 6 and 4 q long, that can't be extended.
    Null texts count as empty: no words, no runs, an empty collapsed text. Repeated rows and null ids stay, an empty
    table gives no rows, other columns are not read. Row by row; nothing is shuffled.
    """

    def of(texts: list[str]) -> list[list]:
        counts, runs, kept = zip(*map(collapse, texts), strict=True)
        return [list(counts), [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs], list(kept)]

    return map_texts(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body")), "body", MADE, of)


def planted(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text, in which every tenth document (by the CRC-32 of its id) repeats a period of words to its end.

    With h the CRC-32 of the decimal id, g = h div 10 and n words: where h % 10 = 0 and n > 0, word i from a = g % n on
    becomes word a + (i - a) % p, with p = 1 + (n - a) div (3 + g % 8). Documents without id or words stay as they are.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    blanks = WORD.replace("\\", "\\\\")
    turned = f"""transform(array(regexp_extract_all(text, '{blanks}', 0)), w ->
        transform(array(h div 10), g -> transform(array(int(g % size(w))), a -> transform(array(int(1 + (size(w) - a) div (3 + g % 8))), p ->
        array_join(transform(sequence(0, size(w) - 1), i -> w[if(i < a, i, a + (i - a) % p)]), ' '))[0])[0])[0])[0]"""
    return rows.select("doc_id", F.expr(f"if(h % 10 = 0 and text rlike '{blanks}', {turned}, text) as text"))


def run_digest(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_runs, the longest run (ties: the first, then the smallest period), and two digests."""
    longest = F.expr("array_sort(runs, (x, y) -> case when x.length <> y.length then int(sign(y.length - x.length)) when x.start <> y.start then int(sign(x.start - y.start)) else int(sign(x.period - y.period)) end)[0]")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', string(r.start), string(r.length), string(r.period)) || '\\n'), '')")
    top = periodic_runs(docs).withColumn("top", F.when(F.size("runs") > 0, longest))
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
