"""Toxicity scores: a lexicon trie met by Levenshtein automata, with context windows that tell quotation from abuse.

The lexicon is learned from a bounded sample of labelled rows: words, and stems that many words share, which
nearly only toxic texts hold. Its trie and the Levenshtein automaton of each entry are intersected into a
deterministic table for every GROUP entries: a state is a set of (trie node, edits so far). All words of a text walk a
table together, one character a step, and most die after a few. A word that ends in an accepting state is an entry
with at most its allowed number of misspellings; a stem accepts any ending.

A match is worth the logarithm of how much likelier toxic texts hold its entry than clean ones. Exact and misspelled
matches are valued apart; what a misspelling is worth is seen on copies of the toxic sample texts whose entries are
misspelled. A match weighs by its context: in quotation marks of its line, or after a word of reporting, it counts less,
next to a second person or near another match it counts in full. A logistic model of sums and maxima gives the score.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, map_texts, materialise
from tidewater.llm.labelled import fit_logistic, fold, labelled_sample

#: Entries of one table: states grow faster than the entries of a table, but in proportion to the tables.
GROUP = 64
#: Words around a match: another match makes a run, a word of reporting stands before, a person before or after.
WINDOW, REPORT_BEFORE, PERSON_BEFORE, PERSON_AFTER = 8, 4, 3, 2
QUOTED = 0.35
#: What an entry that a caller adds is worth.
GIVEN = 6.0
# fixed values: marks of quotation, words of reporting and of address in the languages of the corpus. Single marks are
# none of them, since they are apostrophes as well
QUOTES = "\"“”„«»‹›"
REPORTS = frozenset("said says wrote writes quoted quote called term word insult sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split())
PERSONS = frozenset("you your yours u ya du dich dir dein ihr euch tu toi te ton vous votre tú ti usted ustedes vosotros".split())


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class Automaton:
    """A deterministic table over the classes of lexicon letters; class 0 is every other character, state 0 is dead."""

    letters: str
    table: np.ndarray  # states x classes
    entry: np.ndarray  # per state the accepted entry or -1
    edits: np.ndarray  # and its edits
    final: np.ndarray  # per state, whether any ending is accepted
    size: int = field(default=0)


def intersect(terms: list[tuple[str, bool]]) -> Automaton:
    """terms: (entry, whether it is a stem). States are sets of (node, edits, edits allowed); the fewest edits of a node count."""
    nodes: list[dict[str, int]] = [{}]
    ends: list[dict[int, int]] = [{}]  # per node: allowed edits -> entry
    stem = [s for _, s in terms]
    for n, (term, _) in enumerate(terms):
        at = 0
        for c in term:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                ends.append({})
            at = nodes[at][c]
        ends[at][allowed_edits(term)] = n
    below = [set(e) for e in ends]  # allowances of the entries below each node
    for at in range(len(nodes) - 1, -1, -1):
        for child in nodes[at].values():
            below[at] |= below[child]
    letters = "".join(sorted({c for t, _ in terms for c in t}))

    def close(states: dict[tuple[int, int], int]) -> frozenset:
        """Adds what leaving out letters of an entry reaches; keys (node, allowance), values the fewest edits."""
        todo = list(states)
        while todo:
            node, allow = todo.pop()
            e = states[node, allow]
            if e < allow:
                for child in nodes[node].values():
                    if allow in below[child] and states.get((child, allow), 99) > e + 1:
                        states[child, allow] = e + 1
                        todo.append((child, allow))
        return frozenset((n, a, e) for (n, a), e in states.items())

    def step(state: frozenset, c: str) -> frozenset:
        out: dict[tuple[int, int], int] = {}

        def reach(node: int, allow: int, e: int) -> None:
            if e <= allow and allow in below[node] and out.get((node, allow), 99) > e:
                out[node, allow] = e

        for node, allow, e in state:
            for letter, child in nodes[node].items():
                reach(child, allow, e + (letter != c))
            reach(node, allow, e + 1)
        return close(out)

    def accepted(state: frozenset) -> tuple[int, int]:
        found = [(e, ends[n][a]) for n, a, e in state if a in ends[n]]
        return (min(found)[1], min(found)[0]) if found else (-1, 0)

    first = close({(0, a): 0 for a in below[0]})
    index, order, rows = {frozenset(): 0, first: 1}, [frozenset(), first], []
    entry, edits, final = [-1], [0], [False]
    at = 1
    while at < len(order):
        state = order[at]
        n, e = accepted(state)
        entry.append(n)
        edits.append(e)
        # a stem's end is kept only where nothing of the state could still end with fewer edits
        done = n >= 0 and stem[n] and e <= min(x[2] for x in state)
        final.append(done)
        row = []
        for c in ["\0", *letters]:
            target = state if done else step(state, c)
            if target not in index:
                index[target] = len(order)
                order.append(target)
            row.append(index[target])
        rows.append(row)
        at += 1
    table = np.array([[0] * (len(letters) + 1), *rows], dtype=np.int32)
    return Automaton(letters, table, np.array(entry), np.array(edits), np.array(final), len(order))


@functools.cache
def _alphanumeric() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of blank-separated words, without marks around them."""
    open_ = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
    start = np.flatnonzero(open_ & ~np.r_[False, open_[:-1]])
    end = np.flatnonzero(open_ & ~np.r_[open_[1:], False]) + 1
    solid = np.flatnonzero(_alphanumeric()[codes])
    if not len(solid):
        return start[:0], end[:0]
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    has = a <= b
    return solid[a[has]], solid[b[has]] + 1


def intersect_groups(terms: list[tuple[str, bool]], size: int = GROUP) -> tuple[Automaton, ...]:
    """Automata over neighbouring entries, at most ``size`` each; together they hold all terms, numbered as in terms."""
    made = [(at, intersect(terms[at : at + size])) for at in range(0, max(1, len(terms)), size)]
    return tuple(replace(m, entry=np.where(m.entry >= 0, m.entry + at, -1)) for at, m in made)


def _walk(codes: np.ndarray, start: np.ndarray, end: np.ndarray, machine: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words the automaton accepts, and the states in which it does."""
    letters = np.r_[_codes(machine.letters), np.uint32(0x110000)]  # sorted; the last stands for none
    coded = np.searchsorted(letters, codes)
    coded = np.where(letters[coded] == codes, coded + 1, 0)
    live, state, at = np.arange(len(start)), np.ones(len(start), dtype=np.int32), start.copy()
    hits, states = [], []
    while len(live):
        over = (at >= end[live]) | machine.final[state]
        if over.any():
            good = over & (machine.entry[state] >= 0)
            hits.append(live[good])
            states.append(state[good])
            live, state, at = live[~over], state[~over], at[~over]
            if not len(live):
                break
        state = machine.table[state, coded[at]]
        at += 1
        keep = state > 0
        live, state, at = live[keep], state[keep], at[keep]
    hit = np.concatenate(hits) if hits else np.zeros(0, dtype=np.int64)
    state = np.concatenate(states) if states else np.zeros(0, dtype=np.int32)
    return hit, state


def find(codes: np.ndarray, machines: tuple[Automaton, ...], words: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry, edits) of the words that an automaton accepts, by their number in the text, in order.

    Of several automata that accept a word, the one with the fewest edits counts.
    """
    start, end = words or _words(codes)
    found = []
    for machine in machines:
        hit, state = _walk(codes, start, end, machine)
        found.append((hit, machine.entry[state], machine.edits[state]))
    hit, entry, edits = (np.concatenate(column) for column in zip(*found, strict=True))
    order = np.lexsort((entry, edits, hit))
    order = order[np.diff(hit[order], prepend=-1) > 0]
    return hit[order], entry[order], edits[order]


def context_weights(text: str, codes: np.ndarray, start: np.ndarray, end: np.ndarray, hits: np.ndarray, persons: frozenset[str], reports: frozenset[str]) -> np.ndarray:
    """For each of the words ``hits`` of a lower-cased text, 1 for abuse, QUOTED for quotation or report.

    A word is quoted between marks of its line: an odd number before it and one behind it, wherever in the line they are.
    """
    marks = np.flatnonzero(np.isin(codes, _codes(QUOTES)))
    breaks = np.flatnonzero(codes == 10)
    at = start[hits]
    line = np.searchsorted(breaks, at)
    line_start = np.r_[0, breaks + 1][line]
    line_end = np.r_[breaks, len(codes)][line]
    before = np.searchsorted(marks, at) - np.searchsorted(marks, line_start)
    behind = np.searchsorted(marks, line_end) - np.searchsorted(marks, end[hits])
    quoted = (before % 2 == 1) & (behind > 0)
    crowded = np.zeros(len(hits), dtype=bool)
    close = np.diff(hits) <= WINDOW
    crowded[1:] |= close
    crowded[:-1] |= close
    word = lambda k: text[start[k] : end[k]]
    around = lambda i, a, b: {word(k) for k in range(max(0, i - a), min(len(start), i + b + 1)) if k != i}
    out = np.ones(len(hits))
    for n, i in enumerate(hits.tolist()):
        abuse = crowded[n] or bool(persons & around(i, PERSON_BEFORE, PERSON_AFTER))
        if quoted[n] or (not abuse and reports & around(i, REPORT_BEFORE, 0)):
            out[n] = QUOTED
    return out


@dataclass
class Model:
    machines: tuple[Automaton, ...]
    exact: np.ndarray  # per entry, what an exact match is worth
    near: np.ndarray  # and a misspelled one
    clean: frozenset[str]  # misspelled forms that clean sample texts use
    persons: frozenset[str]
    reports: frozenset[str]
    weights: np.ndarray


FEATURES = 5


def evidence(text: str, model: Model) -> tuple[float, ...]:
    """Of one whole text, for exact and for misspelled matches: the square of the largest worth, and the logarithm of what
    the others are worth together. Last, the logarithm of the number of words: in long texts more words match by chance.
    """
    lowered = text.lower()
    codes = _codes(lowered)
    start, end = _words(codes)
    hits, entry, edits = find(codes, model.machines, (start, end))
    if len(hits) and edits.any():
        used = np.array([not e or lowered[start[k] : end[k]] not in model.clean for k, e in zip(hits.tolist(), edits.tolist(), strict=True)])
        hits, entry, edits = hits[used], entry[used], edits[used]
    length = float(np.log1p(len(start)))
    if not len(hits):
        return (*(0.0,) * (FEATURES - 1), length)
    worth = context_weights(lowered, codes, start, end, hits, model.persons, model.reports) * np.where(edits == 0, model.exact[entry], model.near[entry])
    out: list[float] = []
    for kind in (worth[edits == 0], worth[edits > 0]):
        most = kind.max(initial=0.0)
        out += [float(most**2 / 10), float(np.log1p(max(0.0, kind.sum() - most)))]
    return *out, length


def misspelled(text: str, machines: tuple[Automaton, ...], terms: list[tuple[str, bool]]) -> str:
    """A lower-cased text in which every exact match of an entry that allows edits has another letter in its middle."""
    lowered = text.lower()
    codes = _codes(lowered)
    start, end = _words(codes)
    out, at = [], 0
    for word, entry, edits in zip(*(x.tolist() for x in find(codes, machines, (start, end))), strict=True):
        term = terms[entry][0]
        if edits == 0 and allowed_edits(term):
            middle = int(start[word]) + len(term) // 2
            out += [lowered[at:middle], "x" if lowered[middle] != "x" else "y"]
            at = middle + 1
    return "".join(out) + lowered[at:]


#: Letters that a stem has at least; shorter entries are whole words.
STEM = 4


def _counted(longest: int):
    """Per batch, (term, whole word or prefix, the word before or null, clean and toxic texts).

    Toxic texts also give each term with the words it follows: copies of one text repeat them, abuse turns up anywhere.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            clean: Counter = Counter()
            held: Counter = Counter()
            toxic: set[tuple[str, bool, str]] = set()
            for text, y in zip(batch["text"], batch["y"], strict=True):
                lowered = text.lower()
                start, end = _words(_codes(lowered))
                words = [lowered[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                own = set()
                for before, word in {*zip(["", *words], words, strict=False)}:
                    keys = [(word[:n], False) for n in range(STEM, min(len(word), longest) + 1)] + [(word, True)]
                    if y:
                        toxic.update((*k, before) for k in keys)
                    own.update(keys)
                (held if y else clean).update(own)
            rows = [(t, w, None, clean[t, w], held[t, w]) for t, w in clean.keys() | held.keys()] + [(t, w, b, 0, 0) for t, w, b in toxic]
            yield pd.DataFrame(rows, columns=["term", "whole", "before", "clean", "toxic"])

    return run


def learn_lexicon(sample: DataFrame, *, least: int, ratio: float, longest: int) -> dict[tuple[str, bool], float]:
    """Entries of a labelled sample, (word, False) or (stem, True), with what an exact match is worth.

    All that pass, since the sample is bounded: an entry follows at least ``least`` different words in toxic texts, and
    their share that holds it is ``ratio`` times that of clean texts. Stems have STEM to ``longest`` letters; words have
    any number. Of a chain of ever longer prefixes that the same texts hold, the longest is the entry.
    """
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return {}
    seen = sample.mapInPandas(_counted(longest), "term string, whole boolean, before string, clean long, toxic long")
    counts = seen.groupBy("term", "whole", "before").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = counts.groupBy("term", "whole").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("before").alias("places"))
    odds = (F.col("toxic") + 0.5) / (totals[1] + 1) / ((F.col("clean") + 0.5) / (totals[0] + 1))
    counts = counts.withColumn("worth", F.log(odds)).where((F.col("places") >= least) & (F.col("toxic") >= least))
    found = counts.where(F.col("worth") >= float(np.log(ratio))).orderBy("term", "whole").collect()
    worth = {(r["term"], not r["whole"]): r["worth"] for r in found}
    stems = {r["term"]: r["toxic"] for r in found if not r["whole"]}
    words = {r["term"]: r["toxic"] for r in found if r["whole"]}
    entries = set()
    for term in stems:
        if any(term[:n] in stems for n in range(STEM, len(term))):
            continue  # a shorter prefix is as telling; it decides below
        best = term
        while longer := [s for s in stems if len(s) == len(best) + 1 and s.startswith(best) and stems[s] >= 0.9 * stems[term]]:
            best = longer[0]
        entries.add((best, words.get(best, 0) < 0.9 * stems[best]))
    entries |= {(w, False) for w in words if not any(w.startswith(e) for e, _ in entries)}
    return {e: worth[e] for e in sorted(entries)}


NEAR = "form string, entry int, clean long, toxic long"


def _near_forms(machines: tuple[Automaton, ...], terms: list[tuple[str, bool]]):
    """Misspelled forms of clean texts, and of toxic ones after misspelled(): one row a text, form and entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                lowered = misspelled(text, machines, terms) if y else text.lower()
                codes = _codes(lowered)
                start, end = _words(codes)
                hits, entry, edits = find(codes, machines, (start, end))
                rows += [(f, n, 1 - y, y) for f, n in {(lowered[start[k] : end[k]], n) for k, n, e in zip(hits.tolist(), entry.tolist(), edits.tolist(), strict=True) if e}]
            yield pd.DataFrame(rows, columns=["form", "entry", "clean", "toxic"])

    return run


def _features_of(model: Model, terms: list[tuple[str, bool]]):
    """Per sample row, its features as it is, and once more: toxic texts misspelled, clean ones again as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, y in zip(batch["id"], batch["text"], batch["y"], strict=True):
                own = evidence(text, model)
                rows += [(doc, list(own), y), (doc, list(evidence(misspelled(text, model.machines, terms), model) if y else own), y)]
            yield pd.DataFrame(rows, columns=["id", "x", "y"])

    return run


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the features and the intercept; no match speaks against toxicity, so no weight of one is negative."""
    used = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, used], y, ridge=0.2)
        if len(used) == 1 or w[:-2].min() >= 0:
            break
        used.pop(int(w[:-2].argmin()))
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, parts: int, held_out: int, train_rows: int, least: int, ratio: float, longest: int, lexicon: tuple[str, ...],
    persons: frozenset[str], reports: frozenset[str],
) -> Model:
    sample = labelled_sample(docs, labels, "toxic", parts, held_out, train_rows).cache()
    try:
        learned = learn_lexicon(sample, least=least, ratio=ratio, longest=longest)
        learned = {(w.lower(), False): GIVEN for w in lexicon} | learned
        terms = sorted(learned)
        machines = intersect_groups(terms)
        forms = sample.mapInPandas(_near_forms(machines, terms), NEAR).groupBy("form", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        forms = materialise(forms, "near-forms")
        clean = frozenset(r["form"] for r in forms.where("clean >= 2").select("form").collect())
        totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
        near = np.zeros(len(terms))
        for r in forms.where("clean < 2").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect():
            near[r["entry"]] = max(0.0, np.log((r["toxic"] + 0.5) / (totals.get(1, 0) + 1) / ((r["clean"] + 0.5) / (totals.get(0, 0) + 1))))
        discard(forms)
        model = Model(machines, np.array([learned[t] for t in terms]), near, clean, persons, reports, np.zeros(FEATURES + 1))
        got = sample.mapInPandas(_features_of(model, terms), "id long, x array<double>, y int").toPandas()
    finally:
        sample.unpersist()
    got["order"] = [tuple(x) for x in got["x"]]
    got = got.sort_values(["id", "y", "order"])
    model.weights = fit_weights(np.array(got["order"].tolist(), dtype=float).reshape(-1, FEATURES), got["y"].to_numpy(dtype=float))
    return model


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    *,
    parts: int = 5,
    held_out: int = 0,
    train_rows: int = 8000,
    threshold: float = 0.5,
    least: int = 8,
    ratio: float = 30.0,
    longest: int = 12,
    lexicon: tuple[str, ...] = (),
    persons: frozenset[str] = PERSONS,
    reports: frozenset[str] = REPORTS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The model reads labels of the other folds only, from at most train_rows rows; ``lexicon`` adds entries to the
    learned ones, ``persons`` and ``reports`` are the words of address and of reporting. Null and empty texts get the
    score of no evidence. Rows without id keep a null id and held_out false. Repeated rows stay, an empty table gives no
    rows. Of docs only doc_id and text are read, and texts of any length whole.
    """
    fitted = fit_toxicity(
        docs, labels, parts=parts, held_out=held_out, train_rows=train_rows, least=least, ratio=ratio, longest=longest, lexicon=lexicon, persons=persons, reports=reports
    )
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def scored(texts: list[str]) -> list[np.ndarray]:
        m = model.value
        x = np.array([evidence(t, m) for t in texts]).reshape(-1, FEATURES)
        return [1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -35, 35)))]

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("body")), "body", "score double", scored)
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
