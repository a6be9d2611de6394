import math
import random
import re

import numpy as np
import pytest

from tidewater.llm.labelled import labelled_sample
from tidewater.llm.toxicity import (
    FEATURES, PERSON_AFTER, PERSON_BEFORE, PERSONS, QUOTED, QUOTES, REPORT_BEFORE, REPORTS, WINDOW, Model, _codes, _words, allowed_edits, context_weights, evidence, find,
    fit_toxicity, intersect_groups, learn_lexicon, misspelled, toxicity_scores,
)


def found(text, machines):
    """(start, end, entry, edits) of every match in a text."""
    start, end = _words(_codes(text))
    word, entry, edits = find(_codes(text), machines)
    return start[word], end[word], entry, edits


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, i, x, b)
    return row


def _next(row, i, x, b):
    out = [i + 1]
    for j, y in enumerate(b):
        out.append(min(row[j] + (x != y), row[j + 1] + 1, out[-1] + 1))
    return out


def best(word, terms):
    """Fewest edits over all entries, whole words exactly and stems over every prefix of the word."""
    found = []
    for t, stem in terms:
        ends = range(len(word) + 1) if stem else [len(word)]
        e = min(distance(t, word[:n])[-1] for n in ends)
        if e <= allowed_edits(t):
            found.append(e)
    return min(found, default=None)


def test_automaton_accepts_what_the_distance_allows():
    rng = random.Random(3)
    terms = [("idiot", False), ("disgusting", False), ("scum", False), ("lowei", True), ("chlla", True), ("idle", False), ("idiots", True)]
    machine = intersect_groups(terms)
    words = [t for t, _ in terms]
    for _ in range(3000):
        w = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < 0.3:
                w.insert(at, rng.choice("abcdilostuxé1"))
            elif kind < 0.6 and len(w) > 1:
                w.pop(min(at, len(w) - 1))
            elif w:
                w[min(at, len(w) - 1)] = rng.choice("abcdilostuxé1")
        words.append("".join(w) + rng.choice(["", "", "ende"]))
    text = " ,\n".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 3
    start, end, _, edits = found(text, machine)
    got = dict(zip(start.tolist(), edits.tolist(), strict=True))
    for s, w in zip(starts, words, strict=True):
        want = best(w, terms)
        assert (s in got) == (want is not None), w
        assert all(text[a:b] in words for a, b in zip(start, end, strict=True))


def test_groups_of_entries_accept_what_all_of_them_allow():
    rng = random.Random(5)
    syllables = "ba de fi gu ko la me ni po ru sa te vi wo zu".split()
    terms = sorted({("".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))), rng.random() < 0.3) for _ in range(150)})
    machines = intersect_groups(terms, 16)
    assert len(machines) == -(-len(terms) // 16)
    words = [t for t, _ in terms]
    for t, _ in terms * 2:
        at = rng.randrange(len(t))
        words.append(t[:at] + rng.choice("abeiou") + t[at + rng.randint(0, 1) :])
    text = " ".join(words)
    start, end, entry, edits = found(text, machines)
    assert (np.diff(start) > 0).all()
    got = {text[a:b]: (n, e) for a, b, n, e in zip(start.tolist(), end.tolist(), entry.tolist(), edits.tolist(), strict=True)}
    for w in words:
        assert (got[w][1] if w in got else None) == best(w, terms), w
        assert w not in got or best(w, [terms[got[w][0]]]) == got[w][1]


def test_every_entry_that_passes_is_learned(spark):
    insults = [f"{a}{b}rk" for a in "qa we zi ku ro ti ha je mu".split() for b in "du mo lo pe na be su la vi".split()]
    words = [f"w{i}" for i in range(12)]
    rows = [(n, f"{words[n % 12]} {insult} w0", 1) for n, insult in enumerate(i for i in insults for _ in range(12))]
    rows += [(2000 + n, f"{words[n % 12]} calm w0", 0) for n in range(2000)]
    sample = spark.createDataFrame(rows, "id long, text string, y int")
    learned = learn_lexicon(sample, least=8, ratio=30.0, longest=12)
    covered = [i for i in insults if any(i == e or stem and i.startswith(e) for e, stem in learned)]
    assert covered == insults


def weighed(text, term="idiot"):
    lowered = text.lower()
    start, end = _words(_codes(lowered))
    hits = np.array([i for i, (a, b) in enumerate(zip(start, end)) if lowered[a:b] == term], dtype=int)
    return context_weights(lowered, _codes(lowered), start, end, hits, PERSONS, REPORTS).tolist()


def by_hand(text, term="idiot"):
    """The weights word by word: marks of the line counted, neighbours compared."""
    lines, out = text.lower().split("\n"), []
    words = [(n, w) for n, line in enumerate(lines) for w in line.split() if any(map(str.isalnum, w))]
    hits = [k for k, (_, w) in enumerate(words) if w.strip("\"“”.,") == term]
    seen = {}
    for k in hits:
        n, _ = words[k]
        nth = seen[n] = seen.get(n, 0) + 1
        cut = -1
        for _ in range(nth):
            cut = lines[n].index(term, cut + 1)
        marks = lambda t: sum(t.count(q) for q in "\"“”„«»‹›")
        quoted = marks(lines[n][:cut]) % 2 == 1 and marks(lines[n][cut:]) > 0
        bare = lambda a, b: {w.strip("\"“”.,") for _, w in words[max(0, a) : b]}
        abuse = any(0 < abs(k - j) <= 8 for j in hits) or PERSONS & (bare(k - 3, k) | bare(k + 1, k + 3))
        out.append(QUOTED if quoted or (not abuse and REPORTS & bare(k - 4, k)) else 1.0)
    return out


def test_context_separates_quotation_from_abuse():
    assert weighed("you are such an idiot today") == [1] and weighed('the word "idiot" is old') == [QUOTED] and weighed("he wrote idiot on it") == [QUOTED]
    assert weighed("l'ami d'hier, c'est un idiot qu'il n'aime") == [1] and weighed("“" + "far " * 500 + "idiot " + "off " * 500 + "”") == [QUOTED]
    assert weighed('"an old quotation' + " ends" * 40 + '" and then idiot "x"') == [1] and weighed('"open\nidiot closed"') == [1]
    rng = random.Random(9)
    bits = ["idiot", '"', "you", "said", "\n", "far", "off", "“idiot”", "idiot.", "“", "”", "du", "wort"]
    for _ in range(400):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(1, 40)))
        assert weighed(text) == by_hand(text), text


def test_evidence_and_misspelling():
    terms = [("idiot", False), ("oaf", False), ("\U00030001\U00030002\U00030003", False)]
    model = Model(intersect_groups(terms), np.array([5.0, 4.0, 3.0]), np.array([2.0, 0.0, 0.0]), frozenset({"idyot"}), PERSONS, REPORTS, np.zeros(FEATURES + 1))
    assert evidence("", model) == evidence(" \n", model) == (0.0,) * FEATURES
    assert evidence("an idi0t", model) == pytest.approx((0.0, 0.0, 0.4, 0.0, np.log(3))) and evidence("an idyot", model)[:4] == (0.0,) * 4
    assert evidence("oaf idiot", model)[:4] == pytest.approx((2.5, np.log(5), 0.0, 0.0))
    assert evidence("\U00030001\U00030002\U00030003", model)[0] == 0.9 and evidence("\U00030001\U00030002\U00030004", model)[0] == 0
    assert misspelled("Idiot, oaf idiot.", model.machines, terms) == "idxot, oaf idxot."
    assert evidence("x", Model(intersect_groups([]), np.zeros(0), np.zeros(0), frozenset(), PERSONS, REPORTS, np.zeros(6)))[0] == 0


def test_held_out_accuracy_and_rows(spark):
    rng = random.Random(4)
    prose = lambda n: ["".join(rng.choice("er tion the an ou in es".split()) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    rows = []
    for i in range(900):
        words, toxic = prose(rng.randint(20, 80)), int(rng.random() < 0.3)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["oaf", "idiot", "moron.", "worthless", "Idiot!", "lowei" + rng.choice(["ä", "x", "st", "mu"])])
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t, _ in rows] + [(None, "idiot", "", 0), (2000, None, "", 0), (2001, "", "", 0), (2002, "idi0t wortless idiot " + "x " * 60_000, "", 0), (3, rows[3][1], "", 0), (3000, "er tion the idiit an ou", "", 0), (3001, "er worthlezs the an", "", 0), (3002, "er tion the an ou in es", "", 0)], "doc_id long, text string, toxic string, predicted int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 120 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert [r.predicted for r in got if r.doc_id == 2002] == [1]
    assert [r.predicted for r in sorted(got, key=lambda r: r.doc_id or 0) if (r.doc_id or 0) >= 3000] == [1, 1, 0]
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) toxic")
    assert sorted(map(str, toxicity_scores(docs, flipped).collect())) == sorted(map(str, got))
    assert toxicity_scores(docs.limit(0), labels).collect() == []
    assert {r.score for r in toxicity_scores(docs.limit(3), labels.limit(0)).collect()} == {0.5}


def plain_evidence(text, terms, model):
    """By definition: every word against every entry by dynamic programming, context by counting marks and looking around."""
    low = text.lower()
    spans = []
    for m in re.finditer(r"[^\x20\x09-\x0d]+", low):
        solid = [i for i in range(m.start(), m.end()) if low[i].isalnum()]
        if solid:
            spans.append((solid[0], solid[-1] + 1))
    words, hits = [low[a:b] for a, b in spans], {}
    for k, w in enumerate(words):
        near = []
        for n, (t, stem) in enumerate(terms):
            e = min(distance(t, w[:size])[-1] for size in (range(len(w) + 1) if stem else [len(w)]))
            if e <= allowed_edits(t):
                near.append((e, n))
        if near and (min(near)[0] == 0 or w not in model.clean):
            hits[k] = min(near)
    worth = {0: [], 1: []}
    for k, (e, n) in hits.items():
        a, b = spans[k]
        first, last = low.rfind("\n", 0, a) + 1, low.find("\n", a) if "\n" in low[a:] else len(low)
        quoted = sum(c in QUOTES for c in low[first:a]) % 2 == 1 and any(c in QUOTES for c in low[b:last])
        abuse = any(0 < abs(k - j) <= WINDOW for j in hits) or model.persons & {words[j] for j in range(max(0, k - PERSON_BEFORE), min(len(words), k + PERSON_AFTER + 1)) if j != k}
        report = not abuse and model.reports & set(words[max(0, k - REPORT_BEFORE) : k])
        worth[e > 0].append((QUOTED if quoted or report else 1) * (model.near if e else model.exact)[n])
    out = []
    for kind in (worth[0], worth[1]):
        most = max(kind, default=0.0)
        out += [most**2 / 10, math.log1p(max(0.0, sum(kind) - most))]
    return [*out, math.log1p(len(words))]


def test_scores_against_plain_arithmetic(spark):
    rng = random.Random(14)
    prose = lambda n: ["".join(rng.choice("er tion the an ou in es".split()) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    rows = []
    for i in range(500):
        words, toxic = prose(rng.randint(10, 30)), int(rng.random() < 0.35)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["oaf", "idiot", "moron.", "worthless", "Idiot!", "you idiot", '"moron"', "said worthless\n"])
        rows.append((i, " ".join(words), toxic))
    odd = [(900, 'the wörthless "idi0t" said\nyou moron'), (901, "wortless idiots oaf"), (902, ""), (903, "— “idiot” —")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    how = {"least": 8, "ratio": 30.0, "longest": 12}
    learned = learn_lexicon(labelled_sample(docs, labels, "toxic", 5, 0, 8000), **how)
    model = fit_toxicity(docs, labels, parts=5, held_out=0, train_rows=8000, lexicon=(), persons=PERSONS, reports=REPORTS, **how)
    terms = sorted(learned)
    assert terms and model.exact.tolist() == [learned[t] for t in terms]
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    for i, text in [(i, t) for i, t, _ in rows[:150]] + odd:
        x = plain_evidence(text, terms, model)
        assert list(evidence(text, model)) == pytest.approx(x), text
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights[:-1], strict=True)) + model.weights[-1]))))
