"""Quality scores by naive Bayes support vectors.

Documents are indicators of n-grams: byte trigrams, and runs of one to three word shapes (case, symbols, marks,
digits, length, same as the word before), hashed into a fixed space. Indicators are scaled by the log-count ratio
of the two classes; a linear hinge-loss model over them is fitted by dual coordinate descent on a bounded sample of
labelled rows, and a part of that sample calibrates margins to probabilities. Texts alone are inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import map_texts, materialise
from tidewater.llm.labelled import fit_logistic, fold, labelled_sample

SPACE = 17  # bits of each of the two hashed spaces
MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros((256, 6), dtype=np.int32)  # upper, lower or beyond ASCII, digit, symbol, exclamation mark, other mark
_KIND[65:91, 0] = _KIND[97:123, 1] = _KIND[128:, 1] = _KIND[48:58, 2] = 1
_KIND[[ord(c) for c in "#*$%&|<>@^~_=+"], 3] = 1
_KIND[ord("!"), 4] = 1
_KIND[[ord(c) for c in ".,;:?'\"()[]{}-/"], 5] = 1
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_PLACE = (np.arange(1, 65, dtype=np.uint64) * MIX) | np.uint64(1)


def _hashed(codes: np.ndarray, space: int) -> np.ndarray:
    return ((codes * MIX) >> np.uint64(64 - SPACE)).astype(np.int64) + (space << SPACE)


def shapes(raw: np.ndarray) -> np.ndarray:
    """A code of ten bits for each word."""
    blank = _BLANK[raw]
    at = np.flatnonzero(~blank)
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])
    size = np.diff(np.r_[first, len(at)])
    own = raw[at]
    counts = np.add.reduceat(_KIND[own], first, axis=0)
    place = (np.arange(len(at)) - np.repeat(first, size)) % 64
    names = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * _PLACE[place], first)
    upper, lower = counts[:, 0], counts[:, 1]
    case = np.where(upper == 0, 0, np.where((upper > 1) & (lower == 0), 2, np.where((upper == 1) & (_KIND[own[first], 0] == 1), 1, 3)))
    length = np.searchsorted([2, 4, 7, 11, 21, 41, 101], size, side="right")
    same = np.r_[False, names[1:] == names[:-1]]
    code = case | (counts[:, 3] > 0) << 2 | (counts[:, 4] > 0) << 3 | (counts[:, 2] > 0) << 4 | (counts[:, 5] > 0) << 5 | same << 6 | length << 7
    return code.astype(np.uint64)


def indicators(text: str) -> np.ndarray:
    """The sorted n-gram indices of a whole text, each once."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    hit = np.zeros(2 << SPACE, dtype=bool)
    if len(raw) >= 3:
        wide = raw.astype(np.uint64)
        hit[_hashed(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], 0)] = True
    words = shapes(raw)
    run = np.zeros(len(words), dtype=np.uint64)
    for n in range(min(3, len(words))):
        run = (run[: len(words) - n] << np.uint64(10) | words[n:]) + np.uint64((n + 1) << 40)
        hit[_hashed(run, 1)] = True
    return np.flatnonzero(hit).astype(np.int32)


@dataclass
class Model:
    weight: np.ndarray  # per n-gram, ratio included
    square: np.ndarray  # squared ratio, for the norm of a document
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        norm = np.sqrt(self.square[found].sum())
        margin = self.bias + (float(self.weight[found].sum() / norm) if norm > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)): one dual variable at a time, with b as one more weight."""
    rng = np.random.default_rng(seed)
    w, b, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    diagonal = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + b) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            change = (new - alpha[i]) * y[i]
            if change:
                w[rows[i]] += change * values[i]
                b += change
                alpha[i] = new
                largest = max(largest, abs(change))
        if largest < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, *, cost: float = 1.0, epochs: int = 20, least_count: int = 3, seed: int = 3) -> Model:
    """A model from n-gram indices and labels of 0 and 1; with one class only, its scores are that class's smoothed share."""
    size, share = 2 << SPACE, (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = np.zeros((2, size), dtype=np.int64)
    for r, z in zip(rows, y.astype(int).tolist(), strict=True):
        counts[z][r] += 1  # a row has each index once
    ratio = np.log((counts[1] + 1.0) / (y.sum() + 2.0)) - np.log((counts[0] + 1.0) / ((1 - y).sum() + 2.0))
    ratio[counts[0] + counts[1] < least_count] = 0
    kept = [r[ratio[r] != 0] for r in rows]
    values = [ratio[r] / max(1e-12, np.linalg.norm(ratio[r])) for r in kept]
    apart = np.arange(len(y)) % 5 == 0  # calibrates
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), dtype=bool)
    learn = np.flatnonzero(~apart)
    costs = cost * len(learn) / (2 * np.where(y[learn] == 1, y[learn].sum(), (1 - y[learn]).sum()))
    w, b = dual_descent([kept[i] for i in learn], [values[i] for i in learn], 2 * y[learn] - 1, size, costs, epochs, seed)
    shown = np.flatnonzero(apart) if apart.any() else learn
    margins = np.array([w[kept[i]] @ values[i] + b for i in shown])
    slope, shift = fit_logistic(margins[:, None], y[shown], ridge=0.05)
    return Model(w * ratio, ratio**2, b, float(slope), float(shift))


def _found(texts: list[str]) -> list[pa.Array]:
    found = [indicators(t) for t in texts]
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))]


def fit_quality(docs: DataFrame, labels: DataFrame, *, parts: int, held_out: int, train_rows: int, train_ngrams: int, label: str = "quality") -> Model:
    """The model of at most train_rows labelled rows with at most train_ngrams n-grams between them.

    Their n-grams are made on the executors. The driver first sees how many each row has, and takes rows in order of a
    hash of their ids up to the bound. A row that alone has more is passed over.
    """
    sample = labelled_sample(docs, labels, label, parts, held_out, train_rows)
    made = materialise(map_texts(sample, "text", "found array<int>", _found).withColumn("h", F.xxhash64("id", F.lit(1))), "quality-sample")
    made = made.where(F.size("found") <= train_ngrams)
    sizes = made.groupBy("h").agg(F.sum(F.size("found")).alias("n")).toPandas().sort_values("h")
    within = sizes["h"][sizes["n"].cumsum() <= train_ngrams]
    got = (made.where(F.col("h") <= int(within.max())) if len(within) else made.limit(0)).select("id", "y", "found").toArrow()
    found = got.column("found").combine_chunks()
    values, ends = found.values.to_numpy(), found.offsets.to_numpy()
    rows = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    ids, y = got.column("id").to_pylist(), got.column("y").to_pylist()
    order = sorted(range(len(rows)), key=lambda i: (ids[i], y[i], rows[i][:50].tolist()))
    return fit([rows[i] for i in order], np.array([y[i] for i in order], dtype=float))


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, parts: int = 4, held_out: int = 2, train_rows: int = 6000, train_ngrams: int = 16_000_000, threshold: float = 0.7
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels of rows in the held-out fold are never read into the model, which fits on a sample of the others (bounded by
    train_rows and train_ngrams, 4 bytes each). Null and empty texts get a score like any
    other; rows without id keep a null id and held_out false. Repeated rows stay, an empty table gives no rows.
    Without labels every score is one half. Of docs only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, parts=parts, held_out=held_out, train_rows=train_rows, train_ngrams=train_ngrams))

    def scored(texts: list[str]) -> list[list[float]]:
        return [[model.value.score(indicators(t)) for t in texts]]

    out = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("body")), "body", "score double", scored)
    return out.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), parts) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
