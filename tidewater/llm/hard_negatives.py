"""Hard negatives by one-dimensional distance keys.

A vector x gets one more component, sqrt(m^2 - |x|^2), with m the largest norm; anchors get 0. The squared distance to an
anchor q is then m^2 + |q|^2 - 2 <q, x>: the largest inner product is the smallest distance. Every vector is stored under
(pivot, distance), its nearest of a few pivots and its distance to it, in blocks sorted by that key.

A vector within r of an anchor has a key within r of the anchor's own distance to the same pivot. A search therefore
scans, pivot by pivot, the key interval of that half-width, and then widens it: only the annuli on both sides that were
not scanned before. It ends when the k-th best found lies within the scanned radius, which certifies the k best, or
when the radius reaches past every vector. First radii, and scores that k vectors are known to reach, come from a bounded
sample; they decide how many rounds there are, not what is found.

The positives of an anchor are the best of its own label. For each of them the negatives are the best of other labels
within a band of scores below the positive's; the bands of one anchor are searched together, in one scan.

Blocks and packets of anchors have a bounded number of rows. A block is sent to the packets one of whose intervals it
meets, and only the best of a block leave its task. Where vectors have no clusters, that is every block and packet: the
work grows as anchors times rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise

FOUND = "anchor_id long, slot int, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
#: Products below this are exact in double precision.
EXACT = float(1 << 53)
LONG = 1 << 63


def whole(vector: Column, factor: int = 256) -> Column:
    """Components multiplied and cut to whole numbers, as doubles; null if the vector or a component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double")))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers with one more, as longs; where doubles might round, by Python's integers.

    What a long can't hold becomes the nearest one.
    """
    if not len(x):
        return np.zeros(0, dtype=np.int64)
    if np.abs(x).max() * max(np.abs(q).max(), 1.0) * max(x.shape[1], 1) < EXACT:
        return (x @ q).astype(np.int64)
    ints = [int(b) for b in q]
    exact = (sum(int(a) * b for a, b in zip(row, ints, strict=True)) for row in x.tolist())
    return np.array([min(max(s, -LONG), LONG - 1) for s in exact], dtype=np.int64)


def fit_pivots(sample: np.ndarray, pivots: int, seed: int, steps: int = 8) -> np.ndarray:
    """Centres of a few rounds of k-means from random rows of a sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(pivots, len(sample)), replace=False)]
    for _ in range(steps):
        nearest = _distances(sample, centres).argmin(axis=1)
        centres = np.stack([sample[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - c) ** 2).sum(axis=1)) for c in centres], axis=1)


def _augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0.0))]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors).astype(np.float64)


def _keyed(pivots: np.ndarray, largest: float):
    """Adds pivot and dist to batches of vectors."""

    def of(batches):
        for part in batches:
            if len(part):
                away = _distances(_augmented(_matrix(part["v"]), largest), pivots)
                pivot = away.argmin(axis=1)
                yield part.assign(pivot=pivot.astype(np.int32), dist=away[np.arange(len(part)), pivot])

    return of


class Bound:
    """Distances of an anchor from scores. Radii are widened by ``slack``, so that rounding loses no row.

    Squares round by some 1e-15 of the largest one, which moves a distance by the root of that at most.
    """

    def __init__(self, largest: float):
        self.largest, self.slack = largest, 1e-7 * math.sqrt(max(largest, 1.0))

    def distance(self, own: float, score: float) -> float:
        return math.sqrt(max(self.largest + own - 2.0 * score, 0.0))


def _scanned(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots of a sorted block with the bounds of their rows."""
    pivot = part["pivot"].to_numpy()
    starts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
    return pivot[starts], starts, np.r_[starts[1:], len(pivot)]


def _search(pick: Callable, slack: float):
    """Of a block and a packet of anchors, the rows in each anchor's new annuli that ``pick`` takes."""

    def of(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(anchors):
            block = block.sort_values(["pivot", "dist", "vec_id"], ignore_index=True)
            x, dist, ids, labels = _matrix(block["v"]), block["dist"].to_numpy(), block["vec_id"].to_numpy(), block["label"].to_numpy()
            bounds = list(zip(*(b.tolist() for b in _scanned(block)), strict=True))
            for a in anchors.itertuples(index=False):
                inner, outer = (a.r0 + slack if a.r0 >= 0 else -1.0), a.r1 + slack
                rows = []
                for pivot, low, high in bounds:
                    part, key = dist[low:high], a.keys[pivot]
                    if inner < 0:
                        cuts = [(key - outer, "left", key + outer, "right")]
                    else:  # exactly what was scanned before stays out
                        cuts = [(key - outer, "left", key - inner, "left"), (key + inner, "right", key + outer, "right")]
                    for first, of_first, last, of_last in cuts:
                        i, j = np.searchsorted(part, first, of_first), np.searchsorted(part, last, of_last)
                        if i < j:
                            rows.append(np.arange(low + i, low + j))
                if rows:
                    rows = np.concatenate(rows)
                    out += pick(a, ids[rows], labels[rows], products(x[rows], np.asarray(a.v, dtype=np.float64)))
        columns = zip(*out, strict=True) if out else [[]] * 4
        made = pd.DataFrame({n: np.concatenate(c) if out else [] for n, c in zip(("anchor_id", "slot", "vec_id", "score"), columns, strict=True)})
        return made.astype({"anchor_id": "int64", "slot": "int32", "vec_id": "int64", "score": "int64"})

    return of


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by smaller id."""
    if len(ids) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))


def _picked(a, slot: int, ids: np.ndarray, scores: np.ndarray, k: int) -> list:
    best = _best(ids, scores, k)
    return [(np.full(len(best), a.anchor_id), np.full(len(best), slot, dtype=np.int32), ids[best], scores[best])] if len(best) else []


def _pick_positives(k: int):
    def of(a, ids, labels, scores):
        other = (labels == a.label) & (ids != a.anchor_id) & (scores >= a.least)
        return _picked(a, 0, ids[other], scores[other], k)

    return of


def _pick_negatives(k: int):
    def of(a, ids, labels, scores):
        other = labels != a.label
        ids, scores = ids[other], scores[other]
        out = []
        for slot, (low, high) in enumerate(zip(a.lows, a.highs, strict=True)):
            band = (scores >= low) & (scores <= high)
            out += _picked(a, slot, ids[band], scores[band], k)
        return out

    return of


class Store:
    """Vectors under their keys, in blocks, with what searching them needs."""

    def __init__(self, rows: DataFrame, *, pivots: int, sample_rows: int, block_rows: int, least_blocks: int, packet_rows: int, seed: int):
        self.packet_rows = packet_rows
        dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("largest"))
        first = dims.orderBy(F.desc("n"), "dim").first()
        self.empty = first is None or not first["dim"]
        if self.empty:
            return
        self.count, self.bound, dim = first["n"], Bound(first["largest"]), first["dim"]
        rows = rows.where(F.size("v") == dim)
        drawn = rows.withColumn("h", F.xxhash64("vec_id", F.lit(seed))).orderBy("h").limit(sample_rows).select("vec_id", "label", "v").toPandas()
        self.sample = (drawn["vec_id"].to_numpy(), drawn["label"].to_numpy(), _matrix(drawn["v"]))
        self.pivots = fit_pivots(_augmented(self.sample[2], first["largest"]), pivots, seed)
        schema = "vec_id long, label int, v array<double>, pivot int, dist double"
        keyed = rows.select("vec_id", "label", "v").mapInPandas(_keyed(self.pivots, first["largest"]), schema)
        blocks = max(least_blocks, -(-self.count // block_rows))
        dealt = keyed.repartitionByRange(blocks, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")
        self.rows = materialise(dealt.withColumn("block", F.spark_partition_id()), "annuli")
        ranges = self.rows.groupBy("block", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
        self.ranges = materialise(ranges, "ranges")
        self.widest = self.ranges.agg(F.max("high")).first()[0]

    def anchors(self, wanted: Column) -> DataFrame:
        """anchor_id, label, v, own (squared norm), home (nearest pivot) and keys, the distances to all pivots."""
        pivots = self.pivots

        def of(batches):
            for part in batches:
                if len(part):
                    x = _matrix(part["v"])
                    keys = _distances(np.c_[x, np.zeros(len(x))], pivots)
                    yield part.assign(own=(x * x).sum(axis=1), home=keys.argmin(axis=1).astype(np.int32), keys=list(keys))

        taken = self.rows.where(wanted).select(F.col("vec_id").alias("anchor_id"), "label", "v")
        return materialise(taken.mapInPandas(of, "anchor_id long, label int, v array<double>, own double, home int, keys array<double>"), "anchors")

    def _packets(self, anchors: DataFrame) -> Column:
        """Anchors of neighbouring pivots fill a packet, a pivot with more than a packet is dealt by hash; one count a pivot."""
        counts = {r["home"]: r["count"] for r in anchors.groupBy("home").count().collect()}
        first, parts, at, free = {}, {}, -1, 0
        for home in sorted(counts, key=lambda i: self.pivots[i].tolist()):
            if counts[home] > free:
                parts[home] = max(1, -(-counts[home] // self.packet_rows))
                first[home], at, free = at + 1, at + parts[home], self.packet_rows * parts[home]
            else:
                first[home], parts[home] = at, 1
            free -= counts[home]
        table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("home")]
        return (table(first) + F.pmod(F.xxhash64("anchor_id"), table(parts)).cast("int")).alias("packet")

    def scan(self, anchors: DataFrame, pick: Callable, carried: list[str]) -> tuple[DataFrame, DataFrame]:
        """FOUND rows of one round: r0 of the anchors has been scanned (-1: nothing), r1 is to be; and a table to discard then."""
        asked = anchors.select(self._packets(anchors), "anchor_id", "label", "v", "keys", "r0", "r1", *carried)
        widths = asked.select("packet", "r1", F.posexplode("keys").alias("pivot", "key"))
        widths = widths.groupBy("packet", "pivot").agg(F.min(F.col("key") - F.col("r1")).alias("first"), F.max(F.col("key") + F.col("r1")).alias("last"))
        slack = self.bound.slack
        met = self.ranges.join(widths, "pivot").where((F.col("low") <= F.col("last") + slack) & (F.col("high") >= F.col("first") - slack))
        pairs = materialise(met.select("packet", "block").distinct(), "pairs")
        left = self.rows.join(pairs, "block").groupBy("packet", "block")
        right = asked.join(pairs, "packet").groupBy("packet", "block")
        return left.cogroup(right).applyInPandas(_search(pick, slack), FOUND), pairs

    def discard(self) -> None:
        discard(self.rows)
        discard(self.ranges)


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k best of every anchor and slot; an id counts once."""
    ranked = rows.withColumn("rank", F.expr("row_number() over (partition by anchor_id, slot order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k)


def _expand(store: Store, anchors: DataFrame, pick: Callable, carried: list[str], k: int, next_radius: Callable, name: str) -> DataFrame:
    """Rounds of scans until every anchor is certified: the k best of each slot.

    next_radius(row) gives, from an anchor's row with ``found``, the scores of each slot's k found so far, the radius
    within which all that belongs to the k best lies for certain, or a wider one to go on with.
    """
    found, open_ = None, anchors

    def judge(batches):
        for part in batches:
            if len(part):
                part["r0"] = part["r1"]
                part["r1"] = [next_radius(row) for row in part.itertuples(index=False)]
                yield part[part["r1"] > part["r0"]].drop(columns="found")

    while not open_.isEmpty():
        new, pairs = store.scan(open_, pick, carried)
        merged = materialise(_top(new if found is None else found.drop("rank").unionByName(new), k), name)
        so_far = merged.groupBy("anchor_id", "slot").agg(F.collect_list("score").alias("scores"))  # k at most
        so_far = so_far.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "scores"))).alias("found"))
        joined = open_.join(so_far, "anchor_id", "left")
        still = materialise(joined.mapInPandas(judge, open_.schema), f"{name}-open")
        for spent in (pairs, open_, *([] if found is None else [found])):
            discard(spent)
        found, open_ = merged, still
    return found


def _radii(schema: str, start: Callable):
    """mapInPandas function that puts what ``start`` makes of each row into the columns after the row's own."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def of(batches):
        for part in batches:
            if len(part):
                made = list(zip(*(start(row) for row in part.itertuples(index=False)), strict=True))
                yield part.assign(**dict(zip(names, map(list, made), strict=True)))

    return of


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    *,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    pivots: int = 32,
    sample_rows: int = 4096,
    block_rows: int = 16_384,
    least_blocks: int = 16,
    packet_rows: int = 1024,
    seed: int = 11,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` is true of.

    vectors has vec_id, label and v, an array of whole numbers as doubles. Positives of an anchor are its ``positives``
    best other rows of the same label, negatives of a pair the ``negatives`` best rows of other labels whose score is at
    least ``low`` and at most ``high`` hundredths of the positive's; all, if there are fewer. Ties go to the smaller id.

    Rows without id, label or vector take no part, nor do vectors of another length than most have. Ids name rows: of
    several rows with one id the one with the smallest label, then vector, counts. A positive score below zero has no
    negatives, one of zero those of score zero. Without rows there is no result. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("v").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null")
    rows = materialise(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*"), "vectors")
    store = Store(rows, pivots=pivots, sample_rows=sample_rows, block_rows=block_rows, least_blocks=least_blocks, packet_rows=packet_rows, seed=seed)
    discard(rows)
    if store.empty:
        return spark.createDataFrame([], RESULT)
    bound, widest, (ids, labels, sample) = store.bound, store.widest, store.sample

    def scored(row, others: np.ndarray) -> np.ndarray:
        """Scores of the sample's rows of the label or of others, the best first."""
        return np.sort(products(sample[others], np.asarray(row.v, dtype=np.float64)))[::-1]

    def start_positives(row):
        known = scored(row, (labels == row.label) & (ids != row.anchor_id))
        least = int(known[positives - 1]) if len(known) >= positives else -LONG
        radius = bound.distance(row.own, float(known[0])) if len(known) else min(row.keys)
        return least, -1.0, radius

    def next_positives(row):
        scores = (row.found or {}).get(0, [])
        if row.r0 > max(row.keys) + widest:  # past every vector
            return row.r0
        if len(scores) >= positives:
            return max(row.r0, bound.distance(row.own, float(min(scores))))
        return min(max(1.25 * row.r0, 1.0), bound.distance(row.own, float(row.least))) if row.least > -LONG else max(1.25 * row.r0, 1.0)

    asked = store.anchors(anchors)
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema)
    first = materialise(asked.mapInPandas(_radii("least long, r0 double, r1 double", start_positives), f"{base}, least long, r0 double, r1 double"), "asked")
    best = _expand(store, first, _pick_positives(positives), ["least"], positives, next_positives, "positives")
    if best is None:
        return spark.createDataFrame([], RESULT)
    best = best.select("anchor_id", F.col("vec_id").alias("positive_id"), (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"))

    def start_negatives(row):
        known = scored(row, labels != row.label)
        lows, highs, radius = [], [], 0.0
        for score in map(int, row.scores):
            top, bottom = score * high // 100, -(-score * low // 100)
            inside = known[(known <= top) & (known >= bottom)]
            highs.append(top)
            lows.append(int(inside[negatives - 1]) if len(inside) >= negatives else bottom)
            if top >= bottom:
                radius = max(radius, bound.distance(row.own, float(inside[0] if len(inside) else bottom)))
        return lows, highs, -1.0, radius

    def next_negatives(row):
        need = row.r0
        for slot, (bottom, top) in enumerate(zip(row.lows, row.highs, strict=True)):
            if top < bottom:
                continue
            scores = (row.found or {}).get(slot, [])
            all_of = bound.distance(row.own, float(bottom))
            need = max(need, bound.distance(row.own, float(min(scores))) if len(scores) >= negatives else min(all_of, max(1.25 * row.r0, 1.0)))
        return need

    scores = best.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    paired = asked.join(scores, "anchor_id")
    more = "lows array<long>, highs array<long>, r0 double, r1 double"
    second = materialise(paired.select(*asked.columns, "scores").mapInPandas(_radii(more, start_negatives), f"{base}, scores array<long>, {more}").drop("scores"), "paired")
    found = _expand(store, second, _pick_negatives(negatives), ["lows", "highs"], negatives, next_negatives, "negatives")
    store.discard()
    discard(asked)
    if found is None:
        return spark.createDataFrame([], RESULT)
    return found.join(best, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
