"""Quality rules: base rules on word statistics, then robust multivariate outliers.

Every document has a vector of transformed statistics. Per language and source, a minimum-covariance-determinant
(MCD) estimate finds the mean and covariance of the ``coverage`` share of documents with the smallest covariance
determinant; documents with too large a Mahalanobis distance are rejected.

The concentration steps are Spark aggregations over all documents. One step deals each document into a bin of the
logarithm of its squared distance and sums counts, vectors and products by group and bin; adding up bins from the
smallest until they hold ``coverage`` of a group gives the next estimate. Partial sums keep a group with a third of
all rows cheap, and only a bounded number of bins of a group meets in one task. Two deterministic starts run side
by side (coordinate-wise medians with the quartiles' distance, and plain moments); the smaller determinant wins.
Groups whose determinant has settled take no part in further steps.
Groups under ``least_rows`` documents pool by language, and those under it again pool together.
"""

from __future__ import annotations

import math
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewater.llm.common import discard, map_texts, materialise

SYMBOLS = b"#*$%&|<>"
BLANK_BYTES = b" \t\n\x0b\x0c\r"
WINDOW = 5
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_echoes long"
#: Words that stand in for an average text, so that ratios of short texts vary no more than those of long ones.
PRIOR_WORDS = 50
#: Standard deviations that a statistic has at least: many are constant over nearly all clean documents.
FLOORS = {"length": 0.12, "symbols": 0.20, "dup_lines": 0.35, "repeats": 0.30, "upper": 0.20, "echoes": 0.20}
DIMS = list(FLOORS)
BINS_PER_LOG = 32


def statistics(text: str | None) -> tuple[int, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_echoes) of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines, seen, dups = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip(BLANK_BYTES):
            lines += 1
            dups += line in seen
            seen.add(line)
    blanks = len(raw) - len(raw.translate(None, BLANK_BYTES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    return len(words), len(text) - blanks, symbols, dups, repeated_words(words), lines, upper, sum(map(operator.eq, words, words[1:]))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of five words that the text has at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    # equal hashes only nominate windows; the words themselves decide
    at = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    first: dict[tuple, int] = {}
    hit = np.zeros(len(words) + 1, dtype=np.int64)
    for i in at.tolist():
        window = tuple(words[i : i + WINDOW])
        j = first.setdefault(window, i)
        if j != i:
            for x in (i, j):
                hit[x] += 1
                hit[x + WINDOW] -= 1
    return int((np.cumsum(hit)[:-1] > 0).sum())


def _statistics(texts: list[str]) -> list[np.ndarray]:
    return list(np.array([statistics(t) for t in texts], dtype=np.int64).reshape(-1, len(STATS.split(","))).T)


def _features() -> dict[str, Column]:
    words = F.col("n_words") + PRIOR_WORDS
    return {
        "length": F.log((F.col("word_chars") + 6.0 * PRIOR_WORDS) / words),
        "symbols": F.log1p(20.0 * F.col("n_symbols") / words),
        "dup_lines": F.log1p(10.0 * F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        "repeats": F.log1p(10.0 * F.col("n_repeat_words") / words),
        "upper": F.log1p(10.0 * F.col("n_upper") / (F.col("word_chars") + 6.0 * PRIOR_WORDS)),
        "echoes": F.log1p(10.0 * F.col("n_echoes") / words),
    }


def chi_square(x: float, k: float) -> float:
    """The distribution function of chi-square with k degrees of freedom."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    for n in range(1, 2000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, k) < p else (low, mid)
    return high


def _consistency(coverage: float) -> float:
    """Scales the covariance of the closest share of a normal sample to that of the whole."""
    if coverage >= 1:
        return 1.0
    return coverage / chi_square(chi_square_quantile(coverage, len(DIMS)), len(DIMS) + 2)


P = len(DIMS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [*DIMS, *(f"{DIMS[i]}_{DIMS[j]}" for i, j in PAIRS)]
ESTIMATE = "grp string, start int, mean array<double>, inverse array<double>, log_det double, edge long, gained double"
#: A group has settled when a step lowers the logarithm of its determinant by no more than this.
SETTLED = 1e-4
#: Distance of the quartiles of a normal sample, in standard deviations.
QUARTILES = 1.349


def _estimate(coverage: float):
    """From one group's bins, the next estimate. One row a bin; the bins are bounded, whatever the group holds."""
    schema = to_arrow_schema(StructType.fromDDL(ESTIMATE))
    scale, floor = _consistency(coverage), np.diag([f * f for f in FLOORS.values()])

    def of(key: tuple, bins: pa.Table) -> pa.Table:
        number = bins.column("bin").to_numpy()
        order = np.argsort(number)
        counts = bins.column("n").to_numpy()[order]
        last = int(np.searchsorted(np.cumsum(counts), math.ceil(coverage * counts.sum())))
        held = order[: last + 1]
        sums = np.array([bins.column(c).to_numpy()[held].sum() for c in SUMS]) / counts[: last + 1].sum()
        mean, cov = sums[:P], np.zeros((P, P))
        for (i, j), s in zip(PAIRS, sums[P:], strict=True):
            cov[i, j] = cov[j, i] = s - mean[i] * mean[j]
        cov = cov * scale + floor
        log_det, was = float(np.linalg.slogdet(cov)[1]), bins.column("was")[0].as_py()
        row = {
            "grp": key[0].as_py(), "start": key[1].as_py(), "mean": mean.tolist(), "inverse": np.linalg.inv(cov).ravel().tolist(),
            "log_det": log_det, "edge": int(number[order[last]]), "gained": max(0.0, was - log_det),
        }
        return pa.Table.from_pylist([row], schema=schema)

    return of


def _squared_distance() -> Column:
    gap = [F.col(d) - F.col("mean")[i] for i, d in enumerate(DIMS)]
    return sum((gap[i] * gap[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _binned(rows: DataFrame) -> DataFrame:
    """Counts and sums by group, start and bin of the squared distance."""
    dealt = rows.withColumn("bin", F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * BINS_PER_LOG))
    return dealt.groupBy("grp", "start", "bin").agg(
        F.count("*").alias("n"), F.max("log_det").alias("was"),
        *[F.sum(d).alias(d) for d in DIMS],
        *[F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"{DIMS[i]}_{DIMS[j]}") for i, j in PAIRS],
    )


def mcd(vectors: DataFrame, coverage: float, steps: int) -> DataFrame:
    """The estimate of each group in vectors (grp and DIMS): ESTIMATE columns, one row a group.

    A step is one job: it reads the vectors of the groups that have not settled, and its own output says whether any
    has gained. Estimates are written, so that their size decides how they meet the vectors.
    """
    next_of = lambda bins, share: bins.groupBy("grp", "start").applyInArrow(_estimate(share), ESTIMATE)
    middle = vectors.groupBy("grp").agg(*[F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(f"q_{d}") for d in DIMS])
    square = lambda d: F.pow((F.col(f"q_{d}")[2] - F.col(f"q_{d}")[0]) / QUARTILES, 2) + FLOORS[d] ** 2
    unset = float("inf")  # whatever comes next has gained
    first = middle.select(
        "grp", F.lit(0).alias("start"), F.array(*[F.col(f"q_{d}")[1] for d in DIMS]).alias("mean"),
        F.array(*[1.0 / square(d) if i == j else F.lit(0.0) for i, d in enumerate(DIMS) for j in range(P)]).alias("inverse"),
        F.lit(unset).alias("log_det"), F.lit(None).cast("long").alias("edge"), F.lit(unset).alias("gained"),
    )
    moments = next_of(_binned(vectors.withColumns({"start": F.lit(1), "d2": F.lit(1.0), "log_det": F.lit(unset)})), 1.0)
    now = materialise(first.unionByName(moments), "mcd")
    for _ in range(steps):
        moving = now.where(F.col("gained") > SETTLED)
        bins = _binned(vectors.join(moving.drop("gained"), "grp").withColumn("d2", _squared_distance()))
        seen = Observation()
        new = next_of(bins, coverage).unionByName(now.where(F.col("gained") <= SETTLED))
        new = materialise(new.observe(seen, F.coalesce(F.max("gained"), F.lit(0.0)).alias("most")), "mcd")
        discard(now)
        now = new
        if seen.get["most"] <= SETTLED:
            break
    best = now.groupBy("grp").agg(F.min(F.struct("log_det", "start", "mean", "inverse", "edge")).alias("e"))
    return best.select("grp", "e.*")


def _groups(rows: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, grp): each source of its own where it has enough rows, else pooled by language, else all together."""
    sizes = rows.where("not base_failed").groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.count("*").alias("n"))
    pools = sizes.where(F.col("n") < least_rows).groupBy(F.col("g_lang").alias("p_lang")).agg(F.sum("n").alias("pooled"))
    return sizes.join(pools, F.col("g_lang").eqNullSafe(F.col("p_lang")), "left").select(
        "g_lang", "g_source",
        F.when(F.col("n") >= least_rows, F.to_json(F.array("g_lang", "g_source")))
        .when(F.col("pooled") >= least_rows, F.to_json(F.array("g_lang")))
        .otherwise(F.lit("[]")).alias("grp"),
    )


def quality_rules(
    docs: DataFrame,
    *,
    coverage: float = 0.75,
    tail: float = 1e-6,
    least_rows: int = 60,
    steps: int = 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, kept, distance2, and the carried columns.

    base_failed: under 10 words, or over a fifth of the words in repeated five-word windows. kept is false for
    those, and else false where the squared Mahalanobis distance of the row's group exceeds the chi-square quantile
    at 1 - tail. Null texts have no words and fail. Null languages or sources form groups of their own. Repeated
    rows each count; an empty table gives no rows. Groups too small for an estimate (see module) are pooled.
    distance2 is null for rows that failed the base rules.
    """
    # the text comes along once, as what is counted
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("carried_text"), *[F.col(c).alias(f"carried_{c}") for c in carry if c != "text"],
    )
    rows = map_texts(named, "carried_text", STATS, _statistics, keep_text="text" in carry)
    rows = materialise(
        rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))), "statistics"
    )
    groups = materialise(_groups(rows, least_rows), "groups")
    vectors = rows.where("not base_failed").join(
        groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    )
    vectors = materialise(vectors.select("grp", *[c.alias(d) for d, c in _features().items()]), "vectors")
    fit = materialise(mcd(vectors, coverage, steps), "fit")
    fit = materialise(groups.join(fit, "grp"), "fit")
    limit = chi_square_quantile(1 - tail, P)
    scored = rows.join(fit, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    scored = scored.select("*", *[c.alias(d) for d, c in _features().items()]).withColumn(
        "distance2", F.when(~F.col("base_failed"), _squared_distance())
    )
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("distance2") <= limit)).alias("kept"), "distance2",
        *[F.col(f"carried_{c}").alias(c) for c in carry],
    )
