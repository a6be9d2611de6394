"""Mixing sources to target weights by temperature, with built-in functions only.

A source's share of all tokens, raised to an exponent in [0, 1] and normalised, is its weight: 1 keeps the corpus as
it is, 0 gives every source the same. The exponent is bisected until the weights reach a target entropy, or until no
source is repeated more often than allowed. Weights times the token budget are the sources' budgets.

A budget becomes whole passes over a source and a part of one more. Every pass is a permutation of the source by a
hash of seed, pass and document; the part is the beginning of its permutation up to the budget, so it is all hashes
below a cutoff of the source. No task orders a whole source: hashes fall into about as many blocks as a block has
documents, sums over blocks find the block that a budget ends in, and only inside that block documents are counted
one by one. Texts are never shuffled: what is to be known of a source is one row, and a document's copies follow from
its hashes. The mix interleaves the sources: a copy's place in its source's permutations, as a fraction of the
source's passes, is its place in the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, materialise, text_or_empty

#: Bisection steps that one pass over the sources settles: it measures all exponents that these steps may visit.
STEPS_A_PASS = 4
PASSES = 6
#: Hash values: 32 bits of MD5, which every engine computes alike.
SPAN = 2**32


def _measures(sizes: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """Per exponent, the entropy of the weights in bits, and logarithms of the most and least passes and of the powers' sum."""
    power = F.exp(F.col("a") * F.col("log_share"))
    each = sizes.withColumn("a", F.explode(F.array(*[F.lit(a) for a in exponents])))
    rows = each.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("log_share")).alias("zl"), F.max((F.col("a") - 1) * F.col("log_share")).alias("most"),
        F.min((F.col("a") - 1) * F.col("log_share")).alias("least"),
    )
    bits = (F.log("z") - F.col("zl") / F.col("z")) / F.log(F.lit(2.0))
    return {r["a"]: (r["bits"], r["most"], r["least"], r["z"]) for r in rows.select("a", bits.alias("bits"), "most", "least", F.log("z").alias("z")).collect()}


def find_exponent(sizes: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget_share: float | None = None) -> float:
    """The largest exponent in [0, 1] whose weights have at least ``entropy`` bits, or the smallest whose sources are
    all passed at most ``repetition`` times, at a budget of ``budget_share`` times the corpus; without one, at the
    budget that passes the least repeated source once. Both conditions are monotone in the exponent. Where no
    exponent meets the target, the end that comes closest.

    sizes has log_share, one row a source. Each pass over it measures the 15 exponents that the next four bisection
    steps may visit, so the driver receives 15 rows, however many sources there are.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 2**STEPS_A_PASS
        grid = [low + (high - low) * k / n for k in range(n + 1)]
        found = _measures(sizes, grid)
        if not found:
            return 1.0

        def holds(a: float, found=found) -> bool:
            bits, most, least, z = found[a]
            if entropy is not None:
                return bits >= entropy - 1e-12
            return (most - least if budget_share is None else most - z + math.log(budget_share)) <= math.log(repetition) + 1e-12

        i, j = 0, n  # bisect over the grid
        if entropy is not None:  # holds on [0, a]
            if holds(grid[n]):
                return grid[n]
            if not holds(grid[0]):
                return grid[0]
            while j - i > 1:
                i, j = ((i + j) // 2, j) if holds(grid[(i + j) // 2]) else (i, (i + j) // 2)
            low, high = grid[i], grid[j]
        else:  # holds on [a, 1]
            if holds(grid[0]):
                return grid[0]
            if not holds(grid[n]):
                return grid[n]
            while j - i > 1:
                i, j = (i, (i + j) // 2) if holds(grid[(i + j) // 2]) else ((i + j) // 2, j)
            low, high = grid[i], grid[j]
    return low if entropy is not None else high


def _hash(seed: int, number: Column) -> Column:
    """A number below SPAN for a pass over a document, from its id and size."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), F.col("doc_id").cast("string"), F.col("n_tokens").cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _tokens() -> Column:
    return F.size(F.regexp_extract_all(text_or_empty(), F.lit(f"({WORD})"), 1)).cast("long")


def source_plan(
    rows: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, row_tokens: int = 500, seed: int = 17
) -> DataFrame:
    """One row per source with tokens: p_source, tokens, exponent, weight, source_budget, whole, cutoff.

    rows has doc_id, source and n_tokens. A source gets ``whole`` permutations of all its rows, and one more of those
    whose hash in it is below ``cutoff``.
    """
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    sizes = materialise(sums.withColumn("log_share", F.log(F.col("tokens") / F.lit(float(max(total, 1))))), "mix-sources")
    share = None if budget is None else budget / max(total, 1)
    exponent = find_exponent(sizes, entropy=entropy, repetition=repetition, budget_share=share) if total else 1.0
    power = F.exp(F.lit(exponent) * F.col("log_share"))
    scale, least = sizes.agg(F.sum(power), F.min(F.lit(exponent - 1) * F.col("log_share"))).first()
    if budget is None and repetition is not None and total:
        mixed = total * scale / math.exp(least)  # the source with the fewest passes gets exactly one
    else:
        mixed = float(total if budget is None else budget)
    # rounded before it is rounded up, so that what should be a whole pass is one
    own = F.ceil(F.round(power / F.lit(scale or 1.0) * F.lit(mixed), 3)).cast("long")
    weighed = sizes.select(F.col("source").alias("p_source"), "tokens", F.lit(exponent).alias("exponent"), F.round(power / F.lit(scale or 1.0), 9).alias("weight"), own.alias("source_budget"))
    weighed = weighed.withColumn("whole", F.floor(F.col("source_budget") / F.col("tokens"))).withColumn("part", F.col("source_budget") - F.col("whole") * F.col("tokens"))
    weighed = materialise(weighed.withColumn("blocks", F.ceil(F.sqrt(F.col("tokens") / F.lit(float(row_tokens))))), "mix-weights")
    hashed = rows.where("n_tokens > 0").join(weighed, F.col("source").eqNullSafe(F.col("p_source"))).where("part > 0")
    hashed = hashed.withColumn("h", _hash(seed, F.col("whole"))).select("p_source", "n_tokens", "part", "h", F.floor(F.col("h") * F.col("blocks") / F.lit(SPAN)).alias("block"))
    hashed = materialise(hashed, "mix-hashes")
    sums = hashed.groupBy("p_source", "block").agg(F.sum("n_tokens").alias("held"), F.first("part").alias("part"))
    before = "coalesce(sum(held) over (partition by p_source order by block rows between unbounded preceding and 1 preceding), 0)"
    last = sums.withColumn("before", F.expr(before)).where("before < part and before + held >= part")
    last = materialise(last.select(F.col("p_source").alias("l_source"), F.col("block").alias("l_block"), "before"), "mix-last")
    inside = hashed.join(last, F.col("p_source").eqNullSafe(F.col("l_source")) & (F.col("block") == F.col("l_block")))
    ahead = "coalesce(sum(n_tokens) over (partition by p_source order by h range between unbounded preceding and 1 preceding), 0)"
    ends = inside.withColumn("ahead", F.expr(ahead)).where("before + ahead < part").groupBy(F.col("p_source").alias("e_source")).agg((F.max("h") + 1).alias("cutoff"))
    plan = weighed.join(ends, F.col("p_source").eqNullSafe(F.col("e_source")), "left")
    return materialise(plan.select("p_source", "tokens", "exponent", "weight", "source_budget", "whole", F.coalesce("cutoff", F.lit(0).cast("long")).alias("cutoff")), "mix-plan")


def _passes(seed: int) -> Column:
    more = (_hash(seed, F.col("whole")) < F.col("cutoff")).cast("int")
    return F.when((F.col("n_tokens") == 0) | F.col("whole").isNull(), F.lit(1)).otherwise((F.col("whole") + more).cast("int"))


def _place(seed: int, number: Column) -> Column:
    """Where the copy of pass ``number`` stands: number plus hash, over the whole passes and the cutoff of the last one.

    So a source's copies are spread evenly over the mix, one pass behind the other. Rows without tokens have one pass.
    """
    span = F.lit(float(SPAN))
    length = F.when((F.col("n_tokens") == 0) | F.col("whole").isNull(), F.lit(1.0)).otherwise(F.col("whole") + F.col("cutoff") / span)
    return (number + _hash(seed, number) / span) / length


def _planned(docs: DataFrame, **how) -> DataFrame:
    """Per input row doc_id, source and n_tokens, its source's plan, passes, and number: which of its copies, null without any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _tokens().alias("n_tokens"))
    rows = materialise(rows, "mix-rows")
    plan = source_plan(rows, **how)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left").withColumn("passes", _passes(how["seed"]))


def _numbers() -> Column:
    return F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1))


COLUMNS = ["doc_id", "source", "n_tokens", "exponent", "weight", "source_budget", "passes"]


def mix_plan(docs: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, row_tokens: int = 500, seed: int = 17) -> DataFrame:
    """One row per input row: doc_id, source, n_tokens, exponent, weight, source_budget, passes, place.

    n_tokens counts blank-separated words. The mix has ``budget`` tokens; without one, under an entropy target, the
    corpus's own number, and under a repetition limit the least that passes every source at least once. passes is how
    often the mix holds the row: the whole passes of its source, and one more for those first in the last
    permutation, until the source's budget is used up (the row that crosses it included). place is where the first
    copy stands in the mix, from 0 on; a row without copies has none.

    Null and blank texts have no tokens and one pass, as has everything in a source without tokens. A null source is
    a source. Rows of one id and size share their passes. An empty table gives no rows. Other columns are not read.
    """
    out = _planned(docs, entropy=entropy, repetition=repetition, budget=budget, row_tokens=row_tokens, seed=seed)
    return out.select(*COLUMNS, F.when(F.col("passes") > 0, _place(seed, F.lit(0))).alias("place"))


def mix_copies(docs: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, row_tokens: int = 500, seed: int = 17) -> DataFrame:
    """One row per copy that the mix holds: the columns of mix_plan, number (of the pass, from 0 on) and the copy's own place.

    A row without copies stays, with neither number nor place. Everything else as in mix_plan.
    """
    out = _planned(docs, entropy=entropy, repetition=repetition, budget=budget, row_tokens=row_tokens, seed=seed)
    out = out.withColumn("number", F.explode_outer(_numbers()))
    return out.select(*COLUMNS, "number", _place(seed, F.col("number")).alias("place"))


def mix(
    docs: DataFrame, *, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, row_tokens: int = 500, seed: int = 17,
    place: str | None = None, arranged: bool = False,
) -> DataFrame:
    """docs with every row as often as the mix holds it, see mix_plan; ``place`` names a column for the copies' places.

    ``arranged`` puts the rows in the order of their places: each partition, so each file written of it, holds a stretch
    of the mix. It shuffles the texts, once, by ranges of the places, which are spread evenly whatever the sources
    are. Otherwise texts stay where they are, unless the sources alone are too many to broadcast. Columns of docs may
    have any names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _tokens().alias("n_tokens"))
    plan = source_plan(materialise(rows, "mix-rows"), entropy=entropy, repetition=repetition, budget=budget, row_tokens=row_tokens, seed=seed)
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), _tokens().alias("n_tokens"),
    )
    held = held.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left").withColumn("passes", _passes(seed))
    held = held.withColumn("number", F.explode(_numbers())).select("row", _place(seed, F.col("number")).alias("place"))
    if arranged:
        held = held.repartitionByRange("place").sortWithinPartitions("place")
    return held.select(*[F.col(f"row.`{c}`") for c in docs.columns], *([F.col("place").alias(place)] if place else []))


def oracle(target_bits: float | None = None, repetition: float | None = None, docs: str = "documents", row_tokens: int = 500, seed: int = 17, copies: bool = False) -> str:
    """DuckDB SQL for the rows of mix_plan without a budget, or of mix_copies."""
    steps = STEPS_A_PASS * PASSES
    if target_bits is not None:
        holds = f"(ln(sum(exp(mid * log_share))) - sum(exp(mid * log_share) * mid * log_share) / sum(exp(mid * log_share))) / ln(2.0) >= {target_bits} - 1e-12"
        at_low, at_high, lower, result = 0, 1, "case when ok then mid else lo end, case when ok then hi else mid end", "case when (select ok from ends where mid = 1) then 1.0 when not (select ok from ends where mid = 0) then 0.0 else lo end"
        mixed = "total"
    else:
        holds = f"max((mid - 1) * log_share) - min((mid - 1) * log_share) <= ln({float(repetition)}) + 1e-12"
        at_low, at_high, lower, result = 0, 1, "case when ok then lo else mid end, case when ok then mid else hi end", "case when (select ok from ends where mid = 0) then 0.0 when not (select ok from ends where mid = 1) then 1.0 else hi end"
        mixed = "total * scale / exp(least)"
    word = r"[^\x20\x09-\x0D]+"
    digest = lambda number: f"cast('0x' || substr(md5(concat_ws(':', '{seed}', cast({number} as varchar), cast(doc_id as varchar), cast(n_tokens as varchar))), 1, 8) as bigint)"
    if copies:
        each, number, shown = "passed left join (select unnest(generate_series(0, (select max(passes) - 1 from passed))) as k) on k < passes", "k", " cast(k as integer) as number,"
    else:
        each, number, shown = "passed", "0", ""
    return f"""
with recursive counted as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{word}')) as bigint) as n_tokens from {docs}
), sums as (
  select source, cast(sum(n_tokens) as bigint) as tokens from counted group by source having sum(n_tokens) > 0
), sizes as (
  select source, tokens, ln(tokens / cast((select sum(tokens) from sums) as double)) as log_share from sums
), ends as (
  select mid, {holds} as ok from sizes, (values ({at_low}.0::double), ({at_high}.0::double)) m(mid) group by mid
), bisected(step, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select step + 1, {lower}
  from (select step, lo, hi, (lo + hi) / 2 as mid, (select {holds.replace("mid", "((b.lo + b.hi) / 2)")} from sizes) as ok from bisected b where step < {steps})
), chosen as (
  select cast({result} as double) as a from bisected where step = {steps}
), scaled as (
  select a, sum(exp(a * log_share)) as scale, min((a - 1) * log_share) as least, cast(sum(tokens) as double) as total from sizes, chosen group by a
), weighed as (
  select source, tokens, a as exponent, round(exp(a * log_share) / scale, 9) as weight,
         cast(ceil(round(exp(a * log_share) / scale * ({mixed}), 3)) as bigint) as source_budget
  from sizes, scaled
), parted as (
  select *, source_budget // tokens as whole, source_budget % tokens as part from weighed
), hashed as (
  select c.*, p.* exclude (source), p.source as p_source, {digest("whole")} as h
  from counted c left join parted p on c.source is not distinct from p.source
), ahead as (
  select *, coalesce(sum(case when n_tokens > 0 then n_tokens end) over (partition by source order by h range between unbounded preceding and 1 preceding), 0) as before from hashed
), passed as (
  select *, cast(case when n_tokens = 0 or whole is null then 1 else whole + case when before < part then 1 else 0 end end as integer) as passes,
            case when n_tokens = 0 or whole is null then 1.0::double
                 else whole + coalesce(max(case when n_tokens > 0 and before < part then h + 1 end) over (partition by source), 0) / 4294967296.0::double end as length
  from ahead
)
select doc_id, source, n_tokens, exponent, weight, source_budget, passes,{shown}
       case when passes > 0 then ({number} + {digest(number)} / 4294967296.0::double) / length end as place
from {each}
"""
