"""Secret scans with built-in functions only.

Base kinds are regular expressions. The method adds spans by entropy: in candidate strings, long runs of one
character class, a window slides by one character at a time; the counts of its characters and the sum of n log2 n
over them are carried from window to window in one fold, so that each step changes two counts. Windows at or above
the class's entropy merge into spans. Allow-lists suppress them: words that no window may hold, candidates of a known
form, candidates behind the name of a digest, and candidates that begin inside an address.

Regular expression functions give no positions. A text split by the same pattern gives the gaps between the
matches, and the running total of gap and match lengths is each match's position.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import text_or_empty

KINDS = ["assign", "access", "hex", "entropy"]


def _either_case(pattern: str) -> str:
    """Both cases of every letter, in a form that every engine reads the same way."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern)


ASSIGN = rf"""({_either_case("password")}|{_either_case("passwd")}|{_either_case("secret")}|{_either_case("token")}|{_either_case("api")}_?{_either_case("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# a shorter greedy run of one class can't hold a longer match, so these lengths may stand in the patterns
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Character classes: name, run of candidates, window, least entropy in bits.
CLASSES = [
    ("base64", r"[A-Za-z0-9+/_=-]{24,}", 24, 4.05),
    ("hex", r"[0-9A-Fa-f]{24,}", 24, 3.05),
]
#: Words of placeholders and alphabets: no window that overlaps one is a secret, while the rest of its candidate may be.
ALLOW_WORDS = ("ABCDEFGHIJKLMNOP", "abcdefghijklmnop", "0123456789", "EXAMPLE", "example", "xxxxxx", "XXXXXX", "your_", "your-", "YOUR_", "YOUR-")
#: Forms of whole candidates that look random but are no secrets: identifiers, joined words.
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Za-z]++([_/-][A-Za-z]++)++$",  # possessive: an engine that goes back over a repeated group would recurse
)
#: What stands right before a candidate that is no secret, with the most characters that it can match: names of digests.
ALLOW_BEFORE = ((r"([Mm][Dd]5|[Ss][Hh][Aa](1|256|384|512)?)[:=-]$", 7),)
#: Stretches of text in which no secret begins: hosts and paths of addresses, but not what follows their question mark.
ALLOW_INSIDE = (r"://[A-Za-z0-9.:%~/_-]*",)
#: Items that a fold appends to one array before it starts another: appending copies the array.
FOLD_BLOCK = 256


def _q(s: str) -> str:
    """As a string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _folded(items: str, state: str, advance: str, emit: str, kind: str) -> str:
    """SQL for array<kind>: of every item x of an array, ``emit`` of x and the state s before it; ``advance`` is the next s.

    Outputs gather in blocks that are put together at the end, so that the work grows as the number of items.
    """
    none = f"cast(array() as array<{kind}>)"
    inner = f"""aggregate(block, named_struct('s', o.s, 'out', {none}),
      (t, x) -> transform(array(t.s), s -> named_struct('s', {advance}, 'out', concat(t.out, array({emit}))))[0])"""
    return f"""flatten(aggregate(
      transform(sequence(0, greatest(size({items}) - 1, 0) div {FOLD_BLOCK}), i -> slice({items}, i * {FOLD_BLOCK} + 1, {FOLD_BLOCK})),
      named_struct('s', {state}, 'out', array({none})),
      (o, block) -> transform(array({inner}), r -> named_struct('s', r.s, 'out', concat(o.out, array(r.out))))[0],
      o -> o.out))"""


def _located(pattern: str, group: int | None = None, body: str = "body") -> Column:
    """Matches in order as (a, b, hit[, part]): start, end (exclusive) in code points, the match, and a group of it."""
    hits = f"regexp_extract_all({body}, {_q(pattern)}, 0)"
    parts = f"regexp_extract_all({body}, {_q(pattern)}, {group})" if group else hits
    items = f"""zip_with(zip_with({hits}, slice(split({body}, {_q(pattern)}, -1), 1, size({hits})), (h, g) -> named_struct('hit', h, 'gap', g)),
      {parts}, (x, p) -> named_struct('hit', x.hit, 'gap', x.gap, 'part', p))"""
    found = _folded(
        "ms", "0", "s + length(x.gap) + length(x.hit)", "named_struct('a', s + length(x.gap), 'b', s + length(x.gap) + length(x.hit), 'hit', x.hit, 'part', x.part)",
        "struct<a:int,b:int,hit:string,part:string>",
    )
    return F.expr(f"""
        if({body} rlike {_q(pattern)}, flatten(transform(array({items}), ms -> {found})), cast(array() as array<struct<a:int,b:int,hit:string,part:string>>))""")


def _n_log_n(window: int) -> str:
    return "array(" + ", ".join(f"{n * math.log2(n) if n else 0.0!r}D" for n in range(window + 2)) + ")"


def _hot_windows(codes: str, window: int, least: float) -> str:
    """SQL for the merged windows of at least that entropy in an array of characters' numbers, as array<struct<a, b>>.

    Counts lie side by side in longs, as many bits each as a window's count takes, so that a step adds one to a count and
    takes one from another.
    """
    f, bits = _n_log_n(window), (window + 1).bit_length()
    per = 63 // bits
    count = lambda of: f"int(shiftright(t.n[{of} div {per}], int({bits} * ({of} % {per}))) & {(1 << bits) - 1})"
    one = lambda of: f"if(k = {of} div {per}, shiftleft(1L, int({bits} * ({of} % {per}))), 0L)"
    hot = f"i >= {window} and {math.log2(window)!r}D - u.s / {window} >= {least!r}D"
    return f"""
      aggregate(
        sequence(1, size({codes})),
        named_struct('n', array_repeat(0L, int(array_max({codes}) div {per}) + 1), 's', 0D, 'a', -1, 'b', -1, 'out', cast(array() as array<struct<a:int,b:int>>)),
        (t, i) -> transform(transform(array(named_struct('e', {codes}[i - 1], 'l', if(i > {window}, {codes}[i - {window} - 1], -1))), m -> named_struct(
            'n', transform(t.n, (v, k) -> v + {one("m.e")} - if(m.l < 0, 0L, {one("m.l")})),
            's', t.s + if(m.e = m.l, 0D, transform(array({count("m.e")}), c -> {f}[c + 1] - {f}[c])[0]
                 + if(m.l < 0, 0D, transform(array({count("m.l")}), c -> {f}[c - 1] - {f}[c])[0])))),
          u -> named_struct(
            'n', u.n, 's', u.s,
            'a', if({hot} and (t.a < 0 or i - {window} > t.b), i - {window}, t.a),
            'b', if({hot}, i, t.b),
            'out', if({hot} and t.a >= 0 and i - {window} > t.b, concat(t.out, array(named_struct('a', t.a, 'b', t.b))), t.out)))[0],
        t -> if(t.a < 0, t.out, concat(t.out, array(named_struct('a', t.a, 'b', t.b)))))"""


def _entropy_spans(window: int, least: float, allow: tuple[str, ...], before: tuple[tuple[str, int], ...]) -> Column:
    """Spans (a, b) of a column ``runs`` of candidates, in code points of the text."""
    listed = [f"c.hit rlike {_q(p)}" for p in allow]
    listed += [f"substring(body, greatest(c.a - {n}, 0) + 1, least(c.a, {n})) rlike {_q(p)}" for p, n in before]
    # each character as its place among the different ones of the candidate
    numbered = "transform(array(regexp_extract_all(c.hit, '.', 0)), cs -> transform(array(array_distinct(cs)), d -> transform(cs, x -> int(array_position(d, x)) - 1))[0])"
    return F.expr(f"""
        flatten(transform(filter(runs, c -> not ({" or ".join(listed or ["false"])})),
          c -> transform(
            flatten(transform({numbered}, cs -> {_hot_windows("cs", window, least)})),
            w -> named_struct('a', c.a + w.a, 'b', c.a + w.b))))""")


def _outside(spans: str, others: str) -> Column:
    """Spans that don't begin inside one of the others, both in order of their starts; an end is still inside.

    One fold over both, others first where they start alike, carries how far the others have reached.
    """
    both = f"""array_sort(concat(transform({others}, x -> named_struct('a', x.a, 'k', 0, 'b', x.b, 'hit', '')), transform({spans}, x -> named_struct('a', x.a, 'k', 1, 'b', x.b, 'hit', x.hit))))"""
    seen = _folded("both", "-1", "if(x.k = 0, greatest(s, x.b), s)", "named_struct('a', x.a, 'b', x.b, 'hit', x.hit, 'keep', x.k = 1 and x.a > s)", "struct<a:int,b:int,hit:string,keep:boolean>")
    return F.expr(f"if(size({others}) = 0, transform({spans}, x -> named_struct('a', x.a, 'b', x.b, 'hit', x.hit, 'keep', true)), filter(flatten(transform(array({both}), both -> {seen})), x -> x.keep))")


def _not_held(base: str, more: str) -> Column:
    """Entropy spans that no base span and no other entropy span holds; longest first where they start alike."""
    both = f"""array_sort(concat(transform({base}, x -> named_struct('a', x.a, 'back', -x.b, 'kind', x.kind)), transform({more}, x -> named_struct('a', x.a, 'back', -x.b, 'kind', x.kind))))"""
    entropy = KINDS.index("entropy")
    seen = _folded("both", "-1", "greatest(s, -x.back)", f"named_struct('a', x.a, 'kind', x.kind, 'b', -x.back, 'keep', x.kind = {entropy} and -x.back > s)", "struct<a:int,kind:int,b:int,keep:boolean>")
    kept = f"transform(filter(flatten(transform(array({both}), both -> {seen})), x -> x.keep), x -> named_struct('a', x.a, 'kind', x.kind, 'b', x.b))"
    return F.expr(f"if(size({more}) = 0, {more}, {kept})")


def secret_spans(
    docs: DataFrame,
    *,
    classes: list[tuple[str, str, int, float]] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
    allow_words: tuple[str, ...] = ALLOW_WORDS,
    allow_before: tuple[tuple[str, int], ...] = ALLOW_BEFORE,
    allow_inside: tuple[str, ...] = ALLOW_INSIDE,
) -> DataFrame:
    """Per row of docs: row (a struct of all its columns), body (its text, null as empty) and secrets.

    secrets is array<struct<a, b, kind>> by start, then kind as listed in KINDS. Positions count code points, ends
    are exclusive. Entropy spans inside a base span or another entropy span are not repeated. Allow-lists hold for
    entropy spans only and see the whole text. Null and empty texts have none. Columns of docs may have any names.
    """
    tagged = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.lit(KINDS.index(kind)).alias("kind"), s["b"].alias("b")))
    base = F.concat(
        tagged(F.filter(_located(ASSIGN, 2), lambda m: F.length(m["part"]) >= ASSIGN_LEAST), "assign"),
        tagged(_located(ACCESS), "access"),
        tagged(_located(HEX), "hex"),
    )
    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("body"))
    found = found.withColumn("base", F.array_sort(base))
    # blanked out in their own length, so that positions stay
    masked = F.col("body")
    for word in allow_words:
        masked = F.replace(masked, F.lit(word), F.lit(" " * len(word)))
    found = found.withColumn("masked", masked).withColumn("addresses", F.concat(*[_located(p) for p in allow_inside]) if allow_inside else F.expr("cast(array() as array<struct<a:int,b:int>>)"))
    more = []
    for name, run, window, least in classes:
        found = found.withColumn("runs", _located(run, body="masked")).withColumn("runs", _outside("runs", "addresses"))
        found = found.withColumn(f"more_{name}", _entropy_spans(window, least, allow, allow_before))
        more.append(f"more_{name}")
    found = found.withColumn("more", F.array_distinct(tagged(F.concat(*more), "entropy"))).withColumn("more", _not_held("base", "more"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return found.withColumn(
        "secrets",
        F.transform(F.array_sort(F.concat("base", "more")), lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), kinds[s["kind"]].alias("kind"))),
    ).drop("runs", "base", "more", "masked", "addresses", *more)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Texts themselves stay out."""
    found = secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = found.select("row.doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret span of text replaced by mask; overlapping spans count as one. Null texts stay null."""
    pieces = F.expr(f"""
        aggregate(secrets, named_struct('at', 0, 'out', ''),
          (s, x) -> named_struct(
            'at', greatest(s.at, x.b),
            'out', if(x.a < s.at, s.out, concat(s.out, substring(body, s.at + 1, x.a - s.at), {_q(mask)}))),
          s -> concat(s.out, substring(body, s.at + 1)))""")
    text = F.when(F.size("secrets") == 0, F.col("row.text")).otherwise(pieces)
    return secret_spans(docs).select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
