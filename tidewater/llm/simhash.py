"""SimHash near-duplicates, linked without loss by covering locality-sensitive hashing.

A fingerprint sums the bits of the XXH64 (seed 42) of a text's word shingles. Two fingerprints link if they
differ in at most ``radius`` bits. Bit position i of the fingerprint carries a non-zero vector m(i) of
radius + 1 bits, and table v (each non-zero v of as many bits) keeps the positions with <m(i), v> = 1. At most
``radius`` differing positions span at most ``radius`` dimensions, so some v is orthogonal to all of them: in
that table the pair agrees on every kept bit. No pair within the radius is missed, for any data.

Exact copies collapse to one fingerprint before any table is built. A bucket only has to yield the components
of its members, so it returns spanning trees instead of pairs; a bucket of more than ``block_rows`` fingerprints
is cut into blocks, and every two blocks meet in one task, so no task holds more than two blocks of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import discard, map_texts, materialise
from tidewater.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned SimHash of one text: lower-cased A-Z, words, shingles with repeats; 0 if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    first = [0, *ends[: len(last) - 1].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, fp): the fingerprint as a signed long, for every row; null texts count as empty."""

    def of(texts: list[str]) -> list[np.ndarray]:
        return [np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)]

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"), *carry)
    return map_texts(rows, "body", "fp long", of)


def covering_masks(radius: int) -> list[int]:
    """The masks of the 2 ** (radius + 1) - 1 tables, as signed longs."""
    top = 2 ** (radius + 1) - 1
    carried = [i % top + 1 for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(carried) if (m & v).bit_count() % 2) for v in range(1, top + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _tree(codes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Edges that connect exactly what links within the radius connect, one fewer than members a component.

    Codes are unsigned: of a signed number, bitwise_count counts the bits of the absolute value.
    """
    rest = np.arange(len(codes))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            at = stack.pop()
            near = np.bitwise_count(codes[rest] ^ codes[at]) <= radius
            found, rest = rest[near], rest[~near]
            yield from ((codes[at], codes[x]) for x in found)
            stack.extend(found)


def _links(radius: int):
    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tab", "code", "pair", "fp"], ignore_index=True)
        codes = part["fp"].to_numpy().view(np.uint64)
        keys = part[["tab", "code", "pair"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(codes)])
        twos = starts[sizes == 2]
        twos = twos[np.bitwise_count(codes[twos] ^ codes[twos + 1]) <= radius]
        left, right = [codes[twos]], [codes[twos + 1]]
        for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            if edges := list(_tree(codes[at : at + n], radius)):
                a, b = zip(*edges, strict=True)
                left.append(np.array(a))
                right.append(np.array(b))
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        return pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return of


def links(codes: DataFrame, radius: int, block_rows: int, bundle_rows: int) -> DataFrame:
    """Edges (a, b) among the distinct longs in codes.fp, with the components of all links within the radius."""
    masks = covering_masks(radius)
    keyed = codes.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("code")) for t, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.tab", "k.code")
    crowded = materialise(
        keyed.groupBy("tab", "code")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("blocks", F.ceil(F.col("n") / block_rows)),
        "buckets",
    )
    rows = crowded.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    bundles = int(rows // bundle_rows) + 1
    part = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    met = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda other: F.least(other, F.col("part")) * F.col("blocks") + F.greatest(other, F.col("part")),
    )
    return (
        keyed.join(crowded, ["tab", "code"])
        .withColumn("part", part)
        .select("fp", "tab", "code", F.explode(met).alias("pair"))
        .withColumn("bundle", F.pmod(F.xxhash64("tab", "code", "pair"), F.lit(bundles)))
        .groupBy("bundle")
        .applyInPandas(_links(radius), "a long, b long")
        .distinct()
    )


def _rooted(made: DataFrame, first: Column, radius: int, block_rows: int, bundle_rows: int) -> DataFrame:
    """(fp, first, root): every distinct fingerprint with an aggregate of its rows and the root of its component."""
    codes = materialise(made.groupBy("fp").agg(first.alias("first")), "codes")
    roots = materialise(connected_components(links(codes, radius, block_rows, bundle_rows), "a", "b"), "roots")
    rooted = codes.join(roots, codes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "rooted")
    discard(codes)
    discard(roots)
    return rooted


def representatives(
    docs: DataFrame, tie: str, *, shingle: int = 4, radius: int = 4, block_rows: int = 4096, bundle_rows: int = 8192, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(doc_id, tie) of one row of every component: the smallest id, of rows that share it the smallest ``tie``.

    A column of docs, say a digest, is the tie; rows of one id whose texts don't link are in components of their own.
    Rows without id represent nothing.
    """
    made = materialise(fingerprints(docs, shingle, text, key, (tie,)), "fingerprints")
    rooted = _rooted(made, F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", tie))), radius, block_rows, bundle_rows)
    chosen = materialise(rooted.groupBy("root").agg(F.min("first").alias("first")).where("first is not null").select("first.*"), "representatives")
    discard(made)
    discard(rooted)
    return chosen


def simhash_components(
    docs: DataFrame,
    *,
    shingle: int = 4,
    radius: int = 4,
    block_rows: int = 4096,
    bundle_rows: int = 8192,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id).

    Texts that are null or hold no word have fingerprint zero and link like any other. Repeated rows and ids
    stay; a row without id keeps a null id and joins its fingerprint's component. An empty table gives none.
    Other columns of docs are not read.
    """
    made = materialise(fingerprints(docs, shingle, text, key), "fingerprints")
    rooted = _rooted(made, F.min("doc_id"), radius, block_rows, bundle_rows)
    smallest = materialise(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    known = materialise(rooted.join(smallest, "root").select("fp", "component_id"), "known")
    discard(rooted)
    discard(smallest)
    return made.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
