"""Bounded samples of labelled rows, folds, and the calibration of margins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts).cast("long"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, rows: int, seed: int = 1) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled documents outside the held-out fold, picked by a hash of their ids.

    The ids are bounded by ``rows``, so they are broadcast and only picked documents are shuffled. An id stands for one
    text, however often it occurs: the one with the smallest digest, which every task takes of its own rows first.
    Null ids and labels take no part; null texts count as empty; an id with both labels has two rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(fold(F.col("id"), parts) != held_out).distinct()
    picked = known.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "y").limit(rows).select("id", "y")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    return found.select("id", "text", "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method; the intercept is hardly penalised."""
    a = np.c_[x, np.ones(len(x))]
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
