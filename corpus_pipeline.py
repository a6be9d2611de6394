"""A corpus pipeline: rules, near-duplicates, secrets, mixing, encoding; each stage works on all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next one's documents, so a lost executor costs no more than a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise
from tidewater.llm.mixing import mix
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.secrets import redact
from tidewater.llm.sentencepieces import encode_documents
from tidewater.llm.simhash import representatives

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No source is passed more than half again as often as the one passed least, which is passed once.
REPETITION = 1.5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality_rules(docs, carry=tuple(COLUMNS[1:]))
    return judged.where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest id; every row without id.

    Of rows that share the smallest id, the one with the smallest digest of its columns stays. Rows of one id whose texts
    don't link are documents of their own. An id with very many rows is spread over their digests; equal rows meet in
    the tasks that read them.
    """
    parts = [F.sha2("text", 256), F.hex("lang"), F.hex("source"), F.col("n_chars").cast("string")]
    rows = docs.select(*COLUMNS, F.sha2(F.concat_ws(",", *[F.coalesce(p, F.lit("-")) for p in parts]), 256).alias("digest"))
    chosen = representatives(rows, "digest")
    kept = rows.join(chosen, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(*[F.first(c).alias(c) for c in COLUMNS[1:]])
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and n_chars counted anew where a text changed."""
    masked = redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to REPETITION times on average, in the order of the mix."""
    return mix(docs.select(*COLUMNS), repetition=REPETITION, arranged=True)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix, and proof that they decode to its text."""
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: Robust covariances, fingerprints and encoding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if written is not None:  # nothing reads the stage before any more
            discard(written)
        written = docs
    return docs
