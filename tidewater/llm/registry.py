"""The queries that apply the corpus operators to whole tables, and the SQL that some can be held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import discard, shared_dir, table
from tidewater.llm.hard_negatives import hard_negatives, whole
from tidewater.llm.hash_forest import nearest
from tidewater.llm.html_text import main_text
from tidewater.llm.mixing import mix_copies
from tidewater.llm.mixing import oracle as mixing_sql
from tidewater.llm.packing import pack
from tidewater.llm.periodic import planted, run_digest
from tidewater.llm.quality_classifier import quality_scores
from tidewater.llm.quality_rules import quality_rules
from tidewater.llm.secrets import secret_digest
from tidewater.llm.sentencepieces import encode_documents
from tidewater.llm.simhash import simhash_components
from tidewater.llm.token_counts import CACHE_SCHEMA, token_counts
from tidewater.llm.toxicity import toxicity_scores


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded; the cache goes when its counts are read."""
    cache = f"{shared_dir(spark)}/tidewater/token-counts-{uuid.uuid4().hex}"
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)
    discard(spark.read.schema(CACHE_SCHEMA).parquet(cache))
    return counts


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


#: A source may be passed four times as often as the largest.
REPETITION = 4.0


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_copies(table(spark, sf_dir, "documents"), repetition=REPETITION)


def op7_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(planted(table(spark, sf_dir, "documents")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), whole(F.col("embedding")).alias("v"))
    return hard_negatives(vectors, F.expr("vec_id % 100 = 0"))


#: Brute force over all pairs of an anchor and a row.
HARD_NEGATIVES_SQL = """with r as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as integer) as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select * from n where rank <= 10"""


def op13_packed_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


#: By the name that the driver calls.
QUERIES = [
    op1_html_text, op2_token_counts, op3_quality_rules, op4_nearest_vectors, op5_secret_spans, op6_source_mix,
    op7_simhash_components, op8_quality_scores, op9_toxicity_scores, op10_sentencepieces, op11_periodic_runs, op12_hard_negatives,
    op13_packed_pieces,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mix": mixing_sql(repetition=REPETITION, copies=True), "op12_hard_negatives": HARD_NEGATIVES_SQL}
