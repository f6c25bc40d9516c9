"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All stages but the last return the columns they are given. Rows that a stage keeps
stay whole; the stage for personal data changes text (and n_chars with it). Null texts are kept as null; null ids are
ordinary values; repeated rows are near-duplicates of each other, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.bpe import round_trip, vocabulary
from memoria.llm.common import table, written
from memoria.llm.decontaminate import decontaminated
from memoria.llm.jaccard import near_duplicates
from memoria.llm.pii import mask_pii
from memoria.llm.simhash import keep_one
from memoria.llm.toxicity import THRESHOLD, score_toxicity
from memoria.sources.shipping import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    ship_package(spark)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), out="_toxicity")
    return scored.filter(F.col("_toxicity") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: that of the smallest id.

    Pairs are found by SimHash and multi-index hashing, and verified over whole shingle sets.
    """
    ship_package(spark)
    return keep_one(docs, mark=near_duplicates).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    ship_package(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars is that of the new text."""
    masked = mask_pii(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return masked.select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids as little-endian unsigned 32-bit integers.

    The ids of each document are decoded again; the stage fails if they don't give its text back.
    """
    ship_package(spark)
    decoded = round_trip(docs.select("doc_id", "text"), *vocabulary())
    n_tokens = (F.octet_length("token_ids") / 4).cast("bigint")
    lost = F.raise_error(F.concat(F.lit("token ids don't give the text back of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    same = F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))
    return decoded.select("doc_id", F.when(same, n_tokens).otherwise(lost.cast("bigint")).alias("n_tokens"), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("tokens", tokenise),
]

#: Trained models, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
