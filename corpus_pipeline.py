"""The corpus pipeline: four stages from raw documents to packed training sequences.

Each stage reads what the one before kept, as Parquet. The filtering stages keep all columns of
``documents`` and drop only rows their operator decides against:

    language    texts whose language cannot be told, as they have no letter, go
    toxicity    texts with a score of ``toxicity.THRESHOLD`` or more go
    duplicates  of each class of near-duplicates the row with the smallest doc_id stays
    packing     the ids of all that is left, placed in sequences

What a stage learns, it learns from the rows it is given (and the table ``labels``), under the
same rule as the operators' own queries: rows whose crc32 remainder is 1 teach nothing.
Repeated, null and empty rows are treated as the operators say: null and empty texts go at the
first stage, of equal rows one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalshare.llm import language_id, near_text, packing, toxicity
from vitalshare.llm.common import crc_remainder, table
from vitalshare.llm.queries import tokenizer
from vitalshare.sources.writers import checkpoint_root

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _training():
    return F.coalesce(crc_remainder("doc_id", 3) != 1, F.lit(False))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language cannot be told."""
    prototypes = language_id.learn(docs.where(_training()))
    found = language_id.identify(docs, prototypes, *COLUMNS)
    # with no language learned at all, a letter is all there is to ask for
    good = F.col("lang_pred") != "und" if prototypes else F.col("text").rlike(r"\p{L}")
    return found.where(good).select(COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic texts."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), _training())
    return toxicity.score(docs, model, *COLUMNS).where("predicted = 0").select(COLUMNS)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near-duplicates."""
    key = ["_id", "_null", "_mark"]
    doc_id = F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id")
    null = F.col("doc_id").isNull().alias("_null")
    found = near_text.near_duplicates(docs)
    kept = found.where("kept").select(doc_id, null, F.col("mark").alias("_mark"))
    # rows equal in doc_id and text are one; both sides share one shuffle
    rows = (
        docs.select(COLUMNS)
        .select("*", doc_id, null, F.xxhash64("text").alias("_mark"))
        .groupBy(key)
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("text").alias("text"),
            F.min(F.struct("lang", "source", "n_chars")).alias("rest"),
        )
    )
    return rows.join(kept, key, "left_semi").select("doc_id", "text", "rest.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the ids of all texts in sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language), ("toxicity", clean), ("duplicates", unique), ("packing", packed)]

#: No stage is expressible in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_root(spark)}/vitalshare/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
