"""A corpus pipeline: toxic documents go, one of each group of near-duplicates stays, personal data is masked, the rest is packed.

Each stage is written as Parquet and read again as the next one's documents. No stage fails on nulls in any column, empty
or very long texts, repeated rows, an empty table or columns beside those of ``documents``; what it makes of them is said
at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import packing, pii, simhash, toxicity
from sievework.llm.common import stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the classifier is fitted on the labelled ones outside the held-out third.

    Null and empty texts have the score of no signs and stay, as do rows without an id and every copy of a clean row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    name = scored.columns[-1]
    return scored.where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the least id, rows without an id last.

    Null and empty texts are one class. Of rows alike in id and text one stays.
    """
    return simhash.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind and their lengths told anew; null texts stay null."""
    masked = pii.find(docs, redacted=True).select(*[f"`{c}`" for c in docs.columns])
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its token ids and its place among the sequences. Null and empty texts are one end token."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can't express the stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
