"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, packing, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Nulls, empty
tables, repeated rows and extra columns are handled as each operator's module says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gatelens.llm import minhash_dedup, packing, quality_rules, secret_scan, source_mixing
from gatelens.llm.common import table, written
from gatelens.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or whose posterior is under one half go."""
    whole = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return quality_rules.quality_rules(whole, keep=["document"]).where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, its owner: the smallest id, null ids last; of rows with equal id and text one."""
    whole = docs.select("doc_id", minhash_dedup.row_hash().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    kept = minhash_dedup.components(docs).where("owner IS NULL OR rid = owner").select(F.col("rid").alias("kept_rid")).distinct()
    rows = whole.join(kept, F.col("rid") == F.col("kept_rid"), "left_semi")
    copies = W.partitionBy("rid").orderBy("doc_id")
    return rows.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("document.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, by target weights; a document comes once for each epoch that takes it."""
    return source_mixing.mix(docs, budget_share=1.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secret scans", secrets), ("mixing sources", mixture), ("packing", packed)]
#: Posterior probabilities and tokenizers are beyond SQL: the stages are held against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
