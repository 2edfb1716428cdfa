"""From documents to packed sequences: toxic documents go, one document of each near-duplicate group stays, secrets are
masked, sources are mixed to their targets, and what is left is packed.

Every stage but the last returns the columns of documents. An empty table passes through all of them; null texts count as
empty: they are not toxic on their own account, link with nothing, hold no secret, and the mix, which counts words, takes
none of them. No stage can be expressed in SQL as a whole; the tests hold each against a plain version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import jaccard_join, mixing, packing, secret_scan, toxicity
from kindred.llm.common import scope

ORACLE_SQL = None
#: Documents with this score or a higher one are rejected.
TOXIC = 0.5


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, learnt from the labels, does not score as toxic."""
    machine = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, "__kindred_score").filter(F.col("__kindred_score") < TOXIC).drop("__kindred_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose sets of five-word shingles are linked at a similarity of 0.8."""
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets masked, and their lengths as they are then."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequences and places."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", keep_civil), ("ngram_jaccard", keep_one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next. What a stage writes on its way goes when its
    result is there, and that result when the next one is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with scope() as s:
            kept = s.keep(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = kept.df, kept
    return STAGES[-1][1](spark, docs, sf_dir)
