"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif_media, jaccard_join, mixing, packing, reply_trees, resharding, secret_scan, spot_signatures, substring_dedup, toxicity
from .oracles import ORACLES as ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.dedup(_table(spark, sf_dir, "documents"), longest=True))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("tag", "root")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_media(_table(spark, sf_dir, "documents"))


def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.fingerprints(_table(spark, sf_dir, "documents"))


def op9_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, texts = reply_trees.chain(table.unionByName(probe), "conv_id", "turn", "role", "text")
    conversations = reply_trees.joined(reply_trees.segments(texts, reply_trees.branches(nodes, top=1)))
    out = reply_trees.digest(conversations, in_order=True)
    return out.select(F.expr("cast(nullif(tree, '') as long)").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resharding.assignment(_table(spark, sf_dir, "documents"), shards=40, old_shards=32)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_mixing, op4_substring_dedup, op5_jaccard_join, op6_best_fit_packing, op7_gif_media, op8_spot_signatures, op9_reply_trees, op10_resharding)}
