"""Files that the pipelines write, and the snapshots that they read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_of


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Candidate pairs as tab-separated files, ids sorted within an entity."""
    rows = pairs.select(F.col("s1_id").alias("source1_entity_id"), F.col("cand_id").alias("candidate_entity_id"), source_of(F.col("cand_id")).alias("candidate_source"))
    rows.repartitionByRange("source1_entity_id").sortWithinPartitions("source1_entity_id", "candidate_entity_id").write.mode("overwrite").csv(path, sep="\t", header=True)


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows as compressed CSV, a folder for each split; the committer makes it all or nothing."""
    features.write.mode("overwrite").partitionBy("split").option("compression", "gzip").csv(path, header=True)


def write_split(split: DataFrame, path: str) -> None:
    split.orderBy("s1_id").select(F.col("s1_id").alias("source1_entity_id"), "split").write.mode("overwrite").csv(path, header=True)


def write_ids(ids: DataFrame, path: str) -> None:
    ids.select(F.col("entity_id").alias("value")).orderBy("value").write.mode("overwrite").text(path, compression="gzip")


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.write.mode("overwrite").csv(f"{path}/csv", header=True)
    statistics.write.mode("overwrite").json(f"{path}/json")


def write_failures(failures: DataFrame, path: str) -> None:
    """One nested row for each failed link."""
    failures.write.mode("overwrite").json(path, compression="gzip")


def write_results(matches: DataFrame, entities: DataFrame, path: str, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids")) -> None:
    """An id list for each entity, empty ones too: (s1_id, match_id) joined to all entities."""
    lists = matches.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("match_id")), ",").alias("ids"))
    rows = entities.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left").select(F.col("s1_id").alias(header[0]), F.coalesce("ids", F.lit("")).alias(header[1]))
    rows.orderBy(header[0]).write.mode("overwrite").csv(path, sep="\t", header=True, emptyValue="", quote="")


def save_frequencies(docs: DataFrame, terms: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(f"{path}/docs", compression="gzip")
    terms.orderBy("field", "country", "term").write.mode("overwrite").json(f"{path}/terms", compression="gzip")


def load_frequencies(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema("country string, n long").json(f"{path}/docs"), spark.read.schema("field string, country string, term string, df long").json(f"{path}/terms")


def save_sample(queries: DataFrame, pool: DataFrame, truth: DataFrame, manifest: dict, path: str) -> None:
    """A cached sample, valid for one input manifest."""
    for name, df in (("query", queries), ("pool", pool), ("truth", truth)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = queries.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_sample(spark: SparkSession, path: str, manifest: dict) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The cached sample, or None if its manifest is another."""
    found = spark.read.text(f"{path}/manifest").first()
    if found is None or json.loads(found.value) != json.loads(json.dumps(manifest)):
        return None
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("query", "pool", "truth"))


def input_manifest(spark: SparkSession, *paths: str) -> dict:
    """Size and time of every input file, by Spark's own file metadata."""
    rows = [r for p in paths for r in spark.read.format("binaryFile").load(p).select("path", "length", "modificationTime").collect()]
    return {r.path: [r.length, str(r.modificationTime)] for r in rows}


def report(metrics: DataFrame, path: str, title: str) -> None:
    """Collected metrics, a few rows, as JSON and as a Markdown table."""
    rows = [r.asDict(recursive=True) for r in metrics.collect()]
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "-|" * len(head), *("| " + " | ".join(str(r[c]) for c in head) + " |" for r in rows)]
    spark = metrics.sparkSession
    for name, text in (("json", json.dumps(rows, default=str, ensure_ascii=False)), ("md", "\n".join(lines))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
