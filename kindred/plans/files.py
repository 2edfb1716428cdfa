"""Queries of the sources and sinks: each writes whole tables to the shared folder and returns what it reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, validation
from ..session import scratch
from ..sources import records as src
from ..sources import sinks
from .fixture import Linkage, raw_sources
from .queries import RESULT_LINES, _failed


def tsv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as quoted tab-separated rows, read and normalized."""
    path = scratch(spark)
    raw_sources(spark, sf_dir).drop("seq").write.options(header="true", sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return src.records(src.read_tsv(spark, path)).select("entity_id", "name", "address", "country", "src", "seq")


def truth_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links written as lists, with blanks and repeats put in, and read by the truth loader."""
    x, path = Linkage(spark, sf_dir), scratch(spark)
    lists = x.truth.groupBy("s1_id").agg(F.concat_ws(", ", F.collect_list("match_id"), F.lit(""), F.max("match_id")).alias("ids"))
    rows = x.queries.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    rows.select(F.col("s1_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids")).write.csv(path, sep="\t", header=True)
    return src.truth(src.read_tsv(spark, path, src.TRUTH_SCHEMA), x.queries)


def sample_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved sample, loaded by its manifest; another manifest finds nothing."""
    x, path = Linkage(spark, sf_dir), scratch(spark)
    slim = lambda df: df.select("entity_id", "name", "address")
    sinks.save_sample(slim(x.queries), slim(x.pool), x.truth, {"input": sf_dir}, path)
    if sinks.load_sample(spark, path, {"input": "another"}) is not None:
        raise ValueError("a sample of another input was loaded")
    queries, pool, truth = sinks.load_sample(spark, path, {"input": sf_dir})
    parts = [queries.select(F.lit("query").alias("part"), "entity_id", F.col("name").alias("value")), pool.select(F.lit("pool"), "entity_id", "address"), truth.select(F.lit("truth"), "s1_id", "match_id")]
    return parts[0].union(parts[1]).union(parts[2])


def frequency_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = Linkage(spark, sf_dir), scratch(spark)
    sinks.save_frequencies(x.docs, x.terms, path)
    docs, terms = sinks.load_frequencies(spark, path)
    return terms.join(docs, "country").select("field", "country", "term", "df", "n")


def pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, path = Linkage(spark, sf_dir), scratch(spark)
    sinks.write_pairs(blocking.candidates(x.queries, x.pool), path)
    return spark.read.csv(path, sep="\t", header=True, schema="source1_entity_id string, candidate_entity_id string, candidate_source string")


def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compressed feature rows of both splits, a few columns read back."""
    path = scratch(spark)
    sinks.write_features(Linkage(spark, sf_dir).features(), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("s1_id", "cand_id", F.col("name_exact").cast("int").alias("name_exact"), F.col("label").cast("int").alias("label"), "split")


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_split(Linkage(spark, sf_dir).split, path)
    return spark.read.csv(path, header=True, schema="source1_entity_id string, split string")


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_ids(Linkage(spark, sf_dir).pool, path)
    return spark.read.text(path).select(F.col("value").alias("entity_id"))


def failure_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_failures(_failed(Linkage(spark, sf_dir)), path)
    return spark.read.schema("s1_id string, match_id string, rank long, kind string").json(path)


def _result_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of a results file made by rule, written as one text file and read line by line."""
    path = scratch(spark)
    lines = spark.sql(RESULT_LINES, documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    lines.orderBy("line", "value").select("value").coalesce(1).write.text(path)
    read = validation.text_lines(spark, path)
    if problem := validation.header_error(read.filter("line = 1").first().value, validation.MATCHING):
        raise ValueError(problem)
    return validation.lists_of(read)


def validator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.row_counts(_result_lists(spark, sf_dir))


def matches_outside_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches against candidates that lack the lists of every fifth line."""
    lists = _result_lists(spark, sf_dir)
    return validation.outside_candidates(lists, lists.filter("line % 5 <> 0"))


FILE_QUERIES = {f.__name__: f for f in (tsv_records, truth_links, sample_cache, frequency_snapshot, pair_file, feature_file, split_manifest, id_list, failure_file, validator_rows, matches_outside_candidates)}
