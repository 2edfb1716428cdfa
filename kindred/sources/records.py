"""Records, truth and candidate pools. Columns of records: entity_id, business_name, business_address, country, name,
address (the last three normalized), src (1, 2 or 3) and seq, the place in the source's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize, source_of

TSV = {"header": "true", "sep": "\t", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}
RECORD_SCHEMA = "entity_id string, business_name string, business_address string, country string"
TRUTH_SCHEMA = "source1_entity_id string, matched_entity_ids string"


def read_tsv(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Quoted tab-separated rows with a header; a byte-order mark is dropped, embedded line breaks are kept."""
    return spark.read.schema(schema).options(**TSV).csv(path)


def records(raw: DataFrame, seq: str | None = None) -> DataFrame:
    """Raw rows with what is missing as '', and normalized text. ``seq`` names a column that has the order; without one the
    number in the id serves."""
    known = set(raw.columns)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in known else F.lit("")
    order = F.col(seq) if seq else F.regexp_extract("entity_id", r"-(\d+)", 1).try_cast("long")
    return raw.select(
        "entity_id", text("business_name").alias("business_name"), text("business_address").alias("business_address"),
        normalize(text("country")).alias("country"), normalize(text("business_name")).alias("name"), normalize(text("business_address")).alias("address"),
        F.substring(source_of(F.col("entity_id")), 2, 1).try_cast("int").alias("src"), order.cast("long").alias("seq"),
    )


def first_rows(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` (from 1, both in) in the order of seq; a sample of bounded size. Ids must be unique."""
    sample = rows.orderBy("seq", "entity_id").limit(end)
    if start > 1:
        sample = sample.withColumn("n", F.row_number().over(Window.orderBy("seq", "entity_id"))).filter(F.col("n") >= start).drop("n")
    if not sample.groupBy("entity_id").count().filter("count > 1").isEmpty():
        raise ValueError("entity ids must be unique")
    return sample


def truth(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """(s1_id, match_id) of the entities: lists split at commas, trimmed, without blanks and repeats. An id of another source
    and an entity without a row are errors; an entity with an empty list has no rows here."""
    own = raw.join(entities.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    if not entities.join(raw, entities.entity_id == raw.source1_entity_id, "left_anti").isEmpty():
        raise ValueError("the truth lacks entities")
    items = own.select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("m"))
    links = items.select("s1_id", F.trim("m").alias("match_id")).filter("match_id <> ''").distinct()
    if not links.filter(~F.col("match_id").rlike("^S[23]-")).isEmpty():
        raise ValueError("a match is of no target source")
    return links


def sampled_pool(rows: DataFrame, required: DataFrame, size: int, seed: int) -> DataFrame:
    """Every required record (entity_id) and ``size`` others, those of the smallest seeded digests: a uniform sample that
    does not depend on order."""
    if not required.join(rows, "entity_id", "left_anti").isEmpty():
        raise ValueError("required records are missing")
    needed = rows.join(required.select("entity_id").distinct(), "entity_id", "left_semi")
    others = rows.join(required, "entity_id", "left_anti")
    drawn = others.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "entity_id")), "entity_id").limit(size)
    pool = needed.unionByName(drawn)
    if not pool.groupBy("entity_id").count().filter("count > 1").isEmpty():
        raise ValueError("retained ids repeat")
    return pool


def pool_stats(rows: DataFrame, required: DataFrame, pool: DataFrame) -> DataFrame:
    need = required.select("entity_id").distinct()
    counts = pool.join(need.withColumn("needed", F.lit(1)), "entity_id", "left").agg(F.count(F.lit(1)).alias("retained_rows"), F.count("needed").alias("true_match_records"))
    return rows.agg(F.count(F.lit(1)).alias("scanned_rows")).crossJoin(counts).select("scanned_rows", "true_match_records", (F.col("retained_rows") - F.col("true_match_records")).alias("distractors"), "retained_rows")
