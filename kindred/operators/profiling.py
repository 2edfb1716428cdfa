"""Profiles of tables, texts and links, and drift between two sets of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_of


def is_missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")).isin("") | (F.lower(F.col(c).cast("string")) == "nan")


def table_profile(rows: DataFrame, id_col: str) -> DataFrame:
    """One row: rows, columns, missing values by column, unique and duplicate ids."""
    missing = [F.count_if(F.coalesce(is_missing(c), F.lit(True))).alias(f"{c}_missing") for c in rows.columns]
    distinct = F.countDistinct(id_col)
    return rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(rows.columns)).cast("long").alias("column_count"), *missing, distinct.alias("unique_ids"), (F.count(F.lit(1)) - distinct).alias("duplicate_ids"))


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count"))


def match_lists(entities: DataFrame, truth: DataFrame) -> DataFrame:
    """Links of each entity by source, those without links too."""
    src = source_of(F.col("match_id"))
    sizes = truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(src == "S2").alias("s2"), F.count_if(src == "S3").alias("s3"))
    return entities.select(F.col("entity_id").alias("s1_id")).join(sizes, "s1_id", "left").na.fill(0, ["n", "s2", "s3"])


def cardinality(lists: DataFrame) -> DataFrame:
    counts = {"zero": F.col("n") == 0, "one": F.col("n") == 1, "two": F.col("n") == 2, "three_or_more": F.col("n") >= 3}
    total = F.count(F.lit(1))
    out = [F.count_if(c).alias(f"matches_{k}") for k, c in counts.items()] + [(100.0 * F.count_if(c) / total).alias(f"percent_{k}") for k, c in counts.items()]
    return lists.agg(total.alias("entities"), *out, F.max("n").alias("most_matches"), F.avg("n").alias("average_matches"), F.sum("n").alias("total_links"))


def source_coverage(lists: DataFrame) -> DataFrame:
    s2, s3 = F.col("s2") > 0, F.col("s3") > 0
    return lists.agg(F.sum("s2").alias("s2_links"), F.sum("s3").alias("s3_links"), F.count_if(s2 & ~s3).alias("only_s2"), F.count_if(s3 & ~s2).alias("only_s3"), F.count_if(s2 & s3).alias("both_sources"), F.count_if(~s2 & ~s3).alias("no_links"))


def integrity(truth_lists: DataFrame, entities: DataFrame, pool: DataFrame) -> DataFrame:
    """One row of (s1_id, ids array) checks: unknown entities, unknown ids by source, other prefixes, lists with repeats."""
    links = truth_lists.select("s1_id", F.explode("ids").alias("match_id"))
    unknown = links.join(pool.select(F.col("entity_id").alias("match_id")), "match_id", "left_anti")
    src = source_of(F.col("match_id"))
    a = truth_lists.join(entities.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_entities"))
    b = unknown.agg(F.count_if(src == "S2").alias("unknown_s2"), F.count_if(src == "S3").alias("unknown_s3"), F.count_if(~src.isin("S2", "S3")).alias("unknown_prefix"))
    c = truth_lists.agg(F.count_if(F.size("ids") != F.size(F.array_distinct("ids"))).alias("lists_with_repeats"))
    return a.crossJoin(b).crossJoin(c)  # three single rows


def text_statistics(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Of trimmed texts: missing share, lengths of what is there, distinct texts and exact repeats."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    some = F.when(text != "", text)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"), (100.0 * F.count_if(some.isNull()) / F.count(F.lit(1))).alias("missing_percent"), F.avg(F.length(some)).alias("mean_length"), F.median(F.length(some)).alias("median_length"), F.countDistinct(some).alias("unique_values"), (F.count(some) - F.countDistinct(some)).alias("exact_duplicates"))


def drift(train: DataFrame, test: DataFrame, by: str = "src") -> DataFrame:
    """A row for each source: sizes, shares of missing names and addresses and mean lengths of the others on both sides, and
    countries that only the test side has."""
    measures = [f"{p}_{c}_{m}" for c in ("name", "address") for m in ("length", "missing") for p in ("train", "test")]

    def side(rows: DataFrame, p: str) -> DataFrame:
        total, own = F.count(F.lit(1)), []
        for c in ("name", "address"):
            text = F.trim(F.coalesce(F.col(f"business_{c}"), F.lit("")))
            own += [F.avg(F.length(F.when(text != "", text))).alias(f"{p}_{c}_length"), (100.0 * F.count_if(text == "") / total).alias(f"{p}_{c}_missing")]
        return rows.groupBy(by).agg(total.alias(f"{p}_rows"), *own, F.collect_set("country").alias(f"{p}_countries"))

    both = side(train, "train").join(side(test, "test"), by, "full")
    unseen = F.array_join(F.array_sort(F.array_except(F.coalesce("test_countries", F.array().cast("array<string>")), F.coalesce("train_countries", F.array().cast("array<string>")))), ",")
    return both.select(by, "train_rows", "test_rows", *measures, F.size("train_countries").cast("long").alias("train_country_count"), F.size("test_countries").cast("long").alias("test_country_count"), unseen.alias("unseen_countries"))


def examples(lists: DataFrame, truth: DataFrame, entities: DataFrame, pool: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """The first entities of each kind beside their matches; ``wanted`` names a condition on n and how many."""
    parts = None
    for kind, (condition, most) in wanted.items():
        own = lists.join(entities, lists.s1_id == entities.entity_id).filter(condition).orderBy("seq", "s1_id").limit(most).select(F.lit(kind).alias("kind"), "s1_id", F.col("business_name").alias("s1_name"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.join(truth, "s1_id", "left").join(pool.select(F.col("entity_id").alias("match_id"), F.col("business_name").alias("match_name")), "match_id", "left")
