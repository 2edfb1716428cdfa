"""The labelled pair-feature table, its split and its exact statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import dice, exact, indel_ratio, jaccard, length_ratio, rare_token_dice, token_set_ratio
from ..functions.text import common_prefix, source_of
from .scoring import same_country

# The names and order of the features, and the percentiles.
FEATURES = (
    "name_exact", "name_token_jaccard", "name_bigram_dice", "name_trigram_dice", "name_length_ratio", "name_prefix_similarity", "name_rare_token_dice", "s1_name_missing", "candidate_name_missing",
    "address_exact", "address_token_jaccard", "address_bigram_dice", "shared_numeric_token_count", "numeric_token_jaccard", "address_rare_token_dice", "s1_address_missing", "candidate_address_missing",
    "both_addresses_missing", "address_length_ratio", "country_equal", "candidate_is_s2", "candidate_is_s3", "candidate_ranking_score", "candidate_rank", "ranking_available",
)
FUZZY = ("name_indel_ratio", "name_token_set_ratio")
PERCENTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def split_entities(entities: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(s1_id, split): the entities of the smallest seeded digests are for validation, by half-even rounding of the fraction.
    It depends on no order and looks at ids alone."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    ids = entities.select(F.col("entity_id").alias("s1_id"), F.md5(F.concat(F.lit(f"{seed}:"), "entity_id")).alias("draw"))
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s1_id").alias("d")).first()
    if size.n != size.d:
        raise ValueError("entity ids must be unique")
    chosen = round(size.n * fraction)
    if not 0 < chosen < size.n:
        raise ValueError("both splits need an entity")
    # The digest at the cut is found by counts of first digits, so that no task has to sort all ids.
    digits = ids.groupBy(F.substring("draw", 1, 4).alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy("head").collect()
    before, head = 0, None
    for r in digits:  # at most 65,536 rows
        if before + r.n >= chosen:
            head = r.head
            break
        before += r.n
    inside = Window.orderBy("draw", "s1_id")
    edge = ids.filter(F.substring("draw", 1, 4) == head).withColumn("split", F.when(F.row_number().over(inside) <= chosen - before, "validation").otherwise("train"))
    rest = ids.filter(F.substring("draw", 1, 4) != head).withColumn("split", F.when(F.substring("draw", 1, 4) < head, "validation").otherwise("train"))
    return edge.unionByName(rest).select("s1_id", "split")


def training_pool(pool: DataFrame, truth: DataFrame, split: DataFrame) -> DataFrame:
    """The pool without records that match validation entities alone: what frozen frequencies may be fitted on."""
    links = truth.join(split, "s1_id")
    of = lambda s: links.filter(F.col("split") == s).select(F.col("match_id").alias("entity_id")).distinct()
    return pool.join(of("validation").join(of("train"), "entity_id", "left_anti"), "entity_id", "left_anti")


def is_invalid(source: Column) -> Column:
    """Of a pair with score and rank."""
    score, rank = F.col("score"), F.col("rank")
    bad = ~source.isin("S2", "S3") | (score.isNull() != rank.isNull()) | (rank < 1) | ~score.between(0, 1) | F.isnan("score")
    return F.coalesce(bad, F.lit(False))


def pair_features(pairs: DataFrame, keep: tuple[str, ...] = (), fuzzy: bool = False) -> DataFrame:
    """Weighted pairs (with score and rank, both null where there is none) to (s1_id, cand_id, keep.., features). Sources
    other than S2 and S3, scores outside 0 to 1, ranks below 1 and one of both alone are errors."""
    col, flag = F.col, lambda c: c.cast("int")
    source = source_of(col("cand_id"))
    good = F.when(is_invalid(source), F.raise_error(F.lit("a pair's source, score or rank is invalid"))).otherwise(source)
    rows = pairs.withColumn("source_", good)
    a, b = (lambda c: col(f"a_{c}")), (lambda c: col(f"b_{c}"))
    values = {
        "name_exact": flag(exact(a("name"), b("name"))),
        "name_token_jaccard": jaccard(a("name_tokens"), b("name_tokens")),
        "name_bigram_dice": dice(a("name_bigrams"), b("name_bigrams")),
        "name_trigram_dice": dice(a("name_grams"), b("name_grams")),
        "name_length_ratio": length_ratio(a("name"), b("name")),
        "name_prefix_similarity": common_prefix(a("name"), b("name")) / F.lit(4.0),
        "name_rare_token_dice": rare_token_dice(a("name_weights"), b("name_weights"), a("name_total"), b("name_total")),
        "s1_name_missing": flag(a("name") == ""),
        "candidate_name_missing": flag(b("name") == ""),
        "address_exact": flag(exact(a("address"), b("address"))),
        "address_token_jaccard": jaccard(a("address_tokens"), b("address_tokens")),
        "address_bigram_dice": dice(a("address_bigrams"), b("address_bigrams")),
        "shared_numeric_token_count": F.size(F.array_intersect(a("address_numbers"), b("address_numbers"))),
        "numeric_token_jaccard": jaccard(a("address_numbers"), b("address_numbers")),
        "address_rare_token_dice": rare_token_dice(a("address_weights"), b("address_weights"), a("address_total"), b("address_total")),
        "s1_address_missing": flag(a("address") == ""),
        "candidate_address_missing": flag(b("address") == ""),
        "both_addresses_missing": flag((a("address") == "") & (b("address") == "")),
        "address_length_ratio": length_ratio(a("address"), b("address")),
        "country_equal": flag(same_country()),
        "candidate_is_s2": flag(col("source_") == "S2"),
        "candidate_is_s3": flag(col("source_") == "S3"),
        "candidate_ranking_score": F.coalesce("score", F.lit(0.0)),
        "candidate_rank": F.coalesce("rank", F.lit(0)).cast("int"),
        "ranking_available": flag(col("rank").isNotNull()),
    }
    doubles = {f for f in FEATURES if f.endswith(("jaccard", "dice", "ratio", "similarity", "score"))}
    out = [(F.bround(values[f], 8) if f in doubles else values[f]).alias(f) for f in FEATURES]
    if fuzzy:
        out += [F.bround(indel_ratio(a("name"), b("name")), 8).alias(FUZZY[0]), F.bround(token_set_ratio(a("name"), b("name")), 8).alias(FUZZY[1])]
    return rows.select("s1_id", "cand_id", *keep, *out)


def labelled(pairs: DataFrame, truth: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Pairs with label 1 where the candidate is a match. With ``covered`` (s1_id), the entities whose truth is known, be it
    that they have no match, a pair of another entity is an error."""
    if covered is not None:
        there = F.when(F.col("there"), F.col("s1_id")).otherwise(F.raise_error(F.concat(F.lit("the truth lacks the entity "), F.col("s1_id"))))
        pairs = pairs.join(covered.select("s1_id", F.lit(True).alias("there")), "s1_id", "left").withColumn("s1_id", there).drop("there")
    hits = truth.select("s1_id", F.col("match_id").alias("cand_id"), F.lit(1).alias("hit"))
    return pairs.join(hits, ["s1_id", "cand_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def statistics(features: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(split, label, feature) with count, mean, population deviation, extremes and interpolated percentiles, all exact."""
    stack = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    rows = features.selectExpr("split", "label", f"stack({len(names)}, {stack}) as (feature, value)")
    valid = rows.withColumn("value", F.when(F.isnan("value") | F.abs("value").isin(float("inf")), F.raise_error(F.lit("a feature is not finite")).cast("double")).otherwise(F.col("value")))
    by = ["split", "label", "feature"]
    # Equal values are counted where they are made; a group's distinct values are then gone through in order, one at a time.
    counted = valid.groupBy(*by, "value").agg(F.count("value").alias("n")).persist()
    moments = counted.groupBy(*by).agg(F.sum("n").alias("count"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counted.withColumn("upto", upto).join(F.broadcast(moments), by)  # a row for each split, label and feature
    place = lambda p: (F.col("count") - 1) * p
    at = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("value")))
    ends = [at(f(place(p))).alias(f"{name}_{side}") for name, p in PERCENTILES.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    spread = F.sqrt(F.sum(F.col("n") * F.pow(F.col("value") - F.col("mean"), F.lit(2.0))) / F.first("count")).alias("std")
    out = rows.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("count", "mean", "min", "max")), spread, *ends)
    between = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (place(p) - F.floor(place(p)))).alias(name) for name, p in PERCENTILES.items()]
    return out.select(*by, "count", "mean", "std", "min", *between, "max")


def separation(stats: DataFrame) -> DataFrame:
    """Standardized gaps between the classes' means, of training rows; features without both classes are left out."""
    train = stats.filter("split = 'train'")
    side = lambda label, p: train.filter((F.col("label") == label) & (F.col("count") > 0)).select("feature", F.col("mean").alias(f"{p}_mean"), F.col("std").alias(f"{p}_std"))
    gap = F.col("positive_mean") - F.col("negative_mean")
    pooled = F.sqrt((F.pow("positive_std", F.lit(2)) + F.pow("negative_std", F.lit(2))) / 2)
    rows = side(1, "positive").join(side(0, "negative"), "feature")
    return rows.select("feature", "positive_mean", "negative_mean", (F.abs(gap) / F.greatest(pooled, F.lit(1e-12))).alias("standardized_mean_gap"), F.when(gap > 0, "higher").when(gap < 0, "lower").otherwise("none").alias("positive_direction"))


def constant_features(stats: DataFrame) -> DataFrame:
    """Features with one value in all training rows."""
    return stats.filter("split = 'train' and count > 0").groupBy("feature").agg(F.min("min").alias("lo"), F.max("max").alias("hi")).filter("lo = hi").select("feature")


def balances(split: DataFrame, truth: DataFrame, features: DataFrame) -> DataFrame:
    """A row for each split: entities, pairs by label and recall; entities without candidates count."""
    sizes = split.join(features.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")), "s1_id", "left")
    links = split.join(truth, "s1_id").groupBy("split").agg(F.count(F.lit(1)).alias("known_true_links"))
    rows = sizes.groupBy("split").agg(F.count(F.lit(1)).alias("s1_entities"), F.count_if(F.col("n").isNull()).alias("zero_candidate_entities"), F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("positive_pairs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("candidate_pairs"))
    both = rows.join(links, "split", "left").withColumns({"known_true_links": F.coalesce("known_true_links", F.lit(0)).cast("long"), "negative_pairs": F.col("candidate_pairs") - F.col("positive_pairs")})
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("candidate_pairs").cast("double")), F.lit(0.0))
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return both.select("split", "s1_entities", "zero_candidate_entities", "positive_pairs", "negative_pairs", "candidate_pairs", share("positive_pairs").alias("positive_percentage"), share("negative_pairs").alias("negative_percentage"), part("negative_pairs", "positive_pairs").alias("negative_positive_ratio"), "known_true_links", part("positive_pairs", "known_true_links").alias("candidate_recall"), part("candidate_pairs", "s1_entities").alias("mean_candidates_per_s1"))


def schema_descriptor(fuzzy: bool = False) -> dict[str, object]:
    """What the columns of a feature file are."""
    return {
        "metadata": ["source1_entity_id", "candidate_entity_id", "candidate_source"],
        "target": "label",
        "features": [*FEATURES, *(FUZZY if fuzzy else ())],
        "label_rule": "1 if the candidate is among the entity's matches, else 0; no match is added that is no candidate",
        "split_rule": "entities, never pairs, are split; frequencies leave out records that only validation entities match",
        "statistics": "exact, of all rows; population deviation; interpolated percentiles",
    }
