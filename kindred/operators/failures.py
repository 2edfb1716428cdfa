"""Why true links fail: blocking and ranking failures, overlapping flags, rivals, cutoffs and examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import dice
from ..functions.text import script_profile, tokens
from .evaluation import linked_ranks
from .scoring import same_country

# The names of the flags.
FLAGS = (
    "country_missing_or_different", "different_dominant_scripts", "disjoint_letter_scripts", "first_name_token_changed", "name_tokens_reordered", "no_shared_name_tokens",
    "spelling_change_proxy", "abbreviation_proxy", "address_missing", "nonempty_addresses_differ", "no_shared_address_words", "address_numbers_disjoint",
    "address_numbers_missing_on_either_side", "short_name_on_either_side", "all_name_tokens_common_on_either_side", "weak_character_name_overlap",
)
CUTOFF = 150


def failure_kinds(truth: DataFrame, ranks: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """(s1_id, match_id, rank, kind): links that are no candidates, and those ranked behind ``cutoff``."""
    return kinds(linked_ranks(truth, ranks), cutoff)


def kinds(links: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """The same of (s1_id, match_id, rank) of every link, rank null where it is no candidate."""
    kind = F.when(F.col("rank").isNull(), "blocking").when(F.col("rank") > cutoff, "ranking")
    return links.select("s1_id", "match_id", "rank", kind.alias("kind")).filter("kind is not null")


def _abbreviates(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (F.length(x) >= 2) & (F.length(y) > F.length(x)) & y.startswith(x)))


def flags(pairs: DataFrame, common_names: DataFrame, scripts: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Weighted pairs to (s1_id, cand_id, .., extra..) and a column for each flag. ``common_names`` has (country, term) of the name tokens
    that are common in a country; the left record's country decides. Without ``scripts`` no Python runs, and the three flags
    that need letters' scripts are null."""
    col = F.col
    common = common_names.groupBy("country").agg(F.collect_set("term").alias("common_terms"))
    rows = pairs.join(common, pairs["a_country"] == common["country"], "left").drop("country").withColumn("common_terms", F.coalesce("common_terms", F.array().cast("array<string>")))
    if scripts:
        rows = rows.withColumns({"sa": script_profile(col("a_name")), "sb": script_profile(col("b_name"))})
        da, db, sa, sb = col("sa.dominant"), col("sb.dominant"), col("sa.scripts"), col("sb.scripts")
        different, disjoint, same = F.coalesce(da != db, F.lit(False)), (F.size(sa) > 0) & (F.size(sb) > 0) & ~F.arrays_overlap(sa, sb), da.eqNullSafe(db)
    else:
        different = disjoint = same = F.lit(None).cast("boolean")
    at, bt = tokens(col("a_name")), tokens(col("b_name"))
    gram = dice(col("a_name_bigrams"), col("b_name_bigrams"))
    overlap = lambda c: F.size(F.array_intersect(f"a_{c}", f"b_{c}")) > 0
    some = lambda c: F.size(c) > 0
    all_common = lambda c: some(c) & (F.size(F.array_except(c, "common_terms")) == 0)
    values = (
        ~same_country(), different, disjoint, some(at) & some(bt) & (F.get(at, F.lit(0)) != F.get(bt, F.lit(0))), some(at) & some(bt) & (at != bt) & (col("a_name_tokens") == col("b_name_tokens")), ~overlap("name_tokens"),
        same & (col("a_name") != col("b_name")) & (gram >= 0.5), _abbreviates(col("a_name_tokens"), col("b_name_tokens")) | _abbreviates(col("b_name_tokens"), col("a_name_tokens")),
        ~(some("a_address_tokens") & some("b_address_tokens")), some("a_address_tokens") & some("b_address_tokens") & (col("a_address") != col("b_address")), ~overlap("address_words"),
        some("a_address_numbers") & some("b_address_numbers") & ~overlap("address_numbers"), ~(some("a_address_numbers") & some("b_address_numbers")),
        (F.size(at) <= 2) | (F.size(bt) <= 2), all_common("a_name_tokens") | all_common("b_name_tokens"), gram < 0.2,
    )
    return rows.select("s1_id", "cand_id", *(v.alias(f) for f, v in zip(FLAGS, values)), *extra)


def categories(flagged: DataFrame, by: tuple[str, ...] = ("kind",)) -> DataFrame:
    """(by.., flag, links): overlapping counts of rows that have the flags."""
    names = F.explode(F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in FLAGS)))).alias("flag")
    return flagged.select(*by, names).groupBy(*by, "flag").agg(F.count(F.lit(1)).alias("links"))


def rivals(failed: DataFrame, ranks: DataFrame, truth: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """(s1_id, rival_id, rival_rank, match_id): for every ranking failure the best candidate within the cutoff that is no match."""
    false = ranks.filter(F.col("rank") <= cutoff).join(truth.withColumnRenamed("match_id", "cand_id"), ["s1_id", "cand_id"], "left_anti")
    best = false.groupBy("s1_id").agg(F.min_by("cand_id", "rank").alias("rival_id"), F.min("rank").alias("rival_rank"))
    return failed.filter("kind = 'ranking'").select("s1_id", "match_id").join(best, "s1_id")


def rival_diagnostics(rival_pairs: DataFrame, signals: DataFrame, common: DataFrame) -> DataFrame:
    """(s1_id, match_id, rival_id) and four checks. ``rival_pairs`` has the rival's record as b_; ``signals`` are of all
    candidate pairs; ``common`` has (field, country, term) of common terms."""
    of = lambda f: common.filter(F.col("field") == f).groupBy("country").agg(F.collect_set("term").alias(f"common_{f}"))
    none = F.array().cast("array<string>")
    rows = rival_pairs.join(of("name").withColumnRenamed("country", "a_country"), "a_country", "left").join(of("address").withColumnRenamed("country", "a_country"), "a_country", "left")
    names, nums = F.array_intersect("a_name_tokens", "b_name_tokens"), F.array_intersect("a_address_numbers", "b_address_numbers")
    pick = lambda c, p: signals.select("s1_id", F.col("cand_id").alias(c), F.col("address_jaccard").alias(f"{p}_address"), F.col("name_bigram_dice").alias(f"{p}_name"))
    both = rows.withColumnRenamed("cand_id", "rival_id").join(pick("rival_id", "rival"), ["s1_id", "rival_id"]).join(pick("match_id", "true"), ["s1_id", "match_id"])
    return both.select(
        "s1_id", "match_id", "rival_id",
        ((F.size(names) > 0) & (F.size(F.array_except(names, F.coalesce("common_name", none))) == 0)).alias("shares_only_common_name_tokens"),
        (F.size(F.array_intersect(nums, F.coalesce("common_address", none))) > 0).alias("shares_a_common_number"),
        (F.col("rival_address") < F.col("true_address")).alias("less_address_overlap_than_true"),
        (F.col("rival_name") > F.col("true_name")).alias("more_name_bigram_overlap"),
    )


def cutoffs(failed: DataFrame, ranks: DataFrame, truth: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """The candidate at the cutoff of every entity with a ranking failure, and whether it is a match."""
    at = ranks.filter(F.col("rank") == cutoff).join(failed.filter("kind = 'ranking'").select("s1_id").distinct(), "s1_id", "left_semi")
    return at.join(truth.select("s1_id", F.col("match_id").alias("cand_id"), F.lit(True).alias("t")), ["s1_id", "cand_id"], "left").select("s1_id", F.col("cand_id").alias("cutoff_id"), F.col("score").alias("cutoff_score"), F.coalesce("t", F.lit(False)).alias("is_true"))


def examples(flagged: DataFrame, most: int = 2) -> DataFrame:
    """The first ``most`` failures of each kind and flag, in the order of (seq, cand_id)."""
    names = F.explode(F.array_compact(F.array(*(F.when(F.col(f), F.lit(f)) for f in FLAGS)))).alias("flag")
    order = Window.partitionBy("kind", "flag").orderBy("seq", "cand_id")
    return flagged.select("kind", "seq", "s1_id", "cand_id", names).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
