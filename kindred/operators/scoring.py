"""Pair signals, linear scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.similarity import dice, exact, jaccard, weighted_overlap
from ..functions.text import common_prefix

SIGNALS = ("name_exact", "name_jaccard", "name_bigram_dice", "name_prefix", "address_jaccard", "shared_number")
# The weights of each formula, in the order of SIGNALS.
FORMULAS = {
    "name_first": (0.15, 0.30, 0.30, 0.05, 0.17, 0.03),
    "balanced": (0.10, 0.25, 0.25, 0.05, 0.30, 0.05),
    "address_supported": (0.10, 0.20, 0.25, 0.05, 0.35, 0.05),
}


def with_records(pairs: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Pairs (s1_id, cand_id, ...) with both records' columns, prefixed a_ and b_."""
    left = queries.select(F.col("entity_id").alias("s1_id"), *(F.col(c).alias(f"a_{c}") for c in queries.columns if c != "entity_id"))
    right = pool.select(F.col("entity_id").alias("cand_id"), *(F.col(c).alias(f"b_{c}") for c in pool.columns if c != "entity_id"))
    return pairs.join(left, "s1_id").join(right, "cand_id")


def same_country() -> Column:
    return (F.col("a_country") != "") & (F.col("a_country") == F.col("b_country"))


def pair_signals(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with records to (s1_id, cand_id, extra..) and eight signals; a missing address is told, not punished."""
    return pairs.select(
        "s1_id", "cand_id", *extra,
        exact(F.col("a_name"), F.col("b_name")).cast("double").alias("name_exact"),
        jaccard(F.col("a_name_tokens"), F.col("b_name_tokens")).alias("name_jaccard"),
        dice(F.col("a_name_bigrams"), F.col("b_name_bigrams")).alias("name_bigram_dice"),
        (common_prefix(F.col("a_name"), F.col("b_name")) / F.lit(4.0)).alias("name_prefix"),
        jaccard(F.col("a_address_tokens"), F.col("b_address_tokens")).alias("address_jaccard"),
        F.arrays_overlap("a_address_numbers", "b_address_numbers").cast("double").alias("shared_number"),
        same_country().alias("country_equal"),
        ((F.col("a_address") == "") | (F.col("b_address") == "")).alias("missing_address"),
    )


def ranking_score(formula: str) -> Column:
    """The weighted sum of a pair's signals; null where the countries differ."""
    weights = FORMULAS[formula]
    total = sum((F.col(s) * w for s, w in zip(SIGNALS[1:], weights[1:])), F.col(SIGNALS[0]) * weights[0])
    return F.when(F.col("country_equal"), total)


def improved_signals(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Weighted pairs to (s1_id, cand_id, extra.., name_evidence, address_evidence, numeric_evidence), null where the
    countries differ. Containment helps an address only beside two shared words of which one is distinctive."""
    col = F.col
    name_dice, _ = weighted_overlap(col("a_name_weights"), col("b_name_weights"), col("a_name_total"), col("b_name_total"))
    name = F.greatest(exact(col("a_name"), col("b_name")).cast("double"), 0.65 * name_dice + 0.35 * dice(col("a_name_bigrams"), col("b_name_bigrams")))
    shared_words = F.array_intersect("a_address_words", "b_address_words")
    supported = (F.size(shared_words) >= 2) & F.arrays_overlap(shared_words, col("a_distinctive_words"))
    address_dice, containment = weighted_overlap(col("a_address_weights"), col("b_address_weights"), col("a_address_total"), col("b_address_total"))
    shared_numbers = F.array_intersect("a_address_numbers", "b_address_numbers")
    numeric = F.coalesce(F.array_max(F.transform(shared_numbers, lambda t: col("a_address_weights")[t])) / col("a_most_idf"), F.lit(0.0))
    signals = pairs.withColumns({"dice_": address_dice, "contained_": containment})
    address = F.when(supported, 0.65 * col("dice_") + 0.35 * col("contained_")).otherwise(col("dice_"))
    gate = same_country()
    return signals.select("s1_id", "cand_id", *extra, F.when(gate, name).alias("name_evidence"), F.when(gate, address).alias("address_evidence"), F.when(gate, numeric).alias("numeric_evidence"))


def improved_score(version: str = "address_rescue", places: int | None = 12) -> Column:
    """Rounded to ``places``, not at all with None."""
    n, a, q = F.col("name_evidence"), F.col("address_evidence"), F.col("numeric_evidence")
    plain = 0.65 * n + 0.30 * a + 0.05 * q
    if version not in ("weighted", "address_rescue"):
        raise ValueError(f"unknown score version: {version}")
    score = plain if version == "weighted" else F.greatest(plain, 0.85 * a + 0.10 * n + 0.05 * q)
    return score if places is None else F.bround(score, places)


def ranked(scored: DataFrame, score: str = "score", rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Eligible pairs with their rank within an entity, both target sources together: score down, then id up."""
    order = Window.partitionBy("s1_id", *by).orderBy(F.desc(score), "cand_id")
    return scored.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn(rank, F.row_number().over(order).cast("long"))


def top_k(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    if k < 1:
        raise ValueError("K must be positive")
    return ranked(scored, score).filter(F.col("rank") <= k)


def formula_ranks(signals: DataFrame, formulas: tuple[str, ...] = tuple(FORMULAS)) -> DataFrame:
    """(formula, s1_id, cand_id, score, rank): the signals are made once, each formula scores them."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("formula"), F.bround(ranking_score(f), 12).alias("score")) for f in formulas)))
    rows = signals.select("s1_id", "cand_id", each.alias("x")).select("x.formula", "s1_id", "cand_id", "x.score")
    return ranked(rows, by=("formula",))
